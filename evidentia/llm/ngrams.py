"""N-gram Jaccard join: a prefix-tree join over globally ordered sets of word shingles.

The order is the same for all sets: by how often the corpus has a shingle, rare ones first, then by hash. How often is counted over all documents in a
table of fixed size by hash; where two shingles share a counter the order changes, never a result. Two sets that are similar enough share
a shingle among the first few of each, so rows of (shingle, set, its size, the shingle's place) for those few find all candidates: they are streamed by
shingle, in order, and two sets are candidates if what remains of both after the shingle allows the overlap that their sizes ask for. Each set is compared with the
first candidate before it, then, once components are known, with all other candidates outside its own; shingles of very many sets are compared block by block.

Sets that meet in a task are joined in a prefix tree: those of one side are stored in a trie, edges of several shingles, and the trie is traversed
with the overlap of the path with every set of the other side, which all sets below share. A subtree is left as soon as no set of the other side
can reach the overlap that its sizes ask for, given what remains of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, give_back, tidy
from evidentia.llm.components import components, forest
from evidentia.llm.shingles import _identified, _labelled, _mix, _rest_links, _star_links

#: Words of a shingle, and the similarity from which two sets are linked, in hundredths.
SIZE, LEAST = 4, 85
#: Counters of the order, as bits of a hash; bytes of a text split at once; shingles of an edge taken at once.
COUNTERS, SLICE, STEP = 20, 1 << 20, 64
#: Counters that reach the driver in one row.
STRIP = 1 << 14
#: A shingle counted this often, and so many times more often than the mean of all counters, is dealt into parts of about that size.
HOT, OFTEN = 1 << 16, 4
#: Rows of a shingle up to which all its pairs are looked at.
RUN = 64
#: Words and sets remembered by a worker.
_KNOWN = 1 << 18


class _Hashes(dict):
    """XXH64 of words, those seen last remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


#: A-Z lower-cased, and one kind of space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def _slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def shingle_set(text: str | None, known: _Hashes, size: int = SIZE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ascending; a text of fewer words is one shingle, one without words none."""
    parts, last, n = [], np.empty(0, np.uint64), 0
    for words in _slices(text):
        h = np.concatenate((last, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
        n += len(words)
        if len(h) >= size:
            out = np.full(len(h) - size + 1, size, np.uint64)
            for i in range(size):
                out = _mix(out, h[i : i + len(out)])
            parts.append(out)
        last = h[-(size - 1) :]
    if 0 < n < size:
        out = np.full(1, n, np.uint64)
        for i in range(n):
            out = _mix(out, last[i : i + 1])
        return out
    found = np.sort(np.concatenate([np.empty(0, np.uint64), *parts]))
    return found[np.concatenate((found[:1] >= 0, found[1:] != found[:-1]))] if len(found) else found


def in_order(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A set's shingles by 8 bits of the class of their counter and 56 of their hash, ascending: numbers in the global order."""
    return np.sort(often[hashes >> np.uint64(64 - COUNTERS)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8))


def prefix_size(n: int, least: int = LEAST) -> int:
    """How many of a set's first shingles it takes to meet every similar set among that many of its own: all but the overlap's least size, and one."""
    return n + least * n // -100 + 1 if n else 0


def needed(a: np.ndarray | int, b: np.ndarray | int, least: int = LEAST) -> np.ndarray | int:
    """The least overlap of similar sets of sizes a and b: 100 * overlap >= least * (a + b - overlap)."""
    return -(-least * (a + b) // (100 + least))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class PrefixTree:
    """Sets of ranks (each ascending) in lexicographic order, with the length of the prefix each shares with the one before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.shared = [0, *(_common(a, b) for a, b in zip(self.sets, self.sets[1:], strict=False))]

    def join(self, others: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
        """Places (i, j) of a set of the tree and one of `others` that are similar; empty sets are similar to none."""
        sizes, found = np.array([len(s) for s in others], np.int64), []
        if not len(self.sets) or not sizes.sum():
            return found
        ends = np.cumsum(sizes)
        rank = np.concatenate(others).astype(np.int64)
        placed = np.repeat(np.arange(len(others)), sizes) << 32 | rank  # ascending
        by_rank = np.argsort(rank, kind="stable")
        ranked, owner = rank[by_rank], np.repeat(np.arange(len(others)), sizes)[by_rank]
        stack = [(0, len(self.sets), 0, np.flatnonzero(sizes), np.zeros(len(others), np.int64))]
        while stack:
            low, high, depth, alive, overlap = stack.pop()
            inside = self.sizes[low:high]
            least_size, most = int(inside.min()), int(inside.max())
            least_size = max(1, least_size)
            alive = alive[(100 * sizes[alive] >= least * least_size) & (100 * most >= least * sizes[alive])]
            end = min(self.shared[low + 1 : high]) if high - low > 1 else most
            first = self.sets[low]
            while depth < end and len(alive):  # the edge, some shingles at a time
                step = first[depth : min(end, depth + STEP)]
                a, b = np.searchsorted(ranked, step, "left"), np.searchsorted(ranked, step, "right")
                held = np.concatenate([owner[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True) if y > x] or [owner[:0]])
                overlap = overlap + np.bincount(held, minlength=len(others))
                depth += len(step)
                remain = ends[alive] - np.searchsorted(placed, alive << 32 | int(step[-1]), "right")
                reach = overlap[alive] + np.minimum(remain, most - depth)
                alive = alive[reach >= needed(np.maximum(least_size, depth), sizes[alive], least)]
            if not len(alive):
                continue
            if end == most and high - low == 1 or most == end:
                done = alive[overlap[alive] >= needed(end, sizes[alive], least)]
                found += [(i, int(j)) for i in range(low, high) for j in done]
                continue
            at = low
            while at < high and self.sizes[at] == end:  # sets that end here come first
                found += [(at, int(j)) for j in alive[overlap[alive] >= needed(end, sizes[alive], least)]]
                at += 1
            while at < high:
                to = at + 1
                while to < high and self.shared[to] > end:
                    to += 1
                stack.append((at, to, end, alive, overlap))
                at = to
        return [(self.order[i], j) for i, j in found]


def similar(left: list[np.ndarray], right: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """Places (i, j) of similar sets of two lists, numbers in one global order each."""
    every = np.unique(np.concatenate([np.empty(0, np.uint64), *left, *right]))
    return PrefixTree([np.searchsorted(every, s) for s in left]).join([np.searchsorted(every, s) for s in right], least)


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _forest_of(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> pd.DataFrame:
    """As few links (a, b) as keep the pairs of places connected."""
    names, same = np.unique(nodes, return_inverse=True)
    label = forest(len(names), same[np.array(pairs, np.int64).reshape(-1, 2)]) if pairs else np.arange(len(names))
    linked = label != np.arange(len(names))
    return pd.DataFrame({"a": names[linked], "b": names[label[linked]]})


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of `key`, or inside one."""
    give_back()
    x, y = (rows[rows["block"] == k].drop_duplicates("node") for k in key)
    sets = [[_numbers(s) for s in part["shingles"]] for part in (x, y)]
    nodes = np.concatenate([x["node"].to_numpy(np.int64), y["node"].to_numpy(np.int64)])
    return _forest_of(nodes, [(i, j + len(x)) for i, j in similar(*sets)])


def _with_pivot(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links of the pivot, key's first part, with the nodes that are similar to it."""
    give_back()
    own = rows["node"].to_numpy(np.int64) == key[0]
    others = rows[~own]
    found = similar([_numbers(s) for s in others["shingles"]], [_numbers(rows[own]["shingles"].iloc[0])])
    nodes = others["node"].to_numpy(np.int64)[[i for i, _ in found]]
    return pd.DataFrame({"a": nodes, "b": np.full(len(nodes), key[0], np.int64)})


_LINKS = "a long, b long"


def _counted(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(slot, times) of a partition's texts: in how many documents the counters' shingles are."""
    counts, known, parts, size = np.zeros(1 << COUNTERS, np.int64), _Hashes(), [], 0

    def flushed() -> None:
        counts[:] += np.bincount(np.concatenate(parts), minlength=len(counts))
        parts.clear()

    for block in blocks:
        for text in block["text"]:
            parts.append((shingle_set(text, known) >> np.uint64(64 - COUNTERS)).astype(np.int64))
            size += len(parts[-1])
            if size > 1 << 20:
                flushed()
                size = 0
    if parts:
        flushed()
    slots = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": slots, "times": counts[slots]})
    give_back()


def _strip(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """STRIP counters in one row."""
    counts = np.zeros(STRIP, np.int64)
    counts[rows["slot"].to_numpy(np.int64) % STRIP] = rows["times"].to_numpy(np.int64)
    return pd.DataFrame({"strip": [key[0]], "counts": [counts.tobytes()]})


def _order(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The class of each counter, and into how many parts its shingles are dealt (none: 0). The driver gets 2^COUNTERS counters of 8 bytes."""
    found = docs.select("text").mapInPandas(_counted, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times"))
    strips = found.groupBy(F.floor(F.col("slot") / STRIP).alias("strip")).applyInPandas(_strip, "strip long, counts binary")
    counts = np.zeros(1 << COUNTERS, np.int64)
    for row in strips.collect():
        counts[row["strip"] * STRIP : (row["strip"] + 1) * STRIP] = np.frombuffer(row["counts"], np.int64)
    hot = (counts >= HOT) & (counts > OFTEN * counts.mean())
    return np.minimum(255, np.rint(8 * np.log2(1 + counts))).astype(np.uint8), np.where(hot, np.minimum(counts // HOT + 1, 1 << 15), 0).astype(np.int16)


def may_match(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose first common shingle is at places `at` and `to` of their order can be similar: by their sizes, and by what remains of both."""
    return (100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)) & (np.minimum(n - at, m - to) >= needed(n, m))


_MEMBERS = ("key", "part", "node", "n", "at")


def _in_runs(blocks: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Rows in (key, part, node) order, whole runs of a (key, part) of RUN rows at most together: columns, each row's place in its run, and whether the run is longer.
    Of a longer run the rows come some at a time, the first one before each of them."""
    held: dict[str, np.ndarray] | None = None  # rows of the last run, or the first row of a longer one
    long = False
    for block in blocks:
        new = {c: block[c].to_numpy(np.int64) for c in columns}
        rows = new if held is None else {c: np.concatenate((held[c], new[c])) for c in columns}
        if not len(rows["key"]):
            continue
        head = np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["part"][1:] != rows["part"][:-1])))
        fresh = head | np.concatenate(([True], rows["node"][1:] != rows["node"][:-1]))
        rows, head = {c: v[fresh] for c, v in rows.items()}, head[fresh]
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, len(head)))
        longer = sizes > RUN
        longer[0] |= long
        end = heads[-1]  # the last run may go on
        long = bool(longer[-1])
        place = np.arange(len(head)) - np.repeat(heads, sizes)
        out = np.ones(len(head), bool) if long else np.arange(len(head)) < end
        held = {c: v[end : end + 1] if long else v[end:] for c, v in rows.items()}
        if out.any():
            yield {c: v[out] for c, v in rows.items()}, place[out], np.repeat(longer, sizes)[out]
    if held is not None and not long:
        n = len(held["key"])
        yield held, np.arange(n), np.full(n, n > RUN)


def _shared(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, part, node, n, at) in order to the rows that some other row of their key can match, with the first of those before them as pivot where linked, and all rows of
    long runs and of keys in parts, with the run's first row if it can match."""
    for rows, place, longer in _in_runs(blocks, _MEMBERS):
        partner, kept = np.full(len(place), -1), longer | (rows["part"] >= 0)
        for d in range(1, int(place[~longer].max(initial=0)) + 1):
            i = np.flatnonzero((place >= d) & ~longer)
            i = i[may_match(rows["n"][i], rows["at"][i], rows["n"][i - d], rows["at"][i - d])]
            partner[i], kept[i], kept[i - d] = i - d, True, True
        i = np.flatnonzero(longer & (place > 0))
        first = i - place[i]
        fits = may_match(rows["n"][i], rows["at"][i], rows["n"][first], rows["at"][first])
        partner[i[fits]] = first[fits]
        if kept.any():
            pivot = np.where(partner >= 0, rows["node"][partner], 0)[kept]
            yield pd.DataFrame({c: v[kept] for c, v in rows.items()} | {"pivot": pivot, "linked": partner[kept] >= 0, "long": longer[kept] | (rows["part"][kept] >= 0)})


def _open(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, part, node, n, at, label) in order to all pairs (node, pivot) of a key that can match and are not connected yet."""
    for rows, place, _ in _in_runs(blocks, (*_MEMBERS, "label")):
        for d in range(1, int(place.max(initial=0)) + 1):
            i = np.flatnonzero(place >= d)
            i = i[(rows["label"][i] != rows["label"][i - d]) & may_match(rows["n"][i], rows["at"][i], rows["n"][i - d], rows["at"][i - d])]
            if len(i):
                yield pd.DataFrame({"node": rows["node"][i], "pivot": rows["node"][i - d]})


@tidy
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, the smallest doc_id reachable by links of similarity LEAST / 100 or more.

    Null, empty and blank texts have no shingles and no links: their component is their own id. A null doc_id is never a component_id unless no row of
    the component has another. Repeated rows stay; an empty table gives an empty result; other columns are ignored. Shingles are told
    apart by 64-bit hashes, similarity is exact over 56 bits of them.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(_order(docs))

    @F.pandas_udf("n long, node long, keys array<long>, parts array<short>")
    def prefixes(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        (often, parts), known, seen = order.value, _Hashes(), set()
        for block in blocks:
            out = []
            for text in block:
                hashes = shingle_set(text, known)
                numbers = in_order(hashes, often)
                node = xxhash.xxh64_intdigest(numbers.tobytes()) - (1 << 63) if len(numbers) else 0
                if node in seen or not len(numbers):  # a partition sends a set once
                    out.append((len(hashes), node, None, None))
                    continue
                if len(seen) > _KNOWN:
                    seen.clear()
                seen.add(node)
                first = numbers[: prefix_size(len(numbers))]
                dealt = parts[(first << np.uint64(8)) >> np.uint64(64 - COUNTERS)].astype(np.int64)
                out.append((len(hashes), node, first.view(np.int64), np.where(dealt > 0, node % np.maximum(dealt, 1), -1).astype(np.int16)))
            yield pd.DataFrame(out, columns=["n", "node", "keys", "parts"])
        give_back()

    prints = durable(_identified(docs).select("doc_id", "none", "id", "print", prefixes("text").alias("p")).select("doc_id", "none", "id", "print", "p.*"))
    nodes = durable(prints.where("n > 0").groupBy("node").agg(F.min(F.struct("none", "id", "print")).alias("first")))
    keyed = prints.where("keys is not null").select("node", "n", F.posexplode(F.arrays_zip("keys", "parts")).alias("at", "k")).select(F.col("k.keys").alias("key"), F.col("k.parts").cast("long").alias("part"), "node", "n", F.col("at").cast("long").alias("at"))
    order_of = ["key", "part", "node"]
    members = durable(keyed.repartition("key", "part").sortWithinPartitions(order_of).mapInPandas(_shared, "key long, part long, node long, n long, at long, pivot long, linked boolean, long boolean"))
    firsts = members.where("part >= 0").groupBy("key", "part").agg(F.min("node").alias("node"))
    tops = firsts.join(firsts.groupBy("key").agg(F.min("node").alias("pivot")), "key").where("node <> pivot").select("node", "pivot")
    pairs = durable(members.where("linked").select("node", "pivot").unionByName(tops).distinct())

    @F.pandas_udf("binary")
    def packed(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (often, _), known = order.value, _Hashes()
        for block in blocks:
            yield pd.Series([in_order(shingle_set(t, known), often).tobytes() for t in block], dtype=object)
        give_back()

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first.*")
    # both joins shuffle at every size: a table that is broadcast while it is small would hide what a large one costs
    texts = _identified(docs).join(wanted.hint("merge"), ["none", "id", "print"]).dropDuplicates(["none", "id", "print"])
    shingles = durable(texts.select("node", packed("text").alias("shingles"))).hint("merge")
    found = durable(_star_links(pairs, shingles, _with_pivot))
    labels = _labelled(members.select("node").distinct(), found)
    named = members.join(labels, "node")
    open_ = durable(named.where("not long").select(*_MEMBERS, "label").repartition("key", "part").sortWithinPartitions(order_of).mapInPandas(_open, "node long, pivot long").distinct())
    more = durable(_star_links(open_, shingles, _with_pivot))
    rest = _rest_links(named.where("long").select("node", "key", "label"), shingles, _compare)
    links = durable(found.unionByName(more).unionByName(rest))
    roots = components(links)
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("least"))
    classes = durable(named.join(smallest, "root").select("node", F.when(~F.col("least.none"), F.col("least.id")).alias("component_id")))
    forget(nodes, members, pairs, shingles, found, labels, open_, more, rest, links, roots)
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return prints.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return near_duplicates(docs)


def sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
t AS (SELECT row_number() OVER () AS t, text, regexp_extract_all(text, '[^ 	-
]+') AS w FROM (SELECT DISTINCT text FROM d)),
s AS (SELECT DISTINCT t, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i:i + {SIZE - 1}], ' ')) END) AS shingle FROM t),
n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
shared AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.t <> b.t GROUP BY ALL),
links AS MATERIALIZED (SELECT shared.a, shared.b FROM shared JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE 100 * shared.n >= {LEAST} * (x.n + y.n - shared.n)),
reach AS (SELECT t AS a, t AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT r.a AS t, min(d.doc_id) AS component_id FROM reach r JOIN t ON t.t = r.b JOIN d USING (text) GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id FROM d JOIN t USING (text) LEFT JOIN n ON n.t = t.t LEFT JOIN least ON least.t = t.t
"""
