"""How the sources of a language differ in their terms: mergeable radix tries.

A partition counts its terms in byte tries, one for a language, whose leaves hold the documents with the term and a counter for each
source. A trie that has grown large is emitted, leaf by leaf in UTF-8 order, and started anew. Leaves are shuffled by ranges of
their prefixes; each range merges the leaves that meet in a trie of its own, and lets go of what the sorted stream has passed.
The merged terms are traversed once more in UTF-8 order: differences of every two sources add up, and for each source
the terms that lead are kept in a list of fixed length whose ties the order of the traversal decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, give_back, tidy

#: Documents of a language that a kept term is in, the smoothing count, the unit of a share, terms given for a source.
LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Distinct (source, term) counters of a partition until its tries are emitted, bytes of text split at once, leaves of a batch, terms of a dict in a trie.
COUNTERS, SLICE, BATCH, FEW = 1 << 20, 1 << 20, 1 << 13, 1 << 10
#: Rows whose texts are taken out of a batch at once.
ROWS = 256
#: Sources compared with all others in one task; a task holds that many times the sources of a language, 8 bytes each.
SOURCES = 256
#: Numbers of a block of terms times sources.
CELLS = 1 << 18

#: Bytes of a term stay, A-Z lower-cased; all others separate terms.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LEAVES = "lang string, term binary, docs long, sources array<string>, counts array<long>"


def words(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_TABLE).split()


def slices(data: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text of any length, some at a time."""
    if len(data) <= size:
        yield words(data)
        return
    data, at = data.translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Node:
    """An inner node: the bytes of its edge, the leaf of the term that ends here, and by the next byte a node or a dict of what follows that byte and its leaf."""

    __slots__ = ("label", "leaf", "children")

    def __init__(self, label: bytes) -> None:
        self.label, self.leaf, self.children = label, None, {}


def count_in(leaf: list, source: str, n: int) -> None:
    """Add occurrences to a leaf: none yet is None, one source's are a pair, and several sources' a dict, as most terms have one source."""
    held = leaf[1]
    if held is None:
        leaf[1] = (source, n)
    elif type(held) is dict:
        held[source] = held.get(source, 0) + n
    else:
        leaf[1] = {held[0]: held[1]}
        leaf[1][source] = leaf[1].get(source, 0) + n


def counts_of(leaf: list) -> dict[str, int]:
    held = leaf[1]
    return {} if held is None else held if type(held) is dict else {held[0]: held[1]}


class RadixTrie:
    """Terms by their bytes, with edges of several bytes, and unordered dicts for subtries of few terms. A term's leaf is [documents, occurrences by source], see count()."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def leaf(self, term: bytes) -> list:
        """The leaf of `term`, an empty one if it is new."""
        above, byte, node, at = None, 0, self.root, 0
        while type(node) is Node:
            if node.label and not term.startswith(node.label, at):
                node = above.children[byte] = _split(node, _common(node.label, term[at:]))
            at += len(node.label)
            if at == len(term):
                if node.leaf is None:
                    node.leaf = [0, None]
                    self.size += 1
                return node.leaf
            above, byte = node, term[at]
            node = above.children.get(byte)
            if node is None:
                node = above.children[byte] = {}
            at += 1
        rest = term[at:]
        found = node.get(rest)
        if found is None:
            found = node[rest] = [0, None]
            self.size += 1
            if len(node) > FEW:
                above.children[byte] = _grown(node)
        return found

    def add(self, term: bytes, source: str, count: int, docs: int = 0) -> None:
        leaf = self.leaf(term)
        leaf[0] += docs
        count_in(leaf, source, count)

    def merge(self, other: RadixTrie) -> None:
        for term, found in other.walk():
            leaf = self.leaf(term)
            leaf[0] += found[0]
            for source, n in counts_of(found).items():
                count_in(leaf, source, n)

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """Terms and leaves by bytes, ascending: the order of their code points too."""
        stack: list[tuple[bytes, Node | dict]] = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is dict:
                for rest in sorted(node):
                    yield prefix + rest, node[rest]
                continue
            prefix += node.label
            if node.leaf is not None:
                yield prefix, node.leaf
            stack.extend((prefix + bytes((b,)), node.children[b]) for b in sorted(node.children, reverse=True))


def _common(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _split(node: Node, at: int) -> Node:
    """A node over the first `at` bytes of `node`'s label, with node below it."""
    upper = Node(node.label[:at])
    upper.children[node.label[at]] = node
    node.label = node.label[at + 1 :]
    return upper


def _grown(rests: dict[bytes, list]) -> Node:
    """A node for a dict of many terms: what they share is its edge."""
    shared = _common(min(rests), max(rests))
    node = Node(next(iter(rests))[:shared])
    for rest, leaf in rests.items():
        if len(rest) == shared:
            node.leaf = leaf
        else:
            node.children.setdefault(rest[shared], {})[rest[shared + 1 :]] = leaf
    return node


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Leaves (lang, term, leaf) as Arrow batches of _LEAVES."""
    langs, terms, docs, sources, counts, ends = [], [], [], [], [], [0]

    def batch() -> pa.RecordBatch:
        at = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(values, kind)) for values, kind in ((sources, pa.string()), (counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(docs, pa.int64()), *lists], names=["lang", "term", "docs", "sources", "counts"])

    for lang, term, leaf in rows:
        held = leaf[1]
        langs.append(lang)
        terms.append(term)
        docs.append(leaf[0])
        if type(held) is tuple:
            sources.append(held[0])
            counts.append(held[1])
        elif held:
            sources.extend(held)
            counts.extend(held.values())
        ends.append(len(sources))
        if len(terms) >= BATCH:
            yield batch()
            langs, terms, docs, sources, counts, ends = [], [], [], [], [], [0]
    if terms:
        yield batch()


def _emptied(terms: dict, docs: dict) -> Iterator[tuple]:
    """The counters as tries, one language after the other, leaf by leaf; the counters are empty after that."""
    for lang in sorted(docs):
        trie, leaves = RadixTrie(), {}
        for term, n in docs.pop(lang).items():
            leaves[term] = leaf = trie.leaf(term)
            leaf[0] = n
        for key in sorted(k for k in terms if k[0] == lang):
            for term, n in terms.pop(key).items():
                count_in(leaves[term], key[1], n)
        for term, leaf in trie.walk():
            yield lang, term, leaf


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the tries of a partition's rows (lang, source, text)."""
    terms: dict[tuple[str, str], Counter] = {}
    docs: dict[str, Counter] = {}
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if not data:
                    continue
                group, seen = terms.setdefault((lang, source), Counter()), set()
                for some in slices(data):
                    group.update(some)
                    seen.update(some)
                docs.setdefault(lang, Counter()).update(seen)
                size += len(data)
            if size >= SLICE and sum(map(len, terms.values())) >= COUNTERS:
                yield from _batches(_emptied(terms, docs))
                give_back()
                size = 0
    yield from _batches(_emptied(terms, docs))
    give_back()


def _merge(least: int):
    """Leaves in (lang, term) order to merged leaves in that order, those in `least` documents or more, with the range they were merged in."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lang, trie = None, RadixTrie()
        for batch in map(_mergeable, batches):
            last = None
            for here, term, docs, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != lang:
                    for found in trie.walk():
                        yield lang, *found
                    lang, trie = here, RadixTrie()
                leaf, last = trie.leaf(term), term
                leaf[0] += docs
                for source, n in zip(sources, counts, strict=True):
                    count_in(leaf, source, n)
            if last is not None:  # the stream has passed all but its last term
                kept = RadixTrie()
                for term, leaf in trie.walk():
                    if term == last:
                        kept.leaf(term)[:] = leaf
                    else:
                        yield lang, term, leaf
                trie = kept
        for found in trie.walk():
            yield lang, *found

    def _mergeable(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows whose term may be kept: enough documents in this batch, or it may go on in the next one or have begun in the last."""
        if batch.num_rows < 2:
            return batch
        lang, term, docs = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        new = np.concatenate(([True], pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)))
        heads = np.flatnonzero(new)
        enough = np.add.reduceat(docs, heads) >= least
        enough[[0, -1]] = True
        return batch.filter(pa.array(np.repeat(enough, np.diff(np.append(heads, len(new))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in _batches(row for row in merged(batches) if row[2][0] >= least):
            yield batch.append_column("range", pa.array([part] * batch.num_rows, pa.int64()))
        give_back()

    return run


class _Audit:
    """The sums and candidates of one language's sources `mine` over a range of terms, in the order they come."""

    def __init__(self, sources: list[str], totals: list[int], mine: list[bool], kept: int) -> None:
        self.place = {s: i for i, s in enumerate(sources)}
        self.sources, self.mine, self.kept = sources, np.flatnonzero(mine), kept
        self.type = np.int64 if sum(totals) + SMOOTH < np.iinfo(np.int64).max // SCALE else object  # exact at any size
        self.below = np.array([n + SMOOTH * kept for n in totals], self.type)
        self.all = sum(totals) + SMOOTH * kept
        self.sums = np.zeros((len(self.mine), len(sources)), self.type)
        self.best = [(np.empty(0, self.type), []) for _ in self.mine]
        self.block: list[tuple] = []
        self.most = max(1, CELLS // len(sources))

    def add(self, term: bytes, sources: list[str], counts: list[int]) -> None:
        self.block.append((term, sources, counts))
        if len(self.block) >= self.most:
            self.flush()

    def flush(self) -> None:
        if not self.block:
            return
        counts = np.zeros((len(self.block), len(self.sources)), self.type)
        for row, (_, sources, found) in enumerate(self.block):
            counts[row, [self.place[s] for s in sources]] = found
        share = 1 + SCALE * (counts + SMOOTH) // self.below
        lang = 1 + SCALE * (counts.sum(1) + SMOOTH) // self.all
        for k, i in enumerate(self.mine):
            self.sums[k] += np.abs(share - share[:, i : i + 1]).sum(0)
            lead = np.flatnonzero((counts[:, i] > 0) & (share[:, i] > lang))
            values, terms = self.best[k]
            values = np.concatenate((values, share[lead, i] - lang[lead]))
            terms = terms + [self.block[row][0] for row in lead]
            order = np.argsort(-values, kind="stable")[:TOP]  # equal values stay in the order of their terms
            self.best[k] = values[order], [terms[j] for j in order]
        self.block = []

    def rows(self) -> Iterator[tuple]:
        self.flush()
        for k, i in enumerate(self.mine):
            for j, other in enumerate(self.sources):
                if j != i:
                    yield self.sources[i], "pair", other, int(self.sums[k, j])
            for value, term in zip(*self.best[k], strict=True):
                yield self.sources[i], "term", term.decode("utf-8", "surrogatepass"), int(value)


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and candidates (lang, source, part, item, value) of a stream of tasks: first all sources of the language, then the terms of a range."""
    names = ["lang", "source", "part", "item", "value"]
    key, sources, audit = None, [], None

    def started() -> _Audit:
        return _Audit([s for s, *_ in sources], [n for _, n, *_ in sources], [m for *_, m, _ in sources], sources[0][3])

    def ended() -> Iterator[pa.RecordBatch]:
        if key is not None:
            rows = [(key[0], *row) for row in (audit or started()).rows()]
            for at in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + BATCH], strict=True), [pa.string()] * 4 + [pa.int64()], strict=True)], names=names)

    for batch in batches:
        for lang, range_, block, term, found, counts, source, total, mine, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, range_, block) != key:
                yield from ended()
                key, sources, audit = (lang, range_, block), [], None
            if term is None:
                sources.append((source, total, mine, kept))
            else:
                audit = audit or started()
                audit.add(term, found, counts)
    yield from ended()
    give_back()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


@tidy
def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, sources, counts, range): the terms in at least `least` documents of their language, by the bytes of lang and term
    within a range, and how often each source has them. Rows are documents, repeated ones too."""
    leaves = durable(docs.select(_text("lang"), _text("source"), _text("text")).mapInArrow(_count, _LEAVES))
    ranges = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    kept = durable(ranges.mapInArrow(_merge(least), f"{_LEAVES}, range long"))
    forget(leaves)
    return kept


@tidy
def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of `docs` (text, lang, source).

    Part `pair` has a row for each other source of the language, value being the sum of differences of their terms' shares, part `term`
    the terms, `top` at most, whose share is larger than the language's by most. Nulls count as empty strings; a source without terms, or a language without
    kept ones, has its rows too (all shares smoothed alike, or sums of zero). Ties go by UTF-8; an empty table gives an empty result;
    other columns are ignored. A task holds SOURCES sources times all of one language.
    """
    if not 0 < top <= TOP:
        raise ValueError(f"top must be 1 to {TOP}")
    terms = term_counts(docs, least)
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    found = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    groups = docs.select(_text("lang"), _text("source")).distinct().join(found, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = durable(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks")).select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    ranges = terms.select("lang", "range").unionByName(blocks.select("lang", F.lit(0).cast("long").alias("range"))).distinct()
    none = [F.lit(None).cast(t).alias(n) for n, t in (("term", "binary"), ("sources", "array<string>"), ("counts", "array<long>"))]
    own = F.pmod(F.xxhash64("source"), "blocks") == F.col("block")
    sides = groups.join(blocks, "lang").join(ranges, "lang").select("lang", "range", "block", *none, "source", "total", own.alias("mine"), "kept")
    stream = terms.join(blocks, "lang").select("lang", "range", "block", "term", "sources", "counts", *[F.lit(None).cast(t).alias(n) for n, t in (("source", "string"), ("total", "long"), ("mine", "boolean"), ("kept", "long"))])
    tasks = sides.unionByName(stream).repartition("lang", "range", "block").sortWithinPartitions("lang", "range", "block", "term", "source")
    sums = durable(tasks.mapInArrow(_audit, "lang string, source string, part string, item string, value long"))
    group = Window.partitionBy("lang", "source")
    pairs = sums.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    out = durable(ranked(pairs).unionByName(ranked(sums.where("part = 'term'")).where(F.col("rank") <= top)))
    forget(terms, groups, sums)
    return out.select("lang", "source", "part", "item", "value", "rank")


def op12(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return divergence(docs)


def sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"(1 + ({SCALE}::HUGEINT * (coalesce({{n}}, 0) + {SMOOTH})) // ({{total}} + {SMOOTH} * {{kept}}))::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{upper}', '{lower}') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total,
  coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang), 0) AS every, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS kept FROM groups g),
alls AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {share.format(n="c.n", total="s.total", kept="s.kept")} AS p, {share.format(n="a.n", total="s.every", kept="s.kept")} AS q
  FROM sizes s JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term LEFT JOIN alls a ON a.lang = s.lang AND a.term = k.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
