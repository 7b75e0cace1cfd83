"""Suffix-array dedup: repeats of at least LEAST bytes, from the interval tree of common prefixes.

A sparse enhanced suffix array does the work. Sampled positions (the leftmost smallest hash of a
GRAM-byte gram in every LEAST-byte string, so that equal strings are sampled alike) are the
suffixes; those with equal grams meet in one task with the bytes around them. There they are sorted, the
common prefixes of neighbours are scanned with a stack, and every interval of the tree is one
group of occurrences that share a right context. Within an interval the occurrences are told apart by
what stands to the left, the extension's length deciding, which gives the maximal repeats with all their
occurrences; all but an occurrence's earliest equals are removed.

Texts are written once as compressed blocks with their sampled positions; only grams (8 bytes for each 39
bytes of text), the context of repeated grams, and spans are shuffled beyond the blocks themselves.
Within a block equal contexts collapse first, so a line in a third of all documents arrives once a block.
A gram of HOT occurrences or more (a short line between ever different neighbours) isn't one group: its strings of LEAST bytes, which are the
intervals of that depth, are groups of their own, named by 128-bit hashes. Each block sends the oldest of each, and the oldest of a
string are found for SALT blocks at a time, then among those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, tidy

#: Bytes of a repeat and of a gram; bytes of text in a block, in an array pass, and in a bucket.
LEAST, GRAM = 100, 24
BLOCK, PASS, BUCKET = 8 << 20, 1 << 18, 16 << 20
#: Occurrences from which a gram is divided into strings; strings taken at once in a block; blocks whose oldest strings meet first.
HOT, STRINGS, SALT = 1 << 14, 1 << 18, 1 << 12
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every gram of `a`."""
    size = 1 << max(18, int(len(a)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * down[: len(a) - gram + 1])


def anchors(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of texts: (text number, position, first and last start of the strings it is sampled for, gram hash)."""
    parts: list[list[np.ndarray]] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PASS):
            size += len(texts[to])
            to += 1
        lens = np.array([len(t) for t in texts[at:to]], np.int64)
        if size > PASS + least:
            parts.append([np.full(len(p), at, np.int64) if i == 0 else p for i, p in enumerate(_long_anchors(texts[at], least, gram))])
        elif (lens >= least).any():
            a = np.frombuffer(b"".join(texts[at:to]), np.uint8)
            h = _gram_hashes(a, gram)
            m = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
            width, span = 1, least - gram + 1
            while width < span:
                step = min(width, span - width)
                m = np.minimum(m[:-step], m[step:])
                width += step
            pos = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
            begins = np.cumsum(lens) - lens
            valid = np.zeros(len(a) + 1, np.int64)  # starts of strings that end within their text
            long = lens >= least
            valid[begins[long]] += 1
            np.add.at(valid, begins[long] + lens[long] - least + 1, -1)
            pos[np.cumsum(valid)[: len(pos)] == 0] = -1
            change = np.flatnonzero(pos[1:] != pos[:-1]) + 1
            first = np.concatenate(([0], change))
            last = np.concatenate((change, [len(pos)])) - 1
            # equal neighbours of two texts never share a position, as positions lie within their strings
            ok = pos[first] >= 0
            first, last = first[ok], last[ok]
            p = pos[first]
            text = np.searchsorted(begins, p, side="right") - 1
            while len(text) and (empty := lens[text] == 0).any():
                text[empty] -= 1
            b = begins[text]
            parts.append([text + at, p - b, first - b, last - b, h[p]])
        at = to
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _long_anchors(text: bytes, least: int, gram: int) -> list[np.ndarray]:
    """anchors() of one text longer than a pass, slice by slice: a string's sample hangs on its own bytes only, so slices that share all
    but a byte of a string find the same ones, and a position found in two slices is one whose ranges follow each other."""
    found = []
    for begin in range(0, len(text) - least + 1, PASS):
        n, pos, first, last, h = anchors([text[begin : begin + PASS + least - 1]], least, gram)
        found.append([n, pos + begin, first + begin, last + begin, h])
    n, pos, first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate(([True], pos[1:] != pos[:-1]))
    ends = np.append(np.flatnonzero(new)[1:], len(pos)) - 1
    return [n[new], pos[new], first[new], last[ends], h[new]]


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def _left_extensions(members: list[int], lefts: list[bytes], ages: list[int]) -> dict[int, int]:
    """For each member the longest left context that it shares with an older one; without an older one it is missing."""
    members = sorted(members, key=lefts.__getitem__)
    best: dict[int, int] = {}
    for order in (1, -1):
        stack: list[list[int]] = []  # [member, common left context with the next one scanned], ages growing
        before = -1
        for i in members[::order]:
            if before >= 0:
                near = _common(lefts[before], lefts[i])
                for s in reversed(stack):
                    if s[1] <= near:
                        break
                    s[1] = near
            while stack and ages[stack[-1][0]] >= ages[i]:
                stack.pop()
            if stack:
                best[i] = max(best.get(i, 0), stack[-1][1])
            stack.append([i, 1 << 30])
            before = i
    return best


def repeats(rights: list[bytes], lefts: list[bytes], ages: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(suffix, left, right): the bytes from `left` before to `right` after that suffix are covered by strings of at least
    `least` bytes that an older suffix has too. lefts are reversed; of equal ages none is older."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (common prefix, first place) of open intervals
    for k in range(1, n + 1):
        near = _common(rights[order[k - 1]], rights[order[k]]) if k < n else 0
        first = k - 1
        while stack and stack[-1][0] > near:
            right, first = stack.pop()
            members = order[first:k]
            for i, left in _left_extensions(members, lefts, ages).items():
                if left + right >= least:
                    out.append((i, left, right))
        if near and (not stack or stack[-1][0] < near):
            stack.append((near, first))
    return out


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, start), ...]) of every maximal repeat of at least `least` bytes, with all its occurrences.

    The full enhanced suffix array of a few texts: for tests and small collections.
    """
    suffixes = sorted(((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t) - least + 1)))
    out, stack = [], []
    for k in range(1, len(suffixes) + 1):
        near = _common(suffixes[k - 1][0], suffixes[k][0]) if k < len(suffixes) else 0
        first = k - 1
        while stack and stack[-1][0] > near:
            length, first = stack.pop()
            places = [(n, i) for _, n, i in suffixes[first:k]]
            if length >= least and len({texts[n][i - 1] if i else (n, -1) for n, i in places}) > 1:
                out.append((length, sorted(places)))
        if near and (not stack or stack[-1][0] < near):
            stack.append((near, first))
    return sorted(out)


def _pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(b"".join([len(arrays).to_bytes(4, "little"), *[len(x.tobytes()).to_bytes(8, "little") for x in arrays], *[x.tobytes() for x in arrays]]))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    sizes = [int.from_bytes(raw[4 + 8 * i : 12 + 8 * i], "little") for i in range(n)]
    at, out = 4 + 8 * n, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


#: Element types of the packed arrays.
_IDS, _TEXTS, _ANCHORS, _STRINGS = ("<i8", "u1", "<i8"), ("u1",), ("<i4", "<i4", "u1", "u1"), ("<u8", "<i8", "<i4", "<i4")


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of documents (ids, lengths, texts, anchors), each at most BLOCK bytes or one document."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = 0
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            known, ids = batch["known"].to_numpy(), batch["doc_id"].to_numpy(np.int64)
            at = 0
            while at < len(raw):
                to, size = at, 0
                while to < len(raw) and (to == at or size + len(raw[to]) <= BLOCK):
                    size += len(raw[to])
                    to += 1
                lens = np.array([len(t) for t in raw[at:to]], np.int64)
                # a row without an id takes no part: nothing is removed from it, nothing because of it
                text, pos, first, last, _ = anchors([t if k else b"" for t, k in zip(raw[at:to], known[at:to], strict=True)])
                yield pd.DataFrame(
                    {
                        "block": [f"{TaskContext.get().partitionId()}-{number}"],
                        "n_bytes": [size],
                        "ids": [_pack(ids[at:to], known[at:to].astype("u1"), lens)],
                        "texts": [_pack(np.frombuffer(b"".join(raw[at:to]), np.uint8), level=6)],
                        "anchors": [_pack(text.astype("<i4"), pos.astype("<i4"), (pos - first).astype("u1"), (pos - last).astype("u1"))],
                    }
                )
                number += 1
                at = to

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(pack, "block string, n_bytes long, ids binary, texts binary, anchors binary")


def _places(row) -> tuple[np.ndarray, ...]:
    """A block's bytes, its texts' first bytes, ids, and its anchors with their gram hashes."""
    ids, known, lens = _unpack(row.ids, *_IDS)
    (a,) = _unpack(row.texts, *_TEXTS)
    text, pos, most, least = _unpack(row.anchors, *_ANCHORS)
    begins = np.cumsum(lens) - lens
    at = begins[text] + pos
    return a, begins, ids, known, lens, text, pos.astype(np.int64), most.astype(np.int64), least.astype(np.int64), at, _hashes_at(a, at)


def _hashes_at(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of the grams that start at some places of `a`."""
    up = _powers(1 << 18)[0][:GRAM]
    h = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 1 << 16):
        grams = a[at[i : i + (1 << 16), None] + np.arange(GRAM)].astype(np.uint64) + np.uint64(1)
        h[i : i + (1 << 16)] = _mixed((grams * up).sum(1, dtype=np.uint64))
    return h


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of runs of equal neighbours."""
    if not len(keys):
        return
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    yield from zip(keys[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True)


def repeated_grams(blocks: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(block, grams, hot): for each block its gram hashes that occur twice or more anywhere, and apart from them those of `hot` occurrences or more."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                grams, counts = np.unique(_places(row)[-1], return_counts=True)
                keys = (grams % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(keys, kind="stable")
                keys, grams, counts = keys[order], grams[order], counts[order]
                rows = []
                for k, a, b in _runs(keys):
                    twice = counts[a:b] > 1
                    rows.append((k, row.block, grams[a:b].tobytes(), np.packbits(twice).tobytes(), counts[a:b][twice].astype("<u4").tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "block", "grams", "twice", "counts"])

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8))[: len(g)] for t, g in zip(rows["twice"], grams, strict=True)])
        times = np.ones(len(twice), np.int64)
        times[twice > 0] = np.concatenate([np.frombuffer(c, "<u4") for c in rows["counts"]])
        owner = np.repeat(np.arange(len(rows)), list(map(len, grams)))
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        g = grams[order]
        heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        total = np.empty(len(g), np.int64)
        total[order] = np.repeat(np.add.reduceat(times[order], heads), np.diff(np.append(heads, len(g))))
        names, out = rows["block"].tolist(), []
        for o, a, b in _runs(owner):
            mine, n = grams[a:b], total[a:b]
            if (n > 1).any():
                out.append((names[o], mine[(n > 1) & (n < hot)].tobytes(), mine[n >= hot].tobytes()))
        return pd.DataFrame(out, columns=["block", "grams", "hot"])

    sent = blocks.mapInPandas(emit, "bucket long, block string, grams binary, twice binary, counts binary")
    found = sent.groupBy("bucket").applyInPandas(find, "block string, grams binary, hot binary")
    return found.groupBy("block").agg(F.collect_list("grams").alias("grams"), F.collect_list("hot").alias("hot"))


def _all_of(arrays: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in arrays]))


def _late(keys: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether an older string has the same key."""
    order = np.lexsort((starts, ids, keys[:, 1], keys[:, 0]))
    k = keys[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]).any(1)))[: len(k)]
    oldest = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    late = np.empty(len(k), bool)
    late[order] = (ids[order] != ids[oldest]) | (starts[order] != starts[oldest])
    return late


def _covered(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(text, start, end) of the runs that strings of LEAST bytes at these starts cover, start by start."""
    order = np.lexsort((starts, text))
    text, starts = text[order], starts[order]
    heads = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (starts[1:] > starts[:-1] + 1)))[: len(text)])
    ends = np.append(heads[1:], len(text))[: len(heads)] - 1
    return np.stack([text[heads], starts[heads], starts[ends] + LEAST], 1).astype("<i4")


def _strings(raw: bytes, begin: np.ndarray, count: np.ndarray, text: np.ndarray, ids: np.ndarray, starts: np.ndarray, grams: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, ids, texts, starts) of all strings of LEAST bytes of some contexts, at most about STRINGS at once, equal ones together."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    slices = -(-int(count.sum()) // STRINGS)
    part = (grams >> np.uint64(32)) % np.uint64(max(1, slices))
    for k in range(slices):
        some = np.flatnonzero(part == k)
        if not len(some):
            continue
        n = count[some]
        places = [i for b, c in zip(begin[some].tolist(), n.tolist(), strict=True) for i in range(b, b + c)]
        keys = np.frombuffer(b"".join([digest(raw[i : i + LEAST]) for i in places]), "<u8").reshape(-1, 2)
        step = np.arange(len(places)) - np.repeat(np.cumsum(n) - n, n)
        yield keys, np.repeat(ids[some], n), np.repeat(text[some], n), np.repeat(starts[some], n) + step


def contexts(blocks: DataFrame, grams: DataFrame, buckets: int, salts: int) -> DataFrame:
    """(bucket, salt, block, data, strings, spans): contexts of repeated grams, equal ones of a block collapsed to the oldest; the oldest strings
    of grams that are hot; and, in any bucket, spans of the collapsed."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, begins, ids, _, _, text, pos, most, least, at, h = _places(row)
                hot = _all_of(row.hot)
                pick = np.flatnonzero(np.isin(h, np.concatenate((_all_of(row.grams), hot))))
                pick = pick[np.lexsort((pos[pick], ids[text[pick]]))]
                raw = a.tobytes()
                starts, ends = (at[pick] - most[pick]).tolist(), (at[pick] - least[pick] + LEAST).tolist()
                oldest: dict[bytes, int] = {}
                ship, gone = [], []
                for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                    p = pick[i]
                    c = raw[s:e] + bytes((most[p],))
                    o = oldest.setdefault(c, p)
                    if o == p or (ids[text[o]], pos[o]) == (ids[text[p]], pos[p]):
                        ship.append(i)
                    else:
                        gone.append((text[p], pos[p] - most[p], pos[p] - least[p] + LEAST))
                del oldest
                own = int(hashlib.md5(row.block.encode()).hexdigest()[:8], 16)
                out, spans = [], [np.array(gone, "<i4").reshape(-1, 3)]
                ship = np.array(ship, np.int64)
                divided = np.isin(h[pick[ship]], hot)
                p = pick[ship[divided]]
                for keys, d, t, s in _strings(raw, at[p] - most[p], most[p] - least[p] + 1, text[p], ids[text[p]], pos[p] - most[p], h[p]):
                    late = _late(keys, d, s)
                    spans.append(_covered(t[late], s[late]))
                    some = np.flatnonzero(~late)
                    where = (keys[some, 0] % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(where, kind="stable")
                    some = some[order]
                    for k, lo, hi in _runs(where[order]):
                        few = some[lo:hi]
                        out.append((k, own % salts, row.block, b"", _pack(keys[few].reshape(-1), d[few].astype("<i8"), t[few].astype("<i4"), s[few].astype("<i4")), b""))
                ship = ship[~divided]
                keys = (h[pick[ship]] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(keys, kind="stable")
                ship = ship[order]
                for k, lo, hi in _runs(keys[order]):
                    some = ship[lo:hi]
                    p = pick[some]
                    body = np.frombuffer(b"".join([raw[starts[i] : ends[i]] for i in some.tolist()]), np.uint8)
                    data = _pack(ids[text[p]].astype("<i8"), text[p].astype("<i4"), pos[p].astype("<i4"), most[p].astype("u1"), least[p].astype("u1"), body)
                    out.append((k, 0, row.block, data, b"", b""))
                found = np.concatenate(spans)
                if len(found):
                    out.append((own % buckets, 0, row.block, b"", b"", found.tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "salt", "block", "data", "strings", "spans"])

    joined = blocks.join(grams, "block").select("block", "ids", "texts", "anchors", "grams", "hot")
    return joined.mapInPandas(emit, "bucket long, salt long, block string, data binary, strings binary, spans binary")


def _by_owner(names: list[str], owner: np.ndarray, spans: np.ndarray) -> list[tuple[str, bytes]]:
    order = np.argsort(owner, kind="stable")
    return [(names[o], spans[order[a:b]].tobytes()) for o, a, b in _runs(owner[order])]


def _string_spans(rows: pd.DataFrame, keep: bool) -> tuple[list[tuple[str, bytes]], list[tuple[str, bytes]]]:
    """Of rows with strings: (block, spans) of those with an older equal, and if they are to be kept, (block, strings) of the others."""
    parts = [_unpack(d, *_STRINGS) for d in rows["strings"]]
    keys, ids, text, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys = keys.reshape(-1, 2)
    owner = np.repeat(np.arange(len(rows)), [len(p[1]) for p in parts])
    names, late = rows["block"].tolist(), _late(keys, ids, starts)
    spans, kept = [], []
    for o, a, b in _runs(owner):
        gone = np.arange(a, b)[late[a:b]]
        if len(gone):
            spans.append((names[o], _covered(text[gone], starts[gone]).tobytes()))
        stay = np.arange(a, b)[~late[a:b]]
        if keep and len(stay):
            kept.append((names[o], _pack(keys[stay].reshape(-1), ids[stay], text[stay], starts[stay])))
    return spans, kept


def _bucket_spans(rows: pd.DataFrame, keep: bool) -> pd.DataFrame:
    """(bucket, block, strings, data, spans) of a bucket: what is covered by older strings; the oldest strings too if they are to meet others."""
    bucket = int(rows["bucket"].iloc[0])
    out = [(b, s) for b, s in zip(rows["block"], rows["spans"], strict=True) if len(s)]
    hot, kept = rows[[len(d) > 0 for d in rows["strings"]]], []
    if len(hot):
        spans, kept = _string_spans(hot, keep)
        out += spans
    rows = rows[[len(d) > 0 for d in rows["data"]]]
    if len(rows):
        kinds = ("<i8", "<i4", "<i4", "u1", "u1", "u1")
        parts = [_unpack(d, *kinds) for d in rows["data"]]
        ids, text, pos, most, least, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        owner = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
        size = most.astype(np.int64) - least + LEAST
        end = np.cumsum(size)
        h = _hashes_at(body, end - size + most)
        order = np.lexsort((pos, ids, h))
        raw, most = body.tobytes(), most.astype(np.int64)
        who, found = [], []
        for _, lo, hi in _runs(h[order]):
            if hi - lo < 2:
                continue
            some = order[lo:hi].tolist()
            rights, lefts, ages, before = [], [], [], None
            for i in some:
                e, m = int(end[i]), int(most[i])
                s = e - int(size[i])
                rights.append(raw[s + m : e])
                lefts.append(raw[s : s + m][::-1])
                key = (int(ids[i]), int(pos[i]))
                ages.append(len(ages) if key != before else ages[-1])
                before = key
            for i, left, right in repeats(rights, lefts, ages):
                i = some[i]
                who.append(owner[i])
                found.append((text[i], pos[i] - left, pos[i] + right))
        if found:
            out += _by_owner(rows["block"].tolist(), np.array(who), np.array(found, "<i4"))
    made = [(bucket, b, b"", s, b"") for b, s in kept] + [(bucket, b, b"", b"", s) for b, s in out]
    return pd.DataFrame(made, columns=["bucket", "block", "data", "strings", "spans"])


def _spans_of(sent: DataFrame, salts: int) -> DataFrame:
    """(block, spans) of all buckets; with several salts, strings meet by salt first and their oldest again."""
    made = "bucket long, block string, data binary, strings binary, spans binary"
    if salts > 1:
        sent = sent.groupBy("bucket", "salt").applyInPandas(lambda rows: _bucket_spans(rows, keep=True), made)
    return sent.groupBy("bucket").applyInPandas(lambda rows: _bucket_spans(rows, keep=False), made).groupBy("block").agg(F.collect_list("spans").alias("spans"))


@tidy
def dedup(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans, the removed runs as start:end of bytes.

    A byte goes if a LEAST-byte string over it also starts earlier: in a document with a smaller id, or earlier in
    the same one. Null texts are empty. A row with a null doc_id takes no part and keeps all. Rows of one
    doc_id with equal texts are the same document. Other columns are ignored; an empty table gives an empty result.
    """
    blocks = durable(blocks_of(docs))
    total, count = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    buckets, salts = max(64, -(-total // BUCKET)), max(1, -(-count // SALT))
    grams = repeated_grams(blocks.select("block", "ids", "texts", "anchors"), buckets, HOT)
    spans = _spans_of(contexts(blocks, grams, buckets, salts), salts)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, known, lens = _unpack(row.ids, *_IDS)
                raw = _unpack(row.texts, *_TEXTS)[0].tobytes()
                found = np.concatenate([np.frombuffer(s, "<i4").reshape(-1, 3) for s in row.spans]) if row.spans is not None and len(row.spans) else np.zeros((0, 3), "<i4")
                found = found[np.lexsort((found[:, 1], found[:, 0]))]
                of = {k: found[a:b, 1:].tolist() for k, a, b in _runs(found[:, 0])}
                out, at = [], 0
                for i, n in enumerate(lens.tolist()):
                    merged: list[list[int]] = []
                    for s, e in of.get(i, ()):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    doc, kept, last = raw[at : at + n], [], 0
                    for s, e in merged:
                        kept.append(doc[last:s])
                        last = e
                    digest = hashlib.sha256(b"".join([*kept, doc[last:]])).hexdigest()
                    out.append((int(ids[i]) if known[i] else None, n, sum(e - s for s, e in merged), len(merged), digest, ",".join(f"{s}:{e}" for s, e in merged)))
                    at += n
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    joined = blocks.select("block", "ids", "texts").join(spans, "block", "left")
    return joined.mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. Nulls, repeated rows, other columns and empty tables are treated as dedup() says."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def sql(docs: str = "documents", least: int = LEAST) -> str:
    """The same for DuckDB, of ids that are unique."""
    # strings of twice the length are named by hashing the names of their halves, up to the least length
    steps, have = ["h1 as (select doc_id, i, byte, n, hash(byte) as s from w)"], 1
    while have < least:
        step = min(have, least - have)
        steps.append(f"h{have + step} as (select doc_id, i, byte, n, hash(s, lead(s, {step}) over (partition by doc_id order by i)) as s from h{have})")
        have += step
    names = ",\n    ".join(steps)
    return f"""
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from {docs}),
    w as (select doc_id, n, unnest(range(n)) as i, unnest(bytes) as byte from (select doc_id, length(x) // 2 as n, regexp_extract_all(x, '..') as bytes from d)),
    {names},
    k as (select doc_id, i, byte, doc_id::hugeint * 4294967296 + i as place, case when i + {least} <= n then s end as s from h{least}),
    e as (select s, min(place) as earliest from k where s is not null group by s having count(*) > 1),
    f as (select doc_id, i, byte, coalesce(place > earliest, false) as late from k left join e using (s)),
    c as (select doc_id, i, byte, bool_or(late) over (partition by doc_id order by i rows between {least - 1} preceding and current row) as gone from f),
    r as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from c),
    g as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, string_agg(byte, '' order by i) filter (not gone) as kept from r group by doc_id)
    select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
    from d left join g on d.doc_id = g.doc_id"""
