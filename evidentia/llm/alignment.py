"""Two tokenizers aligned byte by byte, and how common their pairs of tokens are: a postings cogroup.

Both token streams of a text are cut into groups where tokens of both end; each token of one side is linked with each of the other in its
group. No token of either side spans the border between a word and white space, so groups are found once for each different word of a
worker's texts, with the white space before it, and a text's are those of its words put together.

A document gives one posting for each different pair of ids, with its multiplicity. Postings are shuffled by the pair, hot ids
of the first side dealt into parts; in sorted streams, which Spark spills, they meet the pair's count over all documents and whether it is its
id's highest. What a posting adds is combined by document before it is shuffled back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import durable, forget, give_back, tidy

#: Words remembered by a worker, characters of texts taken at once, documents of a batch, postings of an id in one part.
REMEMBERED, BLOCK, BATCH, PART = 1 << 19, 1 << 20, 1 << 10, 1 << 20
#: A word, or the space at a text's end, with the white space before it; marks after letters are one of their own. Where other white space occurs, words that it ends or begins are one.
_SPACE = "\t-\x0c "
_OTHER = "\r\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, *range(0x205F, 0x2065), 0x3000, 0xFEFF)))
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#$%&*"
_WORDS = re.compile(rf"[{_SPACE}]*(?:[{_LETTERS}]++(?![^{_SPACE}{_MARKS}])|[^{_SPACE}]+)|[{_SPACE}]+")
_WIDE_WORDS = re.compile(rf"(?:[{_SPACE}]*+[^{_SPACE}]++)+?(?<![{_OTHER}])|[\s\S]+")
_OTHER_SPACE = re.compile(f"[{_OTHER}]")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"


@lru_cache(maxsize=1)
def _unmarked() -> dict[str, int]:
    """Byte-level BPE's characters and their bytes: printable Latin-1 stands for itself, the other bytes for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Aligner:
    """Aligns the tokens of a byte-level BPE (a tokenizers file's text) with those of a piece model with byte fallback (its bytes)."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(model)
        marks = _unmarked()
        self.a_bytes = {i: bytes(marks[c] for c in t) if all(c in marks for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.texts_of = list(map(str, range(max(len(pieces), *self.a_bytes) + 1)))
        self.a_lengths, self.b_lengths = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_lengths[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        #: Words are told apart only if no piece goes beyond one.
        self.by_words = not any(len(p) > 1 and re.search(f"[^▁]▁|[{_SPACE}]|[{_LETTERS}][{_MARKS}]", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        """Words by their numbers: counts (n_a, n_b, n_groups, n_links; -1 where a side doesn't give the bytes back), the text of
        their groups, and from starts[i] on the pairs of ids as a << 32 | b, one for each link."""
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts, self.starts, self.pairs = np.empty((0, 4), np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time."""
        if not self.by_words:
            yield [text]
            return
        pattern = _WIDE_WORDS if _OTHER_SPACE.search(text) else _WORDS
        if len(text) <= BLOCK:
            yield pattern.findall(text)
            return
        found, size = [], 0
        for m in pattern.finditer(text):
            found.append(m[0])
            size += len(m[0])
            if size > BLOCK:
                yield found
                found, size = [], 0
        if found:
            yield found

    def learn(self, words: set[str]) -> None:
        """Align the words not known yet, all in one: the border of two words ends a group."""
        new = [w for w in words if w not in self.numbers]
        if not new:
            return
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        a = [e.ids for e in self.a.encode_batch(new, add_special_tokens=False)]
        # the piece model puts a space before what it encodes: a line feed, which joins nothing, keeps that space apart
        b = [ids[2:] for ids in self.b.encode(["\n" + w for w in new], num_threads=1)]
        good = np.ones(len(new), bool)
        if not b"".join(map(self.a_bytes.__getitem__, chain(*a))) == b"".join(data) == b"".join(map(self.b_bytes.__getitem__, chain(*b))):
            good[:] = [b"".join(map(self.a_bytes.__getitem__, x)) == d == b"".join(map(self.b_bytes.__getitem__, y)) for x, d, y in zip(a, data, b, strict=True)]
            a, b = ([x if ok else [] for x, ok in zip(side, good, strict=True)] for side in (a, b))
        sizes = np.array([len(d) if ok else 0 for d, ok in zip(data, good, strict=True)], np.int64)
        left, right = (np.fromiter(chain(*side), np.int64, sum(map(len, side))) for side in (a, b))
        a_ends, b_ends = np.cumsum(self.a_lengths[left]), np.cumsum(self.b_lengths[right])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cuts, b_cuts = (np.concatenate(([0], np.searchsorted(e, ends, "right"))) for e in (a_ends, b_ends))
        n_a, n_b = np.diff(a_cuts), np.diff(b_cuts)
        last = np.concatenate(([0], np.searchsorted(ends, np.cumsum(sizes), "right")))
        links = np.concatenate(([0], np.cumsum(n_a * n_b)))
        nth = np.arange(links[-1]) - np.repeat(links[:-1], n_a * n_b)
        wide = np.repeat(n_b, n_a * n_b)
        pairs = left[np.repeat(a_cuts[:-1], n_a * n_b) + nth // wide] << 32 | right[np.repeat(b_cuts[:-1], n_a * n_b) + nth % wide]
        counts = np.stack([np.array([*map(len, a)], np.int64), np.array([*map(len, b)], np.int64), np.diff(last), np.diff(links[last])], 1)
        counts[~good] = -1
        left, right = list(map(self.texts_of.__getitem__, left.tolist())), list(map(self.texts_of.__getitem__, right.tolist()))
        groups = [f"{left[i]}|{right[j]}" if x == i + 1 and y == j + 1 else f"{','.join(left[i:x])}|{','.join(right[j:y])}" for i, x, j, y in zip(a_cuts.tolist(), a_cuts[1:].tolist(), b_cuts.tolist(), b_cuts[1:].tolist(), strict=False)]
        at = last.tolist()
        self.texts += [";".join(groups[i:j]) for i, j in zip(at, at[1:], strict=False)]
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.counts, self.starts, self.pairs = np.concatenate((self.counts, counts)), np.concatenate((self.starts, links[last[1:]] + len(self.pairs))), np.concatenate((self.pairs, pairs))

    def align(self, lists: list[list[str]]) -> Iterator[tuple]:
        """(counts, text of the groups, pairs, multiplicities) of each list of words."""
        if len(self.texts) > REMEMBERED or len(self.pairs) > 16 * REMEMBERED:
            self.forget()
        self.learn(set().union(*lists))
        lengths = np.array([len(x) for x in lists], np.int64)
        words = np.fromiter(map(self.numbers.__getitem__, chain(*lists)), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        key = np.sort(np.repeat(np.arange(len(lists)), lengths) * len(self.texts) + words)
        heads = np.flatnonzero(np.concatenate((key[:1] >= 0, key[1:] != key[:-1])))
        times, (own, word) = np.diff(np.append(heads, len(key))), np.divmod(key[heads], len(self.texts) or 1)
        sizes = self.starts[word + 1] - self.starts[word]
        pairs = self.pairs[np.arange(int(sizes.sum())) + np.repeat(self.starts[word] - np.cumsum(sizes) + sizes, sizes)]
        own, times = np.repeat(own, sizes), np.repeat(times, sizes)
        order = np.lexsort((pairs, own))
        own, pairs, times = own[order], pairs[order], times[order]
        heads = np.flatnonzero(np.concatenate((own[:1] >= 0, (own[1:] != own[:-1]) | (pairs[1:] != pairs[:-1]))))
        times = np.add.reduceat(times, heads) if len(heads) else times
        own, pairs = own[heads], pairs[heads]
        cuts = np.searchsorted(own, np.arange(len(lists) + 1)).tolist()
        for k, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
            mine = words[end - n : end]
            counts = self.counts[mine]
            if n and counts[:, 0].min() < 0:
                yield None
            else:
                yield counts.sum(0), ";".join(map(self.texts.__getitem__, mine.tolist())), pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, digest of the groups, a ids, b ids, multiplicities) of each text, in blocks; a long text in several."""
        block, size = [], 0
        for text in texts:
            if text and len(text) > BLOCK:
                yield from self._short(block)
                block, size = [], 0
                yield self._long(text)
                continue
            block.append(text)
            size += len(text or "")
            if size > BLOCK:
                yield from self._short(block)
                block, size = [], 0
        yield from self._short(block)

    def _short(self, texts: list[str | None]) -> Iterator[tuple]:
        found = self.align([next(self.words(" " + t)) if t else [] for t in texts])
        for text, part in zip(texts, found, strict=True):
            yield _NONE if part is None or not text else _row(part[0], hashlib.sha256(part[1].encode()).hexdigest(), *part[2:])

    def _long(self, text: str) -> tuple:
        counts, digest = np.zeros(4, np.int64), hashlib.sha256()
        pairs, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for words in self.words(" " + text):
            part = next(self.align([words]))
            if part is None:
                return _NONE
            digest.update(((";" if counts[0] else "") + part[1]).encode())
            counts += part[0]
            pairs, same = np.unique(np.concatenate((pairs, part[2])), return_inverse=True)
            times = np.bincount(same, np.concatenate((times, part[3]))).astype(np.int64)
        return _row(counts, digest.hexdigest(), pairs, times)


_NONE = 0, 0, 0, 0, "", *[np.empty(0, np.int64)] * 3


def _row(counts: np.ndarray, digest: str, pairs: np.ndarray, times: np.ndarray) -> tuple:
    return *counts.tolist(), digest, pairs >> 32, pairs & 0xFFFFFFFF, times


def _lists(arrays: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "int32"), *arrays]).astype("int32")))


@lru_cache(maxsize=1)
def _aligner(spec: str, model: bytes) -> Aligner:
    return Aligner(spec, model)


@tidy
def align(docs: DataFrame, spec_path: str, model_path: str) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    spec_path is a tokenizers file of a byte-level BPE, model_path a piece model with byte fallback. Null and empty texts, and
    those whose bytes a side does not give back, have zeros and an empty digest. Rows are documents, repeated ones too: each counts. An empty table gives
    an empty result; other columns are ignored. The first side has one row a vocabulary entry at most, which is broadcast.
    """
    with open(spec_path, encoding="utf-8") as spec, open(model_path, "rb") as model:
        files = docs.sparkSession.sparkContext.broadcast((spec.read(), model.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, types = _aligner(*files.value), [pa.int64()] * 6 + [pa.string()] + [None] * 3
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                keys, ids, texts = (c.to_pylist() for c in batch.slice(at, BATCH).columns)
                columns = [keys, ids, *zip(*aligner.documents(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([_lists(c) if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _ROWS.split(", ")])
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = durable(rows.mapInArrow(run, _ROWS))
    postings = aligned.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.a", "p.b", "p.n")
    counts = durable(postings.groupBy("a", "b").agg(F.count("*").alias("docs")))
    sides = counts.groupBy("a").agg(F.max("docs").alias("most"), F.ceil(F.sum("docs") / PART).alias("parts"))
    pairs = counts.join(F.broadcast(sides), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    hot = F.broadcast(sides.where("parts > 1").select("a", "parts"))
    dealt = postings.join(hot, "a", "left").select("row", "a", "b", "n", F.coalesce(F.pmod(F.xxhash64("row"), "parts"), F.lit(0).cast("long")).alias("part"))
    met = dealt.join(pairs.hint("merge"), ["a", "b", "part"])
    gains = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    out = durable(aligned.drop("a", "b", "n").join(gains, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
    forget(aligned, counts)
    return out


def op13(docs: DataFrame, spec_path: str, model_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align(docs, spec_path, model_path)
