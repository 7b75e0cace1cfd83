"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a block of texts are put into a trie (held implicitly, as the sorted
word list with common-prefix lengths) and walked depth first. A node carries one state: the
last token of the encoding of its prefix. A prefix's encoding is its last token after the
encoding of the prefix that ends where that token starts, so every node needs the state of
its ancestors only, and prefixes shared by words are encoded once. A suffix is the last token
exactly if it is compatible with the token before it: no merge across their border would have
come before the merges that built the two. Word ends are tokens of their own kind (`</w>`);
they occur at the leaves only.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm._common import give_back

#: Largest tokenizer file that is broadcast.
MAX_FILE_BYTES = 64 << 20
#: Words whose encodings a worker remembers, and characters of text in a block.
CACHE_WORDS, BLOCK_CHARS = 150_000, 250_000
#: Automaton steps and token pairs that a worker remembers.
CACHE_STEPS = 800_000
END = "</w>"
#: The symbol of a word's end, after the 256 bytes.
_END = 256

#: The pre-tokenizer's pattern on lower-cased Latin-1 text, white space left out.
_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\x09-\x0d\x20\x85\xa0a-zA-Z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+"
)


_SPACE = re.compile(r"[\x09-\x0d\x20]")


def _byte_chars() -> list[str]:
    """The printable stand-in for every byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


def pieces(text: str) -> Iterator[str]:
    """A text cut before white space, which no token holds, about every BLOCK_CHARS characters."""
    at = 0
    while len(text) - at > BLOCK_CHARS and (border := _SPACE.search(text, at + BLOCK_CHARS)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


class TrieBpe:
    """Encoder and decoder for a byte-level BPE file with word ends, as the tokenizers library reads it."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self._spec, self._loaded = spec, None
        vocab = model["model"]["vocab"]
        chars = _byte_chars()
        self._byte_of = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self._utf8 = {i: s.encode() for i, s in self.strings.items()}
        self._merge: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[int, int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, new = vocab[left], vocab[right], vocab[left + right]
            self._merge.setdefault((a, b), rank)
            if new not in self._parts:
                self._parts[new], self._rank[new] = (a, b), rank
        patterns: dict[tuple[int, ...], int] = {}
        for s, i in vocab.items():
            final = s.endswith(END) and len(s) > len(END)
            body = s[: -len(END)] if final else s
            if (i in self._parts or len(body) == 1) and all(c in self._byte_of for c in body):
                patterns[(*(self._byte_of[c] for c in body), *[_END] * final)] = i
        self._build(patterns)
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}

    @property
    def _library(self):
        """The library's own tokenizer, for text beyond Latin-1; loaded when there is any."""
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_str(self._spec)
        return self._loaded

    def _build(self, patterns: dict[tuple[int, ...], int]) -> None:
        """An automaton over all tokens: its state knows every token that ends the text read so far, longest first."""
        step: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        children: list[list[tuple[int, int]]] = [[]]
        for symbols, token in patterns.items():
            at = 0
            for c in symbols:
                if (to := step.get(at << 9 | c)) is None:
                    to = step[at << 9 | c] = len(own)
                    own.append(None)
                    children.append([])
                    children[at].append((c, to))
                at = to
            own[at] = token, len(symbols) - (symbols[-1] == _END)
        fail, ends = [0] * len(own), [()] * len(own)
        queue = [0]
        for at in queue:
            for c, to in children[at]:
                queue.append(to)
                back = fail[at]
                while at and back and back << 9 | c not in step:
                    back = fail[back]
                fail[to] = step.get(back << 9 | c, 0) if at else 0
                ends[to] = ((own[to],) if own[to] else ()) + ends[fail[to]]
        self._edges, self._fail, self._ends = step, fail, ends
        self._step = dict(step)

    def _next(self, state: int, symbol: int) -> int:
        """The automaton's state after one more symbol; found by failure links once, then remembered."""
        at = state
        while (to := self._step.get(at << 9 | symbol)) is None and at:
            at = self._fail[at]
        to = self._step[state << 9 | symbol] = to or 0
        return to

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves `left right` as it is: undo the later merge again and again; none across may have come first."""
        a, b, limit, fits = left, right, 1 << 60, True
        while True:
            if self._merge.get((a, b), limit) < limit:
                fits = False
                break
            ra, rb = self._rank.get(a, -1), self._rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self._parts[a][1]
            else:  # of equal merges the left one comes first, so the right one is undone first
                limit, b = rb + 1, self._parts[b][0]
        self._fits[left << 20 | right] = fits
        return fits

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Token ids of distinct words, by one depth-first walk of their trie."""
        out: dict[bytes, list[int]] = {}
        step, ends, fits, compatible = self._step.get, self._ends, self._fits.get, self._compatible
        last, sizes, states, before = [-1], [0], [0], b""
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(n - 1, len(last) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], sizes[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, n + 2):  # the last round reads the word's end, which takes no byte
                symbol = word[end - 1] if end <= n else _END
                here = step(state << 9 | symbol, -1)
                state = here if here >= 0 else self._next(state, symbol)
                if end == n:  # the last byte belongs to a token with the word's end
                    continue
                at = min(end, n)
                for t, k in ends[state]:
                    if k == at:
                        break
                    left = last[at - k]
                    ok = fits(left << 20 | t)
                    if ok if ok is not None else compatible(left, t):
                        break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                if end < n:
                    last.append(t)
                    sizes.append(k)
                    states.append(state)
            ids, at = [t], n - k
            while at:
                ids.append(last[at])
                at -= sizes[at]
            out[word] = ids[::-1]
            before = word
        return out

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens' strings stand for themselves."""
        if self._split_special and "<" in text:
            out: list[str] = []
            for i, piece in enumerate(self._split_special.split(text)):
                out += [piece] if i % 2 else self._plain_words(piece)
            return out
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:  # the library's own rules for everything beyond Latin-1
            if not text:
                return []
            pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
            return [bytes(map(self._byte_of.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in pieces]
        return _LATIN.findall(text.lower())

    def _learn(self, new: set[str]) -> None:
        if len(self._cache) + len(new) > CACHE_WORDS:
            self._cache.clear()
        if len(self._step) > CACHE_STEPS:
            self._step = dict(self._edges)
        if len(self._fits) > CACHE_STEPS:
            self._fits.clear()
        plain = {w.encode("utf-8", "surrogateescape"): w for w in new if w not in self.special}
        for word, ids in self.encode_words(list(plain)).items():
            self._cache[plain[word]] = array("I", ids).tobytes()
        for w in new & self.special.keys():
            self._cache[w] = array("I", [self.special[w]]).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_CHARS):
                size += len(texts[to])
                to += 1
            split = [self.words(t) for t in texts[at:to]]
            all_words = set().union(*split)
            if new := all_words - self._cache.keys():
                self._learn(new if len(self._cache) + len(new) <= CACHE_WORDS else all_words)
            get = self._cache.__getitem__
            for words in split:
                yield b"".join(map(get, words))
            at = to

    def encode_long(self, text: str) -> Iterator[bytes]:
        """The ids of a text of any length, some at a time."""
        for piece in pieces(text):
            yield from self.encode([piece])

    def decode_bytes(self, ids: bytes) -> bytes:
        """The UTF-8 text of encode()'s ids, decoded as decode() does."""
        return b" ".join(map(self._utf8.__getitem__, memoryview(ids).cast("I")))

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False) of a file without a decoder: token strings with spaces between."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=4)
def _codec(spec: str) -> TrieBpe:
    return TrieBpe(spec)


def _spec(spark: SparkSession, path: str):
    """The tokenizer file, read on the driver and broadcast: executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(spec)


def encode(spark: SparkSession, path: str, text: Column | str) -> Column:
    """array<int> of token ids of `text` under the tokenizer file at `path`; null encodes as empty."""
    spec = _spec(spark, path)

    @F.pandas_udf("array<int>")
    def ids(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        codec = _codec(spec.value)
        for s in blocks:
            yield pd.Series([np.frombuffer(b"".join(codec.encode_long(t or "")), "<u4").astype("int32") for t in s], dtype=object)

    return ids(text)


def decode(spark: SparkSession, path: str, ids: Column | str) -> Column:
    """The text that `ids` (array<int>) decode to; special tokens stay, unknown ids go; null decodes as empty."""
    spec = _spec(spark, path)

    @F.pandas_udf("string")
    def text(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(spec.value)
        for s in blocks:
            yield pd.Series([codec.decode([] if x is None else list(x)) for x in s], dtype=object)

    return text(ids)


def _digested(codec: TrieBpe, parts: Iterable[bytes]) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids and of the decoded text of ids given in parts."""
    n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for part in parts:
        if part:
            ids.update(part)
            decoded.update((b" " if n else b"") + codec.decode_bytes(part))
            n += len(part) // 4
    return n, ids.hexdigest(), decoded.hexdigest()


def digests(spark: SparkSession, path: str, text: Column | str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of `text`, in one pass that keeps neither ids nor decoded text."""
    spec = _spec(spark, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(spec.value)
        for s in blocks:
            give_back()
            texts = [t or "" for t in s]
            short = codec.encode([t for t in texts if len(t) <= BLOCK_CHARS])
            rows = [_digested(codec, [next(short)] if len(t) <= BLOCK_CHARS else codec.encode_long(t)) for t in texts]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens; repeated rows and null ids stay as they are; other columns go;
    an empty table gives an empty result. Texts of any length are handled whole, in blocks of words.
    """
    spark = docs.sparkSession
    return docs.select("doc_id", digests(spark, path, F.col("text").cast("string")).alias("d")).select("doc_id", "d.*")
