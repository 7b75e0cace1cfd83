"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Two first-order models over the characters of a token's alphabet, one trained on random strings, one on ordinary
identifiers and words, give each candidate, a run of 8 characters or more, the log-likelihood ratio of its
character transitions. Candidates above both a total and a per-character threshold are secrets. Hexadecimal
strings below the base rule's length read like parts of UUIDs to the models and are left alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
#: Candidates of the method: runs of this alphabet, this long.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents whose words train the model of ordinary strings, and strings that train each model.
TRAIN_DOCS, TRAIN_STRINGS = 2000, 20_000
#: Least log-likelihood ratio in all and for each character, in nats.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.35

_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def random_strings(n: int, seed: int = 11) -> list[str]:
    """Labelled samples of random strings: base64, base62, upper case with digits, and hexadecimal keys of usual lengths."""
    rnd = random.Random(seed)
    kinds = [ALPHABET[:62] + "+/", ALPHABET[:62], ALPHABET[:62] + "_-", ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef"]
    return ["".join(rnd.choices(kinds[i % len(kinds)], k=rnd.choice((20, 24, 32, 40)))) for i in range(n)]


#: Words of names in programs and paths, beside the corpus's own.
TECHNICAL = (
    "access account active address admin alpha amount android apache app application archive array assets async audio auth backend backup base batch beta binary bin block "
    "blog board body boolean bootstrap branch browser bucket buffer build bundle button bytes cache calendar call cart category channel chart check child class client clock cloud "
    "cluster code column command comment commit common compile component compose config connect console const container content context control cookie core count country cron "
    "current custom dashboard data database date debug default delete deploy deployment design desktop dev device dialog dictionary digest directory dist docker docs document domain "
    "download driver edit editor element email enable encode endpoint engine entity env error event example exception execute export express extension factory feature field file filter "
    "final find flag folder font footer form format frame framework function gateway generator git github global google graph grid group guest handler hash header height hidden history "
    "home hook host html http https icon image import include index info init input install instance int interface internal invoice item java javascript job join json kernel key kubernetes "
    "label lambda language last layer layout level lib library limit line link linux list listener load local location lock log login logger long loop mac main manager map markdown master "
    "match max media member memory menu merge message meta method metric middleware min mobile mode model modules monitor mount name native network next node note null number object offset "
    "online open option order org origin output owner package page panel param parent parse part password path payment pdf photo php pipeline platform player plugin point policy port post "
    "prefix press print private process product profile project promise protocol provider proxy public python query queue random read record redirect reference release remote render report "
    "request reset resource response rest result role root route router row rule run sample save scan schema scope screen script search section secret secure select send serial server service "
    "session set settings setup shell shop short show sign site size socket sort source spec sql src stage start state static status storage store stream string style submit summary super "
    "support sync system tab table tag target task template term test text theme thread time timeout title token tool total track transaction transfer type ubuntu unit update upload url user "
    "util valid value variable vendor version video view virtual visible watch web webpack width wiki window worker wrapper write www xml yaml year youtube zip zone"
).split()


def identifiers(words: list[str], n: int, seed: int = 12) -> list[str]:
    """Labelled samples of ordinary strings: words, and names, paths, slugs, numbered, dated and versioned names and addresses built of them, UUIDs, and rulers of one character."""
    rnd = random.Random(seed)
    words = sorted({w for w in words if w.isascii() and w.isalpha()}) or ["name", "value", "index", "count", "user", "page"]
    version = lambda: rnd.choice([f"v{rnd.randint(1, 20)}", f"v{rnd.randint(1, 9)}{rnd.choice(['beta', 'alpha', 'rc'])}{rnd.randint(1, 9)}", f"x{rnd.choice([64, 86])}_64", f"{rnd.randint(0, 20)}-{rnd.randint(0, 99)}-{rnd.randint(0, 99)}"])
    out = []
    for i in range(n):
        some = [rnd.choice(TECHNICAL if rnd.random() < 0.5 else words) for _ in range(rnd.randint(2, 5))]
        match i % 10:
            case 0:
                out.append("".join(some))
            case 1:
                out.append("_".join(some).lower())
            case 2:
                out.append(some[0].lower() + "".join(w.capitalize() for w in some[1:]))
            case 3:
                out.append("/".join(some) + f"/{rnd.randint(0, 9999)}")
            case 4:
                out.append("-".join(some).upper() + f"-{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}")
            case 5:
                out.append("-".join(some).lower() + f"-{version()}")
            case 6:
                out.append("_".join([some[0], version(), *some[1:]]).lower())
            case 7:
                h = f"{rnd.getrandbits(128):032x}"
                out.append(f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}")
            case 8:
                out.append("_".join(some).upper() if rnd.random() < 0.7 else rnd.choice("-=_+/ax0") * rnd.randint(8, 40))
            case _:
                out.append("".join(w.capitalize() for w in some) + str(rnd.randint(0, 99999)))
    return out


def fit(strings: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log-probabilities of each character of the alphabet after each other one."""
    counts = np.full((len(ALPHABET), len(ALPHABET)), smoothing)
    for s in strings:
        codes = [c for c in (_CODE[ord(x)] for x in s if ord(x) < 128) if c >= 0]
        for a, b in pairwise(codes):
            counts[a, b] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


def train(docs: DataFrame, n_docs: int = TRAIN_DOCS, n_strings: int = TRAIN_STRINGS) -> np.ndarray:
    """The ratio model: random strings against identifiers of the words of at most `n_docs` documents, chosen by a hash of their ids."""
    total = max(1, docs.count())
    share = min(1.0, n_docs / total)
    chosen = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    words = chosen.select(F.explode(F.split(F.regexp_replace(F.col("text").cast("string"), "[^A-Za-z]+", " "), " ")).alias("w")).where("length(w) between 2 and 24").distinct()
    ordinary = sorted(r["w"] for r in words.orderBy(F.xxhash64("w")).limit(n_strings).collect())
    return fit(random_strings(n_strings)) - fit([*identifiers(ordinary, n_strings), *ordinary])


def ratio(model: np.ndarray, s: str) -> float:
    """Log-likelihood ratio of a string of the alphabet."""
    codes = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
    return float(model[codes[:-1], codes[1:]].sum())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    spans = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(k in raw for k in (b"passw", b"secret", b"token", b"api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def markov_spans(text: str, model: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that read like random strings and touch no base span; both come in order, so each is looked at once."""
    spans, at, reach = [], 0, -1  # reach: the furthest end of the base spans that start before the candidate ends
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][2])
            at += 1
        s = m.group()
        if reach <= m.start() and (r := ratio(model, s)) >= LEAST_TOTAL and r >= LEAST_EACH * len(s):
            spans.append((m.start(), 3, m.end()))
    return spans


def scan(text: Column | str, model: np.ndarray) -> Column:
    """struct<n_assign, n_access, n_hex, n_markov, base_sha256, spans> of a text column; offsets are code points, end exclusive."""
    line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
    def found(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in blocks:
            rows = []
            for text in s:
                text = text or ""
                base = base_spans(text)
                more = markov_spans(text, model, base)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, len(more), hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + more))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return found(text)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and n_markov.

    Null and empty texts have no spans and the digest of an empty string; repeated rows and null ids stay;
    other columns are ignored; an empty table gives an empty result. The model is trained on a bounded sample
    (TRAIN_DOCS, TRAIN_STRINGS); every text is scanned whole.
    """
    model = train(docs)
    return docs.select("doc_id", scan(F.col("text").cast("string"), model).alias("s")).select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans", "s.n_markov")
