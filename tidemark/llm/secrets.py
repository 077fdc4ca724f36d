"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control for the strings around them.

A candidate is a run of 20 or more of ``[A-Za-z0-9+/_=-]``. Its encoding is the smallest of ENCODINGS that holds its
characters. These statistics are taken of it:

* chi-squared uniformity over the encoding's alphabet, in the form of its coincidences (pairs of equal characters, of which
  the statistic is a linear function at a given length); few coincidences mean a flat alphabet;
* the runs test about the alphabet's middle, and the serial correlation of neighbours, both as standard scores under
  randomness, and with them the kinds of its characters (digits, small and capital letters, signs): how often each occurs
  and how often neighbours differ. A candidate that fails one (``SCORE``) is a pattern, not a secret, and is not judged;
* surprise, the sum of -log of its characters' probabilities in the corpus.

Ordinary text is the null hypothesis: with the character counts of all documents, cut down to the encoding's alphabet, the
mean and variance of coincidences at the candidate's own length are exact, and Chernoff's bound holds for its surprise. The
p-value is twice the smaller of the two, whatever their dependence. Benjamini-Hochberg's rule then runs within each band of
lengths over all judged candidates of the corpus, from a histogram of p-values, so a few long strings are not judged at the
rate of many short ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import materialise

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
NAMES = ("password", "passwd", "secret", "token", "api")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_RANDOM = 6, 20, 24, 20
RATE = 0.01
SCORE = 3.0
BANDS = (24, 32, 40, 48, 64, 96)
BIN, TOP_BIN = 10, 3000

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from the smallest, in the order of their symbols.
ENCODINGS = [
    DIGITS,
    DIGITS + "abcdef",
    DIGITS + "ABCDEF",
    LETTERS,
    LETTERS.upper(),
    LETTERS.upper() + "234567",
    LETTERS + DIGITS,
    LETTERS.upper() + DIGITS,
    LETTERS.upper() + LETTERS + DIGITS,
    LETTERS.upper() + LETTERS + DIGITS + "+/_-=",
]


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


HEX, RANDOM = _mask(DIGITS + "abcdef"), _mask(ENCODINGS[-1])


def battery(token: str) -> tuple[int, int, float, float]:
    """``(encoding, coincidences, runs score, serial score)`` of a candidate."""
    enc = next(i for i, a in enumerate(ENCODINGS) if set(token) <= set(a))
    alphabet = {c: i for i, c in enumerate(ENCODINGS[enc])}
    x = np.array([alphabet[c] for c in token])
    counts = np.bincount(x)
    same = int((counts * (counts - 1) // 2).sum())
    n = len(x)
    high = x >= len(alphabet) / 2
    n1, n2 = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = (runs - mean) / math.sqrt(var) if var > 0 else 0.0
    else:
        z_runs = -math.inf
    y = x - x.mean()
    total = float((y * y).sum())
    z_serial = float((y[1:] * y[:-1]).sum()) / total * math.sqrt(n) if total else math.inf
    return enc, same, z_runs, z_serial


MIXED = ENCODINGS.index(LETTERS.upper() + LETTERS + DIGITS)
WORDS = re.compile(rb"[^A-Z0-9]*([A-Z][^A-Z0-9]+)*[A-Z]?")
KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((DIGITS, LETTERS, LETTERS.upper())):
    KIND[list(_chars.encode())] = _k + 1


def kinds_like_random(token: bytes, enc: int) -> bool:
    """Whether the kinds of characters are as frequent, and change as often, as in random strings of the encoding. Both
    letters without a digit and without two capitals in a row are words written together; fewer than one in a hundred random
    strings look so."""
    share = np.bincount(KIND[list(ENCODINGS[enc].encode())], minlength=4) / len(ENCODINGS[enc])
    if share.max() == 1:
        return True
    if enc >= MIXED and WORDS.fullmatch(token):
        return False
    x = KIND[np.frombuffer(token, np.uint8)]
    n, have = len(x), share > 0
    # chi-squared as a standard score, by Wilson and Hilferty
    chi, df = float((((np.bincount(x, minlength=4) - n * share) ** 2)[have] / (n * share[have])).sum()), int(have.sum()) - 1
    score = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p2, p3 = float((share**2).sum()), float((share**3).sum())
    changes = int((x[1:] != x[:-1]).sum())
    var = (n - 1) * p2 * (1 - p2) + 2 * (n - 2) * (p3 - p2 * p2)
    return score <= SCORE and abs(changes - (n - 1) * (1 - p2)) <= SCORE * math.sqrt(var)


STEPS = np.concatenate([np.arange(0.02, 1, 0.02), np.arange(1, 4, 0.25)])


def surprise_p(hist: np.ndarray, logs: np.ndarray, growth: np.ndarray) -> float:
    """Bound on how likely ordinary text of this length is as surprising; ``logs`` are of its characters' probabilities,
    ``growth`` the logarithms of their moments at ``STEPS``."""
    return math.exp(min(0.0, float((int(hist.sum()) * growth + STEPS * float(hist @ logs)).min())))


def p_value(n: int, same: int, share: np.ndarray) -> float:
    """How likely ordinary text of this length has so few coincidences; ``share`` are its characters' probabilities."""
    p2, p3 = float((share**2).sum()), float((share**3).sum())
    pairs = n * (n - 1) / 2
    mean = pairs * p2
    var = pairs * (p2 - p2 * p2) + n * (n - 1) * (n - 2) * (p3 - p2 * p2)
    if var <= 0:
        return 1.0
    return 0.5 * math.erfc(-(same + 0.5 - mean) / math.sqrt(2 * var))


SPANS = "array<struct<s:long,e:long,k:int>>"
CANDIDATES = "array<struct<s:long,e:long,n:int,enc:int,same:long,plain:boolean,hist:array<int>>>"
FOUND = f"doc_id long, base {SPANS}, candidates {CANDIDATES}, counts array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32())]))
    cand = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("n", pa.int32()), ("enc", pa.int32()), ("same", pa.int64()), ("plain", pa.bool_()), ("hist", pa.list_(pa.int32()))]))
    for batch in batches:
        base: list[list] = [[] for _ in range(batch.num_rows)]
        maybe: list[list] = [[] for _ in range(batch.num_rows)]
        counts = np.zeros(256, np.int64)
        texts = batch.column(1)
        for lo, hi, data, offsets in _text.slices(texts):
            counts += np.bincount(data, minlength=256)
            raw = data.tobytes()
            lead = None
            found: list[tuple[int, int, int]] = []
            starts, ends = _text.runs(HEX[data], offsets)
            long = np.flatnonzero(ends - starts >= LEAST_HEX)
            found += [(int(starts[i]), int(ends[i]), 2) for i in long]
            starts, ends = _text.runs(RANDOM[data], offsets)
            long = np.flatnonzero(ends - starts >= LEAST_RANDOM)
            found += [(int(starts[i]), int(ends[i]), 3) for i in long]
            if found:
                lead = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            for a, b, kind in found:
                r = int(np.searchsorted(offsets, a, "right")) - 1
                s, e = int(lead[a] - lead[offsets[r]]), int(lead[b] - lead[offsets[r]])
                if kind == 2:
                    base[lo + r].append((s, e, 2))
                else:
                    enc, same, z1, z2 = battery(raw[a:b].decode())
                    plain = abs(z1) <= SCORE and abs(z2) <= SCORE and kinds_like_random(raw[a:b], enc)
                    hist = np.bincount(data[a:b], minlength=256)[list(ENCODINGS[enc].encode())] if plain else None
                    maybe[lo + r].append((s, e, e - s, enc, same, plain, hist))
            lower = raw.lower()
            named = any(n.encode() in lower for n in NAMES)
            if named or b"AKIA" in raw:
                for r in range(hi - lo):
                    text = raw[offsets[r] : offsets[r + 1]]
                    low = lower[offsets[r] : offsets[r + 1]]
                    if named and any(n.encode() in low for n in NAMES):
                        base[lo + r] += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text.decode()) if len(m[2]) >= LEAST_VALUE]
                    if b"AKIA" in text:
                        base[lo + r] += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text.decode()) if m.end() - m.start() >= LEAST_ACCESS]
        for x in base:
            x.sort(key=lambda v: (v[0], v[2]))
        first = [counts.tolist(), *[None] * (batch.num_rows - 1)] if batch.num_rows else []
        names = ("s", "e", "k"), ("s", "e", "n", "enc", "same", "plain", "hist")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([[dict(zip(names[0], v, strict=True)) for v in x] for x in base], span),
                pa.array([[dict(zip(names[1], v, strict=True)) for v in x] for x in maybe], cand),
                pa.array(first, pa.list_(pa.int64())),
            ],
            names=["doc_id", "base", "candidates", "counts"],
        )


def _judge(counts: list[int]):
    """Keeps the candidates that are no patterns, with the bin of their p-value (-log10 p, in tenths, rounded down)."""
    chars = np.array(counts, np.float64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = []
        for alphabet in ENCODINGS:
            some = chars[np.frombuffer(alphabet.encode(), np.uint8)] + 0.5
            shares.append(some / some.sum())
        logs = [np.log(x) for x in shares]
        growth = [np.log(np.exp(np.multiply.outer(1 - STEPS, x)).sum(1)) for x in logs]
        known: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            out = []
            for row in batch.column(2).to_pylist():
                bins = []
                for c in row:
                    if not c["plain"]:
                        continue
                    key = (c["n"], c["same"], c["enc"])
                    if key not in known:
                        known[key] = p_value(c["n"], c["same"], shares[c["enc"]])
                    p = min(1.0, 2 * min(known[key], surprise_p(np.array(c["hist"]), logs[c["enc"]], growth[c["enc"]])))
                    place = min(TOP_BIN, int(-math.log10(p) * BIN)) if p > 0 else TOP_BIN
                    bins.append({"s": c["s"], "e": c["e"], "band": int(np.searchsorted(BANDS, c["n"], "right")), "bin": place})
                out.append(bins)
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("band", pa.int32()), ("bin", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "base", "judged"])

    return work


def thresholds(rows: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Benjamini-Hochberg from ``(band, bin, count)``: the least bin of each band that is a discovery. A bin's p-values
    count as its upper bound, so the rule is never looser than on single p-values."""
    out: dict[int, int] = {}
    for band in {b for b, _, _ in rows}:
        mine = sorted(((k, n) for b, k, n in rows if b == band), reverse=True)
        total, above = sum(n for _, n in mine), 0
        for k, n in mine:
            above += n
            if k and 10 ** (-k / BIN) <= rate * above / total:
                out[band] = k
    return out


def _digest(limits: dict[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, base, judged in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                spans = [(b["s"], b["k"], b["e"]) for b in base]
                own = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                for c in judged:
                    if c["bin"] >= limits.get(c["band"], TOP_BIN + 1) and not any(s < c["e"] and c["s"] < e for s, k, e in spans if k < 3):
                        spans.append((c["s"], 3, c["e"]))
                every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
                n = [sum(b["k"] == k for b in base) for k in range(3)]
                rows.append((doc_id, *n, len(spans) - len(base), hashlib.sha256(own.encode()).hexdigest(), every))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return work


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, n_random, base_sha256, spans (``kind:start:end``, code points).

    A random span is reported only where no base span lies. Null and empty texts have no spans; rows that repeat a document
    each count and each give a row; an empty table gives an empty result; other columns are not read. A very long text is scanned
    whole.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(base.mapInArrow(_scan, FOUND), "secrets")
    totals = found.where("counts is not null").select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    counts = [0] * 256
    for i, n in totals.collect():  # 256 rows
        counts[i] = n
    judged = found.mapInArrow(_judge(counts), f"doc_id long, base {SPANS}, judged array<struct<s:long,e:long,band:int,bin:int>>")
    bins = judged.select(F.explode("judged").alias("j")).groupBy("j.band", "j.bin").count()
    limits = thresholds([tuple(r) for r in bins.collect()], rate)  # at most 7 bands of 3001 bins
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return judged.mapInArrow(_digest(limits), schema).withColumnRenamed("doc_id", id_col)
