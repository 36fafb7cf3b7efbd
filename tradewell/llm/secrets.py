"""Secrets by patterns, and by a battery of randomness tests with control of false discoveries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import prepare, saved, texts_of

#: Kind, pattern, group that is measured and its least length. Fixed values.
BASE = (
    ("assign", re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)
#: Longer runs of hex digits only; the same spans as the pattern with its least length.
_HEX = re.compile("[0-9a-f]{24,}")
_KEYED = re.compile(r"[=:]")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_CANDIDATE_BYTES = re.compile(_CANDIDATE.pattern.encode())
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, smallest first: the first that holds all characters of a candidate is inferred.
ENCODINGS = (
    ("digits", _DIGITS),
    ("hexlower", _DIGITS + "abcdef"),
    ("hexupper", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("upper", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("letters", _UPPER + _LOWER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_SETS = [(name, {c: i for i, c in enumerate(chars)}) for name, chars in ENCODINGS]
#: How often letters occur in English, in hundredths of a percent from a to z. Fixed values.
ENGLISH = (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)
#: What counts as ordinary before any text is seen: letters, one in 25 a capital, some digits and marks; and
#: as how many seen characters it counts.
CAPITALS, DIGITS, MARKS, PRIOR = 0.04, 0.005, 0.002, 100_000.0


def _upper_chi2(x: float, df: int) -> float:
    """P(chi-squared > x) by the cube-root normal approximation, good for all degrees used here."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer(text: str) -> tuple[str, dict[str, int]] | None:
    """The smallest encoding whose alphabet holds the text."""
    seen = set(text.rstrip("="))
    return next(((name, places) for name, places in _SETS if seen <= places.keys()), None)


def ordinary(counts: np.ndarray) -> dict[str, tuple[np.ndarray, float, float]]:
    """Per encoding: each character's log ratio of uniform to ordinary text, and its mean and variance in ordinary text.

    ``counts`` are the bytes of all texts outside of candidates; ``PRIOR`` characters of the usual
    frequencies count besides them. Digits are taken to be uniform: of numbers, none is more ordinary
    than another, so a string of digits alone is never evidence.
    """
    usual = np.zeros(256)
    for letters, share in ((_LOWER, 1 - CAPITALS), (_UPPER, CAPITALS)):
        for c, n in zip(letters, ENGLISH, strict=True):
            usual[ord(c)] = share * n / sum(ENGLISH)
    for marks, share in ((_DIGITS, DIGITS), ("+/_-", MARKS)):
        for c in marks:
            usual[ord(c)] = share / len(marks)
    seen = counts + PRIOR * usual / usual.sum()
    digits = [ord(c) for c in _DIGITS]
    seen[digits] = seen[digits].mean()
    out = {}
    for name, chars in ENCODINGS:
        share = seen[[ord(c) for c in chars]]
        share = share / share.sum()
        ratio = -np.log(share * len(chars))
        mean = float(share @ ratio)
        out[name] = ratio, mean, float(share @ (ratio - mean) ** 2)
    return out


def evidence(text: str, places: dict[str, int], known: tuple[np.ndarray, float, float]) -> float:
    """The p-value of "ordinary text": how often ordinary characters would look as random as these, or more."""
    ratio, mean, variance = known
    x = ratio[[places[c] for c in text.rstrip("=")]]
    if variance < 1e-9:
        return 1.0
    return 0.5 * math.erfc((float(x.sum()) - len(x) * mean) / math.sqrt(2 * variance * len(x)))


def battery(text: str, places: dict[str, int]) -> float:
    """The p-value of "drawn uniformly from this alphabet": three tests, Bonferroni-combined.

    Chi-squared over the counts of all characters; the number of runs above and below the
    middle of the alphabet; the serial correlation of neighbouring characters.
    """
    x = np.array([places[c] for c in text.rstrip("=")], float)
    n, size = len(x), len(places)
    counts = np.bincount(x.astype(int), minlength=size)
    uniform = _upper_chi2(float(((counts - n / size) ** 2).sum() * size / n), size - 1)
    high = x >= size / 2
    one, two = int(high.sum()), int(n - high.sum())
    if one and two:
        mean = 2 * one * two / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    d = x - x.mean()
    spread = float(d @ d)
    serial = _two_sided((float(d[:-1] @ d[1:]) / spread + 1 / n) * math.sqrt(n)) if spread > 0 else 0.0
    return min(1.0, 3 * min(uniform, runs, serial))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The pattern matches, leftmost and not overlapping within a kind, as (start, end, kind)."""
    out = []
    if _KEYED.search(text):
        kind, pattern, group, least = BASE[0]
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        kind, pattern, group, least = BASE[1]
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def outside(text: str, found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The candidates of a text; of one that overlaps a base span, what remains outside of it."""
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        for a, b, _ in sorted(f for f in found if f[0] < m.end() and m.start() < f[1]):
            # A part may begin or end otherwise than a whole candidate, with "=".
            if part := _CANDIDATE.search(text, at, max(at, a)):
                yield part.span()
            at = max(at, b)
        if part := _CANDIDATE.search(text, at, max(at, m.end())):
            yield part.span()


def character_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each byte occurs in all texts outside of candidates; 256 numbers a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(256, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                held += np.bincount(np.frombuffer(_CANDIDATE_BYTES.sub(b" ", text), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int64()), pa.array(held)], ["byte", "n"])

    out = np.zeros(256)
    for byte, n in docs.select(F.col(text_col).cast("string")).mapInArrow(count, "byte long, n long").groupBy("byte").agg(
            F.sum("n")).collect():
        out[byte] = n
    return out


def thresholds(groups: dict[tuple[str, int], dict[int, int]], rate: float) -> dict[tuple[str, int], int]:
    """Per group the least bin that Benjamini and Hochberg's rule calls a discovery, from counts per bin.

    A bin k holds p-values of at most 10^(-k/20); all of a bin count as that.
    """
    out = {}
    for group, bins in groups.items():
        total, upto = sum(bins.values()), 0
        for place in sorted(bins, reverse=True):
            upto += bins[place]
            if 10 ** (-place / 20) <= rate * upto / total:
                out[group] = place
    return out


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, miss: float = 0.001,
) -> DataFrame:
    """(id, base, added, n_tested, n_random) of every row: secrets as lists of (start, end, kind) in code points.

    ``base`` are the matches of the fixed patterns. Outside of them every string of 16 or more
    characters of a known encoding is a candidate and is tested; of one that overlaps a base span, the
    rest is. ``added`` are the candidates that pass two rules:
    * the battery does not reject "drawn uniformly from the inferred alphabet" at ``miss`` (chi-squared over
      the characters, runs, serial correlation): one in 1/``miss`` random strings is lost here;
    * "ordinary text" is rejected (``evidence``, by the characters' frequencies in these texts) by Benjamini and
      Hochberg's rule at ``rate`` within each encoding and doubling of the length, over all candidates of the
      table: among the reported strings of a group, the expected share of ordinary ones is at most ``rate``, as
      far as ordinary strings are characters drawn at those frequencies. What length it takes
      follows from that, and differs by encoding.

    ``n_tested`` are the row's candidates, ``n_random`` those that the battery lets pass. P-values are counted
    in bins, so the rule needs a few thousand counts, not the candidates. Digits alone are never reported.
    Null and empty texts have no spans. Rows are told apart by position only: ids may repeat.
    """
    prepare(docs.sparkSession)
    order = [k for k, *_ in BASE] + [k for k, _ in ENCODINGS]
    known = ordinary(character_counts(docs, text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
        candidate = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                               ("stratum", pa.int32()), ("bin", pa.int32()), ("random", pa.bool_())])
        for batch in batches:
            base, more = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                found = base_spans(text)
                own = []
                for start, end in outside(text, found):
                    if got := infer(text[start:end]):
                        p = evidence(text[start:end], got[1], known[got[0]])
                        own.append({"start": start, "end": end, "kind": got[0], "stratum": (end - start).bit_length(),
                                    "bin": min(400, int(-20 * math.log10(max(p, 1e-20)))),
                                    "random": battery(text[start:end], got[1]) >= miss})
                found.sort(key=lambda s: (s[0], order.index(s[2])))
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                more.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(candidate))],
                ["id", "base", "more"])

    spans = "array<struct<start:long,end:long,kind:string>>"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"id {docs.schema[id_col].dataType.simpleString()}, base {spans}, "
              "more array<struct<start:long,end:long,kind:string,stratum:int,bin:int,random:boolean>>")
    found = saved(found, "secret-spans")
    counts = found.select(F.explode("more").alias("c")).groupBy("c.kind", "c.stratum", "c.bin").count().collect()
    groups: dict[tuple[str, int], dict[int, int]] = {}
    for kind, stratum, place, n in counts:
        groups.setdefault((kind, stratum), {})[place] = n
    limits = thresholds(groups, rate)
    lowest = F.create_map(*[F.lit(x) for (k, s), b in limits.items() for x in (f"{k}{s}", b)]) if limits else None

    def secret(c):
        if lowest is None:
            return F.lit(False)
        return c["random"] & F.coalesce(c["bin"] >= lowest[F.concat(c["kind"], c["stratum"].cast("string"))], F.lit(False))

    added = F.transform(F.filter("more", secret), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.select(
        F.col("id").alias(id_col), "base", added.alias("added"), F.size("more").cast("long").alias("n_tested"),
        F.size(F.filter("more", lambda c: c["random"])).cast("long").alias("n_random"))
