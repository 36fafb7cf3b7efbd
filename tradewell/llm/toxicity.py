"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import prepare, returning, saved

#: Labelled rows that the model is fitted on, at most, and tokens that it keeps, at most.
LABELS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Model:
    """Scores of toxic tokens, the score of any other token, and the calibration.

    ``spread`` is K of the extreme-value law P(best segment >= s) = 1 - exp(-K n exp(-s)) for a
    clean text of n tokens (its lambda is 1, as scores are log-odds). ``steps`` maps a text's
    evidence to the probability of label 1: (least evidence, probability), ascending.
    """

    weights: dict[str, float]
    other: float
    spread: float
    steps: tuple[tuple[float, float], ...]
    alpha: float = 0.05

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first token, past the last, score), in one pass.

        The classic scan keeps candidates with the sums before and after them. Only tokens with
        a positive score can begin or end a segment; what lies between is one multiplication.
        """
        weights = self.weights
        hits = [(i, w) for i, word in enumerate(words) if (w := weights.get(word)) is not None]
        held: list[tuple[int, int, float, float]] = []  # first, past, sum before, sum after
        total, at = 0.0, 0
        for i, weight in hits:
            total += self.other * (i - at)
            at = i + 1
            first, before, total = i, total, total + weight
            while True:
                k = len(held) - 1
                while k >= 0 and held[k][2] >= before:
                    k -= 1
                if k < 0 or held[k][3] >= total:
                    break
                first, before = held[k][0], held[k][2]
                del held[k:]
            held.append((first, i + 1, before, total))
        return [(a, b, after - before) for a, b, before, after in held]

    def tail(self, score: float, n: int) -> float:
        """Probability that the best segment of a clean text of n tokens scores so high."""
        return -math.expm1(-self.spread * n * math.exp(-score))

    def evidence(self, words: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The text's evidence and its significant segments (first, past, score, tail probability).

        The evidence adds -log(tail) of the significant segments, so several passages count more
        than the best one alone.
        """
        found = [(a, b, s, self.tail(s, len(words))) for a, b, s in self.segments(words)]
        found = [x for x in found if x[3] <= self.alpha]
        return sum(-math.log(max(p, 1e-300)) for *_, p in found), found

    def probability(self, evidence: float) -> float:
        out = self.steps[0][1]
        for least, p in self.steps:
            if evidence < least:
                break
            out = p
        return out


def monotone(bins: list[tuple[float, int, int]]) -> tuple[tuple[float, float], ...]:
    """Steps of the monotone least-squares fit to (evidence, rows, rows labelled 1), by pooling neighbours."""
    out: list[list[float]] = []
    for x, n, ones in sorted(bins):
        out.append([x, n, ones])
        while len(out) > 1 and out[-2][2] * out[-1][1] >= out[-1][2] * out[-2][1]:
            _, m, k = out.pop()
            out[-1][1] += m
            out[-1][2] += k
    return tuple((x, (ones + 0.1) / (n + 1)) for x, n, ones in out) or ((0.0, 0.0),)


def _count_words(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """(word, label, docs): rows (text, label) whose text holds the word; word null: distinct words, all told.

    Counted within a task first, so a frequent word is one row per task.
    """
    @returning
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words, labels = zip(*seen, strict=True) if seen else ((), ())
            made = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(list(seen.values()), pa.int64())],
                ["word", "label", "docs"])
            seen.clear()
            return made

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(words_of(text))
                seen[None, label] += len(words)
                for word in words if only is None else words & only:
                    seen[word, label] += 1
            if len(seen) > 500_000:
                yield out()
        yield out()

    made = rows.select("text", "label").mapInArrow(count, "word string, label int, docs long")
    return made.groupBy("word", "label").agg(F.sum("docs").alias("docs"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_labels: int = LABELS, prior: float = 500.0, least_z: float = 3.0,
) -> Model:
    """Learns the model from the labelled rows, at most ``most_labels`` of them, chosen by a hash of the id.

    A token's log-odds compare the labelled texts of either class that hold it, under Dirichlet
    priors proportional to its frequency among all texts of ``docs``; tokens count if they are
    toxic by ``least_z`` standard errors and in three toxic texts, however many there are: the labelled
    rows, which are bounded, bound them. Every other token has the log-odds of not being one of them, a little below 0, so segments end.

    Rows without a label, null ids and labels are left out; an id labelled twice counts as toxic
    if half of its labels are. Without toxic labels nothing scores.
    """
    spark = prepare(docs.sparkSession)
    context = spark.sparkContext
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label"))
    count = known.count()
    if count > most_labels:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * most_labels / count))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "id")  # its size is bounded by most_labels

    counts = saved(_count_words(rows, None), "word-counts")
    totals = {r["label"]: r["docs"] for r in counts.filter("word is null").collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    by_word = counts.filter("word is not null").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("c"))
    # Candidates: seen in several toxic texts, and more often than by chance under a flat prior.
    odds = F.log((F.col("t") + 0.5) / max(toxic, 1)) - F.log((F.col("c") + 0.5) / max(clean, 1))
    rough = by_word.filter("t >= 3").withColumn("z", odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    found = rough.filter(F.col("z") > least_z / 2).orderBy(F.col("z").desc(), "word").collect()
    candidates = {r["word"]: (r["t"], r["c"]) for r in found}

    shared = context.broadcast(set(candidates))
    everywhere = {r["word"]: r["docs"] for r in _count_words(
        texts.withColumn("label", F.lit(0)), shared.value).collect()}
    corpus = max(everywhere.pop(None, 0), 1)
    scored = []
    for word, (t, c) in candidates.items():
        share = prior * everywhere.get(word, 0) / corpus + 0.5
        delta = math.log((t + share) / (toxic + prior - t)) - math.log((c + share) / (clean + prior - c))
        z = delta / math.sqrt(1 / (t + share) + 1 / (c + share))
        if z >= least_z and delta > 0:
            scored.append((z, word, delta, t, c))
    scored = sorted(scored, reverse=True)
    weights = {word: delta for _, word, delta, *_ in scored}
    in_toxic = sum(t for *_, t, _ in scored) / max(toxic, 1)
    in_clean = sum(c for *_, c in scored) / max(clean, 1)
    other = min(-1e-4, math.log((1 - min(in_toxic, 0.9)) / (1 - min(in_clean, 0.5))))
    raw = Model(weights, other, 1.0, ((0.0, 0.0),))

    # K from the clean labelled texts: -log P(best < s) is K n exp(-s), summed over all of them.
    model = context.broadcast(raw)

    @returning
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                best.append((len(words), max((s for *_, s in model.value.segments(words)), default=0.0)))
            n, s = zip(*best, strict=True) if best else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(n, pa.int64()), pa.array(s, pa.float64())],
                                             ["label", "n", "s"])

    best = saved(rows.select("text", "label").mapInArrow(measure, "label int, n long, s double"), "best-segments")
    over, room = best.filter("label = 0").agg(
        F.sum(F.when(F.col("s") > 0, 1).otherwise(0)), F.sum(F.col("n"))).first()
    least = min(weights.values(), default=1.0)
    # Of clean texts, so many reach the smallest weight of a token at all.
    spread = ((over or 0) + 1) / ((room or 0) + 1) * math.exp(least)
    model = context.broadcast(Model(weights, other, spread, ((0.0, 0.0),)))

    @returning
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [int(min(1000, 10 * model.value.evidence(words_of(t))[0])) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.int64())], ["label", "x"])

    bins = rows.select("text", "label").mapInArrow(weigh, "label int, x long").groupBy("x").agg(
        F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    steps = monotone([(r["x"] / 10, r["n"], r["ones"]) for r in bins])
    return Model(weights, other, spread, steps)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with __score, __predicted and __passages, the significant segments in tokens.

    Column names that begin with two underscores are reserved.

    Each text is scored whole, where it is read. Null and empty texts have no evidence and get
    the probability that goes with none.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("from", pa.int64()), ("to", pa.int64()), ("score", pa.float64()), ("tail", pa.float64())])
    added = ["__score", "__predicted", "__passages"]

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for text in batch.column(text_col).to_pylist():
                evidence, segments = shared.value.evidence(words_of(text))
                scores.append(shared.value.probability(evidence))
                found.append([{"from": a, "to": b, "score": s, "tail": p} for a, b, s, p in segments])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array(found, pa.list_(passage))], [*batch.schema.names, *added])

    form = docs.limit(0).withColumns({
        "__score": F.lit(0.0), "__predicted": F.lit(0),
        "__passages": F.lit(None).cast("array<struct<from:long,to:long,score:double,tail:double>>")}).schema
    return docs.mapInArrow(run, form)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.filter(~held_out(F.col(id_col)))


def held_out(column):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
