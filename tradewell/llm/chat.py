"""Multi-party dialogues rendered from the perspective of each participant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewell.llm.common import prepare, saved

#: Turns per rendered row.
TURNS = 64


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, role, text, n): turns with null roles and texts filled in, numbered within their dialogue from 0.

    Sorted over the whole table by dialogue, turn, role and text. A turn's number is its place in
    its part of the order, plus what earlier parts hold of its dialogue; so a dialogue that holds
    a third of all turns is ordered by many tasks.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role")]
    parts = max(rows.rdd.getNumPartitions(), int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.withColumn("salt", F.xxhash64("text", F.rand(5)))
    dealt = saved(spread.repartitionByRange(parts, *order, "text", "salt").withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("part", "conv").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    within = Window.partitionBy("part", "conv").orderBy(*order[1:], "text", "salt")
    placed = dealt.withColumn("n", F.row_number().over(within) - 1)
    same = (placed["part"] == counts["part"]) & placed["conv"].eqNullSafe(counts["conv"])
    return placed.join(counts, same).select(
        placed["conv"], "role", "text", (F.col("n") + F.col("before")).alias("n"))


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", system: str = "system", per_row: int = TURNS,
) -> DataFrame:
    """(conv, speaker, chunk, n_turns, rendered, mask): every dialogue once per participant.

    For each participant, that is each role of the dialogue but ``system``, the whole dialogue is
    rendered with that speaker as the assistant and all others as users under their own
    names; system turns stay system turns:

        <|assistant|>\\ntext<|end|>\\n        <|user name=NAME|>\\ntext<|end|>\\n

    ``mask`` are the ranges [start, end) of ``rendered``, in code points, that count in training:
    the texts of the speaker with their end mark. A row renders ``per_row`` turns, so its size is
    bounded however long a dialogue is; the chunks of a perspective, joined in order, are the whole.

    Turns are ordered by turn (null first), then role, then text. A null role is "unknown", a null
    text is empty, a null dialogue id is a dialogue of its own. Repeated rows are turns of their own.
    A dialogue of system turns only has no participant and no row. In names, characters of
    the template (< > | and line ends) become "_".
    """
    prepare(turns.sparkSession)
    numbered = saved(numbered_turns(turns, conv_col, turn_col, role_col, text_col).withColumn(
        "chunk", F.floor(F.col("n") / per_row)), "numbered-turns")
    chunks = numbered.groupBy("conv", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    speakers = numbered.filter(F.col("role") != system).groupBy("conv", "role").count().select(
        F.col("conv").alias("of"), F.col("role").alias("speaker"))
    pairs = chunks.join(speakers, F.col("conv").eqNullSafe(F.col("of")))

    def head(t):
        name = F.regexp_replace(t["role"], r"[<>|\r\n]", "_")
        return F.when(t["role"] == system, F.lit("<|system|>\n")).when(
            t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).otherwise(
            F.concat(F.lit("<|user name="), name, F.lit("|>\n")))

    end = "<|end|>"
    parts = F.transform("turns", lambda t: F.struct(
        (t["role"] == F.col("speaker")).alias("own"), head(t).alias("head"), F.concat(t["text"], F.lit(end)).alias("body")))
    pairs = pairs.withColumn("parts", parts)
    sizes = F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + 1)
    pairs = pairs.withColumn("sizes", sizes)
    spans = F.transform("parts", lambda p, i: F.struct(
        p["own"].alias("own"),
        (F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b) + F.length(p["head"])).alias("start"),
        F.length(p["body"]).alias("size")))
    mask = F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(
        s["start"].alias("start"), (s["start"] + s["size"]).alias("end")))
    rendered = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))))
    return pairs.select(
        F.col("conv").alias(conv_col), "speaker", F.col("chunk").cast("long").alias("chunk"),
        F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))
