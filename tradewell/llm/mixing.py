"""Mixing sources to target weights by systematic sampling, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewell.llm.common import prepare, saved

#: Documents of a numbering group; more than any group holds in the mean.
GROUP = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Column, most: float = 3.0) -> DataFrame:
    """(source, source_size, target): shares of the whole size by weight, at most ``most`` times a source.

    ``sizes`` has one row per source (source, source_size, place); ``weights`` is a column over
    ``place``. What a limit cuts off goes to the others by weight until none is above. That ends
    where every target is the smaller of its limit and weight * level, with one level for all:
    sources are taken by limit per weight, and the level is the first one below the next limit.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    shares = sizes.withColumn("weight", weights.cast("double")).withColumn(
        "cap", F.col("source_size").cast("double") * most)
    level = (F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(
        F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    shares = shares.withColumn("step", F.row_number().over(order)).withColumn("level", level)
    # The first source whose limit is not below the level sets it for itself and all after it.
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("step", "level")))
    shares = shares.withColumn("level", first.over(Window.partitionBy())["level"])
    return shares.select("source", "source_size", F.coalesce(
        F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    most: float = 3.0, seed: str = "mix",
) -> DataFrame:
    """All columns of ``docs`` plus __size, __source_size, __target and __copies of every row.

    A row's size is its number of words. Sources are numbered by code point, null last, and weigh
    1, 2, 3, 1 and so on; their targets follow from ``source_targets``. All rows of a source expect
    the same number of copies, target / source size. Ordered by size class and a hash of id and text,
    their expected copies are summed up; with one random offset for the source, a row is
    emitted once for every integer that its own share crosses. Size classes keep the taken size close to
    the target; md5 makes reruns agree.

    A row's place in its source is the sum of the counts of earlier classes, of earlier hash
    groups of its class, and its place in the group. A group holds about ``GROUP`` rows however
    large the source is and however many ids are null or equal; only rows that agree in id and text share
    a group in any number. Null texts and texts without words have
    size 0, and a source without words has target 0 and takes nothing. Rows that repeat an
    id and text are interchangeable. Column names that begin with two underscores are reserved.
    """
    prepare(docs.sparkSession)
    key = F.md5(F.concat_ws(
        "|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    bits = F.bin("__size")
    rows = docs.withColumn("__size", words_in(F.col(text_col))).withColumns({
        # Four classes for each doubling of the size.
        "__class": F.length(bits) * 4 + F.conv(F.rpad(F.substring(bits, 2, 2), 2, "0"), 2, 10).cast("int"),
        "__key": F.conv(F.substring(key, 1, 8), 16, 10).cast("long"),
    })
    total = docs.count()
    groups = 1 << max(0, (total // GROUP).bit_length())
    rows = rows.withColumn("__group", F.floor(F.col("__key") * groups / (1 << 32)))
    counts = saved(rows.groupBy(F.col(source_col).alias("source"), "__class", "__group").agg(
        F.count("*").alias("n"), F.sum("__size").alias("size")), "mix-counts")

    classes = counts.groupBy("source", "__class").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    sources = classes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    targets = source_targets(sources, F.col("place") % 3 + 1, most)
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10)
    targets = targets.withColumns({
        "__share": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0),
        "__offset": offset.cast("double") / float(1 << 32),
    })

    def earlier(*by: str):
        return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)

    starts = classes.withColumn("start", F.coalesce(F.sum("n").over(earlier("source", "__class")), F.lit(0)))
    starts = counts.withColumn("within", F.coalesce(
        F.sum("n").over(earlier("source", "__class", "__group")), F.lit(0))).join(
        starts.select(F.col("source").alias("s"), F.col("__class").alias("c"), "start"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("__class") == F.col("c")))
    starts = starts.join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).select(
        F.col("source").alias("__source"), F.col("__class").alias("__c"), F.col("__group").alias("__g"),
        (F.col("start") + F.col("within")).alias("__before"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), "__share", "__offset")

    place = Window.partitionBy(source_col, "__class", "__group").orderBy("__key", id_col, "__size")
    numbered = rows.withColumn("__row", F.row_number().over(place)).join(
        starts, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__class") == F.col("__c"))
        & (F.col("__group") == F.col("__g")))
    upto = F.col("__before") + F.col("__row")
    crossed = F.floor(upto * F.col("__share") + F.col("__offset")) - F.floor((upto - 1) * F.col("__share") + F.col("__offset"))
    return numbered.withColumn("__copies", F.least(crossed, F.lit(int(-(-most // 1))).cast("long"))).drop(
        "__class", "__key", "__group", "__row", "__source", "__c", "__g", "__before", "__share", "__offset")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``copies`` says, and as odd rows are treated there."""
    return copies(docs, **options).filter("__copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)
