"""Roll-ups along parent links, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.session import ensure_checkpoint_dir


def _has_loop(up: DataFrame) -> bool:
    """Whether some chain of (__child, __parent) links never ends, by following ever longer jumps."""
    jumps, length, total = up, 1, up.count()
    while length <= total and not jumps.isEmpty():
        further = jumps.select(F.col("__child").alias("__from"), F.col("__parent").alias("__to"))
        jumps = jumps.join(further, F.col("__parent") == F.col("__from")).select(
            "__child", F.col("__to").alias("__parent")).checkpoint()
        length *= 2
    return not jumps.isEmpty()


def rollup_to_ancestors(
    edges: DataFrame, amounts: DataFrame, node: str, parent: str, amount: str, look: int = 32
) -> DataFrame:
    """Own amount and amount of the whole subtree per node: node, ``propio``, ``acumulado``.

    ``edges`` has one row per node; a node that is its own parent, or has none, is a top.
    Each step moves the amounts one level up, summed per parent, until none is left, however
    deep the links are. After ``look`` steps they are checked for a loop, which is an error. The
    rows per step are at most the number of nodes. Steps are checkpointed: the lineage stays
    short and a lost executor costs one step.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    up = edges.filter(F.col(parent).isNotNull() & (F.col(node) != F.col(parent))).select(
        F.col(node).alias("__child"), F.col(parent).alias("__parent")
    )
    frontier = amounts.groupBy(F.col(node).alias("__node")).agg(F.sum(amount).alias("__amount"))
    frontier = frontier.checkpoint()
    levels = [frontier.withColumn("__own", F.col("__amount"))]
    while True:
        frontier = (
            frontier.join(up, F.col("__node") == F.col("__child"))
            .groupBy(F.col("__parent").alias("__node"))
            .agg(F.sum("__amount").cast(levels[0].schema["__amount"].dataType).alias("__amount"))
            .checkpoint()
        )
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("__own", F.lit(None).cast(levels[0].schema["__own"].dataType)))
        if len(levels) == look and _has_loop(up):
            raise ValueError("parent links form a loop")
    return reduce(DataFrame.unionByName, levels).groupBy(F.col("__node").alias(node)).agg(
        F.sum("__own").alias("propio"), F.sum("__amount").alias("acumulado")
    )


def by_depth(nodes: DataFrame, node: str, parent: str) -> list[DataFrame]:
    """The nodes of each level, tops first. A node that no top reaches is an error."""
    ensure_checkpoint_dir(nodes.sparkSession)
    level = nodes.filter(F.col(parent).isNull()).checkpoint()
    found, reached = [], 0
    while count := level.count():
        found.append(level)
        reached += count
        above = level.select(F.col(node).alias("__above"))
        level = nodes.join(above, F.col(parent) == F.col("__above"), "left_semi").checkpoint()
    if lost := nodes.count() - reached:
        raise ValueError(f"{lost} nodes have an unknown parent or form a loop")
    return found


def weighted_tree(
    nodes: DataFrame, leaves: DataFrame, node: str, parent: str, weight: str, value: str,
    by: list[str] | None = None,
) -> DataFrame:
    """Value of every node above the leaves: the weighted average of its children.

    ``nodes`` is the rule tree (node, parent, weight) of any depth. ``leaves`` has parent, weight,
    value and the columns ``by`` (such as role and period), each of which has a tree of its
    own; it may be large: it is reduced to one row per group and parent once. Children without a
    value do not count, nodes without valued children, or with none of any weight, have no row. Values have four decimals,
    as the result table stores them.
    """
    by = by or []

    def sums(children: DataFrame) -> DataFrame:
        return children.groupBy(*by, "__node").agg(F.sum("__wv").alias("__wv"), F.sum("__w").alias("__w"))

    ensure_checkpoint_dir(nodes.sparkSession)
    leaf_sums = sums(leaves.filter(F.col(value).isNotNull()).select(
        *by, F.col(parent).alias("__node"), (F.col(weight) * F.col(value)).alias("__wv"),
        F.col(weight).alias("__w"),
    )).checkpoint()  # every level needs it; the leaves are read once
    none = leaf_sums.limit(0).select(
        *by, F.lit(None).cast(nodes.schema[node].dataType).alias(node), F.lit(0).alias("nivel"),
        F.lit(None).cast("decimal(18,4)").alias(value),
    )
    totals, results = leaf_sums, [none]
    for depth, level in reversed(list(enumerate(by_depth(nodes, node, parent)))):
        done = level.select(
            F.col(node).alias("__id"), F.col(parent).alias("__up"), F.col(weight).alias("__own")
        ).join(totals, F.col("__id") == F.col("__node")).select(
            *by, "__id", "__up", "__own",
            # decimal division with sixteen digits, so that halves round as in the result table
            F.round(F.try_divide(F.col("__wv").cast("decimal(26,8)"), F.col("__w").cast("decimal(12,4)")), 4)
            .cast("decimal(18,4)").alias("__v"),
        ).filter("__v IS NOT NULL").checkpoint()
        results.append(done.select(
            *by, F.col("__id").alias(node), F.lit(depth).alias("nivel"), F.col("__v").alias(value)
        ))
        # A parent's children may be nodes of this level and leaves of its own.
        totals = sums(leaf_sums.unionByName(done.select(
            *by, F.col("__up").alias("__node"), (F.col("__own") * F.col("__v")).alias("__wv"),
            F.col("__own").alias("__w"),
        )))
    return reduce(DataFrame.unionByName, results)
