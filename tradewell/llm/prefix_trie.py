"""The trie of all conversations' prefixes, by recursive halving of their turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.chat import numbered_turns
from tradewell.llm.common import prepare, saved

#: Member ids that are written out together, by ranges of so many id values.
ID_RANGE = 4096


def _name(*parts):
    """SHA-256 of named parts; each part is itself 32 bytes long, so no two lists of parts are spelled alike."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


ROOT = hashlib.sha256(b"root").digest()


def turn_names(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, n, name, chars): the turns of each conversation in order, each known by a hash of role and text."""
    filled = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = numbered_turns(filled, "conv", "turn", "role", "text")
    spelled = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    return ordered.select(
        "conv", F.col("n").cast("long").alias("n"), F.unhex(F.sha2(spelled, 256)).alias("name"),
        F.length("text").cast("long").alias("chars"))


def with_shared_heads(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv, n, name, chars), (conv, length)): each conversation begins like the first of its group.

    Conversation c gets the first h = crc32(decimal c) % ``heads`` turns of conversation
    c - c % ``group`` (all if it has fewer, none if it is absent), then its own turns after its first h.
    """
    held = turns.groupBy("conv").agg(F.count("*").alias("total"))
    first = held.select(
        "conv", "total", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"),
        (F.col("conv") - F.pmod("conv", F.lit(group))).alias("base"))
    bases = held.select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    plan = saved(first.join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_total", F.lit(0)))), "heads")
    openings = turns.filter(F.col("n") < heads).withColumnRenamed("conv", "base")
    head = plan.select("conv", "base", "taken").join(openings, "base").filter("n < taken").select("conv", "n", "name", "chars")
    tail = turns.join(plan.select("conv", "h", "taken"), "conv").filter("n >= h").select(
        "conv", (F.col("n") - F.col("h") + F.col("taken")).alias("n"), "name", "chars")
    lengths = plan.select("conv", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"))
    return head.unionAll(tail), lengths


def _places(steps: DataFrame, lengths: DataFrame, levels: int) -> DataFrame:
    """(conv, depth, node, parent, chars): the node that a conversation reaches with each turn.

    Sequences are cut at half of 2^levels, their halves again, down to single turns. From below,
    the upper half of every cut gets a name from its own two halves. From above, the lower half of a cut
    starts at its cut prefix: the prefix that the whole part starts at, followed by the upper half's
    name. Upper and lower parts of all cuts of a level are rows of one join, keyed by (conversation, part),
    so a very long conversation is spread like many short ones.
    """
    names = [steps.select("conv", F.col("n").alias("i"), "name")]
    for _ in range(levels - 1):
        halves = names[-1]
        pair = F.floor(F.col("i") / 2).cast("long")
        upper = halves.filter("i % 2 = 0").select("conv", pair.alias("i"), "name")
        lower = halves.filter("i % 2 = 1").select("conv", pair.alias("i"), F.col("name").alias("other"))
        names.append(saved(upper.join(lower, ["conv", "i"]).select("conv", "i", _name("name", "other").alias("name")), "halves"))
    parts = lengths.filter("length > 0").select("conv", "length", F.lit(0).cast("long").alias("i"), F.lit(ROOT).alias("prefix"))
    for level in reversed(range(levels)):
        upper = names[level].filter("i % 2 = 0").select("conv", (F.col("i") / 2).cast("long").alias("i"), "name")
        lower = F.when(
            F.col("length") > (2 * F.col("i") + 1) * (1 << level),
            F.struct((2 * F.col("i") + 1).alias("i"), _name("prefix", "name").alias("prefix")))
        both = F.array(F.struct((2 * F.col("i")).alias("i"), "prefix"), lower)
        parts = parts.join(upper, ["conv", "i"], "left").select("conv", "length", F.explode(both).alias("part")).filter(
            "part is not null").select("conv", "length", "part.i", "part.prefix")
    return parts.join(steps.withColumnRenamed("n", "i"), ["conv", "i"]).select(
        "conv", (F.col("i") + 1).alias("depth"), _name("prefix", "name").alias("node"),
        F.col("prefix").alias("parent"), "chars")


def _graft(own: DataFrame, places: DataFrame, levels: int) -> DataFrame:
    """(conv, depth, parent, leaves, tokens) with both summed over each node's subtree.

    From below: the totals of the trees that hang below a cut prefix are added to that prefix and to its
    ancestors in the upper part, until the part is the whole trie. A node's ancestors are the places of
    its smallest member, so each cut adds at most as many rows as that member has turns above it.
    """
    totals = own
    for level in range(levels):
        half = 1 << level
        roots = totals.filter(F.pmod(F.col("depth") - 1, F.lit(2 * half)) == half)
        below = roots.groupBy(F.col("parent").alias("of"), F.floor((F.col("depth") - 2) / half).cast("long").alias("part")).agg(
            F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
        above = places.withColumn("part", F.floor((F.col("depth") - 1) / half).cast("long"))
        grafts = above.join(below, (above["conv"] == below["of"]) & (above["part"] == below["part"])).select(
            F.col("rep").alias("conv"), "depth", F.lit(None).cast("long").alias("parent"), "leaves", "tokens")
        totals = saved(totals.unionAll(grafts).groupBy("conv", "depth").agg(
            F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")), "grafted")
    return totals


def _ends(ends: DataFrame, id_range: int = ID_RANGE) -> DataFrame:
    """(conv, depth, ends_sha256): hash of the ascending members that end in a node, joined by commas.

    Ranges of ids are spelled out in parallel; a node's ranges are hashed in their order as a stream, so
    that no task holds a node's members together.
    """
    spelled = ends.groupBy("conv", "depth", F.floor(F.col("member") / id_range).cast("long").alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("text"))
    dealt = spelled.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "range")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "text")), strict=True):
                if (conv, depth) != held:
                    if held is not None:
                        out.append((*held, running.hexdigest()))
                    held, running = (conv, depth), hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield rows(out)
        if held is not None:
            yield rows([(*held, running.hexdigest())])

    def rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["conv", "depth", "ends_sha256"])

    return dealt.mapInArrow(stream, "conv long, depth long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", group: int = 100, heads: int = 6,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see ``with_shared_heads`` for the rebuilding.

    A node is a distinct sequence of the first ``depth`` turns, by role and text, from the root (no turn)
    down. (conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null for the root;
    n_convs: members; n_children; n_leaves: childless nodes in the subtree, itself included; saved_tokens:
    what sharing saves in the subtree, each node's (n_convs - 1) times the code points of its last text;
    ends_sha256: SHA-256 of the members that end here, decimal, ascending, joined by commas.)

    Van Emde Boas recursion: sequences are cut at half depth, the prefixes at the cut are named, the upper
    trie and the lower forests are built by the same rule, all of one level at once, and the totals of
    lower forests are grafted on the paths above (``_places``, ``_graft``). There are about 2 log2(longest)
    shuffles of all turns, and none has a key that is one conversation or one prefix of many turns; prefixes
    that many share are counted before they are shuffled. Names are SHA-256, so no texts can be made to meet.

    Turns are ordered by turn (null first), then role and text; null roles and texts are empty. Repeated rows are
    turns of their own. Turns without a conversation id belong to no conversation and are left out. Remainders
    are those of the floor division, also for negative ids. Without any conversation there is no root.
    """
    prepare(turns.sparkSession)
    own = saved(turn_names(turns, conv_col, turn_col, role_col, text_col), "turn-names")
    rebuilt, lengths = with_shared_heads(own, group, heads)
    steps, lengths = saved(rebuilt, "rebuilt"), saved(lengths, "lengths")
    longest = lengths.agg(F.max("length")).first()[0] or 0
    levels = max(longest - 1, 0).bit_length()

    reached = saved(_places(steps, lengths, levels), "reached")
    named = reached.groupBy("node").agg(
        F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("chars").alias("chars"))
    named = saved(named, "named")
    places = saved(reached.join(named.select("node", "rep"), "node").select("conv", "depth", "rep"), "places")
    # The parent is where the smallest member was one turn before; above the first turn that is the root.
    before = places.select(F.col("conv").alias("of"), (F.col("depth") + 1).alias("next"), F.col("rep").alias("parent"))
    nodes = saved(named.join(before, (named["rep"] == before["of"]) & (named["depth"] == before["next"]), "left").select(
        named["rep"].alias("conv"), named["depth"], "parent", "n_convs", "chars"), "nodes")
    children = nodes.filter("depth > 1").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, ["conv", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes-children")
    leaves = nodes.select(
        "conv", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens"))
    totals = _graft(leaves, places, levels)

    first = F.lit(lengths.agg(F.min("conv")).first()[0]).cast("long")
    none = F.lit(None).cast("long")
    everyone = lengths.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).select(
        "conv", "n_convs", none.alias("n_children"), none.alias("leaves"), none.alias("tokens"))
    top = totals.filter("depth = 1").agg(
        F.count("*"), F.coalesce(F.sum("leaves"), F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).select(none, none, "*")
    root = everyone.unionAll(top).agg(*[F.max(c).alias(c) for c in everyone.columns]).filter("n_convs > 0").select(
        "conv", F.lit(0).cast("long").alias("depth"), none.alias("parent"), "n_convs", "n_children", "leaves", "tokens")
    below = nodes.select("conv", "depth", "parent", "n_convs", "n_children").join(
        totals.select("conv", "depth", "leaves", "tokens"), ["conv", "depth"]).select(
        "conv", "depth", F.when(F.col("depth") == 1, first).otherwise(F.col("parent")).alias("parent"),
        "n_convs", "n_children", "leaves", "tokens")
    last = lengths.filter("length > 0").join(
        places, (lengths["conv"] == places["conv"]) & (lengths["length"] == places["depth"])).select(
        F.col("rep").alias("conv"), "depth", lengths["conv"].alias("member"))
    silent = lengths.filter("length = 0").select(
        first.alias("conv"), F.lit(0).cast("long").alias("depth"), F.col("conv").alias("member"))
    ends = _ends(last.unionAll(silent))
    every = root.unionAll(below)
    return every.join(ends, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
