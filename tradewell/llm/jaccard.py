"""Exact similarity join of shingle sets, with skipped index blocks and derived answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import (
    BROADCAST_ROWS, components, few, mix, prepare, returning, saved, shingle_sets, signed, texts_of, unique_ids,
)

#: Entries of a task's share of the index, and rows of one list before it is dealt out.
BUCKET, LIST = 1_000_000, 200_000
#: Sets of one leader that are compared with each other within a task.
BLOCK_SETS = 1024
#: Sets, and bytes of differences, that a task's groups of leaders hold on average; never fewer groups than ``GROUPS``.
GROUP_SETS, GROUP_BYTES, GROUPS = 2048, 8 << 20, 256
#: Slots of tokens whose counts are kept in one array.
PART = 4096
ENTRY = np.dtype([("token", "u8"), ("node", "i8"), ("size", "i4"), ("pos", "i4")])


def prefix_size(n: int | np.ndarray, percent: int):
    """So many of a set's first tokens contain one of every linked set's first tokens."""
    return n + (-percent * n) // 100 + 1


def _shards(weight: np.ndarray, mean: float) -> np.ndarray:
    """Parts into which a token's list is dealt, by its estimated length."""
    return 1 + np.maximum(weight - 2 * mean, 0).astype(np.int64) // LIST


def _facts(texts: DataFrame, words: int, slots: int) -> DataFrame:
    """Per row the size and a 128-bit digest of its set, and per task the sets met per slot of tokens.

    Those are arrays for ``PART`` slots each, compressed: there may be as many slots as rows, and a row for each slot
    and task would grow with the square of the input.
    """
    shift = np.uint64(64 - slots.bit_length() + 1)

    @returning
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(slots, np.int64)
        names = ["node", "n", "d1", "d2", "part", "sets"]
        for batch in batches:
            out = np.zeros((len(batch), 3), np.int64)
            sets = [*shingle_sets(texts_of(batch.column("text")), words)]
            out[:, 0] = [len(tokens) for tokens in sets]
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
            some, start = out[:, 0] > 0, np.cumsum(out[:, 0]) - out[:, 0]
            if len(tokens):
                # Order does not matter: a set is known by two sums over its tokens.
                for k, salt in ((1, np.uint64(0)), (2, np.uint64(0x5DEECE66D))):
                    out[some, k] = signed(np.add.reduceat(mix(tokens ^ salt), start[some]))
                slot = (tokens >> shift).astype(np.int64)
                if len(slot) > slots:
                    weight += np.bincount(slot, minlength=slots)
                else:
                    np.add.at(weight, slot, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *(pa.array(out[:, k]) for k in range(3)), pa.nulls(len(batch), pa.int64()),
                 pa.nulls(len(batch), pa.binary())], names)
        for at in range(0, slots, PART * 256):
            some = [part for part in range(at // PART, min(slots, at + PART * 256) // PART) if weight[part * PART :][:PART].any()]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(some, pa.int64()), pa.array(
                [pa.compress(weight[part * PART :][:PART].tobytes(), "zstd", asbytes=True) for part in some], pa.binary())], names)

    return texts.mapInArrow(scan, "node long, n long, d1 long, d2 long, part long, sets binary")


def _slot_weights(facts: DataFrame, slots: int) -> np.ndarray:
    """How many sets all tasks have met, by slot."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.int64)
        for packed in pdf["sets"]:
            total += np.frombuffer(pa.decompress(packed, PART * 8, "zstd", asbytes=True), np.int64)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "sets": [total.tobytes()]})

    table = facts.filter("part is not null").select("part", "sets").groupBy("part").applyInPandas(
        add, "part long, sets binary").toArrow()
    weight = np.zeros(slots, np.int64)
    for part, sets in zip(table["part"].to_pylist(), table["sets"].to_pylist(), strict=True):
        weight[part * PART :][:PART] = np.frombuffer(sets, np.int64)
    return weight


def _lists(texts: DataFrame, words: int, percent: int, weight: np.ndarray, buckets: int) -> DataFrame:
    """The index: (token, band, node, size, pos, lead) for tokens that several sets' prefixes hold.

    Tokens are ordered by the weight of their slot, rare ones first. Entries travel as packed
    arrays, one per task and bucket. ``lead`` is the list's smallest node within a size band.
    """
    context = texts.sparkSession.sparkContext
    shared, mean = context.broadcast(weight), float(weight.mean())
    shift = np.uint64(64 - len(weight).bit_length() + 1)
    # A little over 100 / percent, so that linked sets are at most one band apart.
    step = math.log(100 / percent) * 1.001

    @returning
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            held.clear()
            shards = _shards(shared.value[(entries["token"] >> shift).astype(np.int64)], mean)
            shard = mix(entries["node"].view(np.uint64)) % shards.view(np.uint64)
            bucket = (mix(entries["token"] + shard * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            entries = entries[order := np.argsort(bucket, kind="stable")]
            names, at = np.unique(bucket[order], return_index=True)
            blobs = [x.tobytes() for x in np.split(entries, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        count = 0
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for node, tokens in zip(nodes, shingle_sets(texts_of(batch.column("text")), words), strict=True):
                n = len(tokens)
                if not n:
                    continue
                first = prefix_size(n, percent)
                order = np.argsort(shared.value[(tokens >> shift).astype(np.int64)], kind="stable")[:first]
                entries = np.empty(first, ENTRY)
                entries["token"], entries["node"], entries["size"] = tokens[order], node, n
                entries["pos"] = np.arange(first)
                held.append(entries)
                count += first
                if count >= BUCKET:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def collate(pdf: pd.DataFrame) -> pd.DataFrame:
        entries = np.frombuffer(b"".join(pdf["entries"]), ENTRY)
        band = (np.log(entries["size"]) / step).astype(np.int32)
        order = np.lexsort((entries["node"], band, entries["token"]))
        entries, band = entries[order], band[order]
        token = entries["token"]
        fresh = np.concatenate([[True], token[1:] != token[:-1]])
        length = np.diff(np.concatenate([np.flatnonzero(fresh), [len(token)]]))[np.cumsum(fresh) - 1]
        dealt = _shards(shared.value[(token >> shift).astype(np.int64)], mean) > 1
        lead = fresh | np.concatenate([[True], band[1:] != band[:-1]])
        lead = entries["node"][np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        keep = (length > 1) | dealt
        return pd.DataFrame({
            "token": signed(token[keep]), "band": band[keep], "node": entries["node"][keep],
            "size": entries["size"][keep], "pos": entries["pos"][keep], "lead": lead[keep]})

    blobs = texts.mapInArrow(emit, "bucket long, entries binary")
    return blobs.groupBy("bucket").applyInPandas(
        collate, "token long, band int, node long, size int, pos int, lead long")


def overlaps(pairs: DataFrame, texts: DataFrame, words: int, differences: bool = False) -> DataFrame:
    """(a, b, na, nb, o): the exact sizes and intersections of the sets of the pairs (a, b).

    With ``differences`` also the tokens that only b has (gone) and only a has (fresh), where the
    intersection is at least half of b. Only texts that occur in a pair are shuffled. The join on ``b`` puts all partners of a set
    one after another, so its shingles are computed once per batch.
    """
    pairs = saved(pairs.select("a", "b"), "set-asked")  # read several times
    left = texts.join(few(pairs), F.col("node") == F.col("a")).select("a", "b", F.col("text").alias("ta"))
    right = texts.join(few(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi")
    joined = left.join(right.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    @returning
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            known: dict[int, bytes] = dict(zip(a, texts_of(batch.column("ta")), strict=True))
            known.update(zip(b, texts_of(batch.column("tb")), strict=True))
            sets = dict(zip(known, shingle_sets(known.values(), words), strict=True))
            out = []
            for x, y in zip(a, b, strict=True):
                one, two = sets[x], sets[y]
                both = np.intersect1d(one, two, True)
                near = differences and 2 * len(both) >= len(two)
                out.append((len(one), len(two), len(both), *(
                    np.setdiff1d(z, both, True).tobytes() if near else None for z in (two, one))))
            na, nb, o, gone, fresh = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *(pa.array(x, pa.int64()) for x in (na, nb, o)),
                 *(pa.array(x, pa.binary()) for x in (gone, fresh))], ["a", "b", "na", "nb", "o", "gone", "fresh"])

    out = joined.select("a", "b", "ta", "tb").mapInArrow(
        measure, "a long, b long, na long, nb long, o long, gone binary, fresh binary")
    return out if differences else out.drop("gone", "fresh")


def _groups(sets: int, size: int) -> int:
    """Groups into which leaders are dealt, for so many led sets and bytes of differences."""
    return max(GROUPS, -(-sets // GROUP_SETS), -(-size // GROUP_BYTES))


def _derived_links(led: DataFrame, percent: int) -> DataFrame:
    """(node, root): links between sets with the same leader x, from their differences to x alone.

    With gone(y) = x - y and fresh(y) = y - x, |y & z| = |x| - |gone(y)| - |gone(z)| + |gone(y) & gone(z)|
    + |fresh(y) & fresh(z)|. Sets that link with x are one class anyway, so only the others are
    compared with all sets of the leader, block against block; what comes out is a spanning
    forest of the links within two blocks.
    """
    linked = F.col("o") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    rows = led.select(F.col("b").alias("lead"), F.col("a").alias("node"), F.col("na").alias("n"), F.col("nb").alias("of"),
                      "gone", "fresh", linked.alias("linked"))
    sizes = rows.groupBy("lead").agg(
        F.count("*").alias("sets"), F.sum(F.when(~F.col("linked"), 1).otherwise(0)).alias("others")).filter("others > 0 and sets > 1")
    sizes = sizes.select("lead", *(F.ceil(F.col(c) / BLOCK_SETS).cast("int").alias(c) for c in ("sets", "others")))
    rows = rows.join(few(sizes), "lead").withColumn("block", F.xxhash64("node"))
    every = rows.withColumn("x", F.pmod("block", "sets").cast("int")).withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("left", F.lit(False))
    others = rows.filter(~F.col("linked")).withColumn("y", F.pmod("block", "others").cast("int")).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).withColumn("left", F.lit(True))
    total = led.agg(F.count("*"), F.sum(F.length("gone") + F.length("fresh"))).first()
    groups = _groups(total[0], total[1] or 0)
    columns = [F.pmod(F.xxhash64("lead"), F.lit(groups)).alias("g"), "x", "y", "lead", "left", "node", "n", "of", "gone", "fresh"]

    def tokens(rows: pd.DataFrame, which: str) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(v, np.uint64) for v in rows[which]]
        return np.concatenate(own), np.repeat(np.arange(len(own)), [len(v) for v in own])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": [], "root": []}).astype("int64")]
        for _, rows in pdf.groupby("lead", sort=False):
            left, right = rows[rows["left"]], rows[~rows["left"]]
            if not len(left) or not len(right):
                continue
            shared = np.zeros((len(left), len(right)), np.int32)
            for which in ("gone", "fresh"):
                (lt, lo), (rt, ro) = tokens(left, which), tokens(right, which)
                order = np.argsort(rt, kind="stable")
                rt, ro = rt[order], ro[order]
                low, high = np.searchsorted(rt, lt, "left"), np.searchsorted(rt, lt, "right")
                for k in np.flatnonzero(high > low).tolist():
                    shared[lo[k], ro[low[k] : high[k]]] += 1
            gone = [np.array([len(v) // 8 for v in side["gone"]]) for side in (left, right)]
            both = int(rows["of"].iloc[0]) - gone[0][:, None] - gone[1][None, :] + shared
            sizes = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :]
            a, b = left["node"].to_numpy(), right["node"].to_numpy()
            i, j = np.nonzero((both * (100 + percent) >= sizes * percent) & (a[:, None] != b[None, :]))
            if len(i):
                names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                i, j = place[i], place[len(a) + j]
                reach, before = np.arange(len(names)), None
                while before is None or (reach != before).any():
                    before = reach.copy()
                    np.minimum.at(reach, i, before[j])
                    np.minimum.at(reach, j, before[i])
                some = np.unique(np.concatenate([i, j]))
                out.append(pd.DataFrame({"node": names[some], "root": names[reach[some]]}))
        return pd.concat(out)

    return every.select(columns).union(others.select(columns)).groupBy("g", "x", "y").applyInPandas(
        compare, "node long, root long")


def _apart(pairs: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose ends are in different classes of ``groups`` (node, component).

    An end is a node, or the node that named its class before.
    """
    for end in (a, b):
        own = groups.select(F.col("node").alias(end), F.col("component").alias(f"__{end}"))
        pairs = pairs.join(few(own), end, "left").withColumn(f"__{end}", F.coalesce(f"__{end}", F.col(end)))
    return pairs.filter(F.col(f"__{a}") != F.col(f"__{b}")).drop(f"__{a}", f"__{b}")


def _representatives(texts: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The texts of the classes' representatives; whichever is fewer, they or the others, meets the texts.

    So all texts are shuffled only where both are too many to be broadcast.
    """
    own = classes.select(F.col("rep").alias("node"))
    if own.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        others = saved(sets.select("node").join(own, "node", "left_anti"), "set-others")
        if others.count() <= BROADCAST_ROWS:
            return texts.join(F.broadcast(others), "node", "left_anti")
    return texts.join(few(own, BROADCAST_ROWS), "node", "left_semi")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: classes of documents linked by similar sets.

    A row's set is its distinct shingles of ``words`` words (the whole sequence as one if it has
    fewer). Two rows link when 100 * intersection >= percent * union; the join is exact.

    1. Rows with the same set become one class, known by a 128-bit digest.
    2. Only a set's rarest tokens are indexed: linked sets share one of their first
       ``prefix_size`` tokens in any common order, here by how many sets a token's slot has met.
    3. Every set is first compared with one set only, the one that leads most of its lists. If they
       share half of it, that set is its leader, and the set is known by its differences to it.
       Whether two sets of one leader link follows from their differences alone.
    4. Lists are cut into blocks by size band, position, leader and class. Two blocks are
       skipped if their sizes or positions rule a link out, or if they have one leader or class.
       For the others the *leaders'* intersection is computed, and the members' answers follow:
       |y & z| <= |lead(y) & lead(z)| + |y - lead(y)| + |z - lead(z)|. Only members that this
       bound leaves open are compared themselves.

    So a group of thousands of near copies costs about one comparison for each copy. Long lists are
    dealt out in parts. Classes are connected by ``components``.

    Null or empty texts have no shingles and link with nothing. A null or repeated id is no
    obstacle: each row counts as a document of its own, and a class is named by its smallest
    non-null id. Token hashes have 64 bits; they meet only within a pair of sets.
    """
    spark = prepare(docs.sparkSession)
    texts, names = unique_ids(docs, id_col, text_col)
    rows = docs.count()
    slots = 1 << min(22, max(18, (max(rows, 1) - 1).bit_length()))
    facts = saved(_facts(texts, words, slots), "set-facts")
    sets = facts.filter("part is null").select("node", "n", "d1", "d2")
    classes = saved(sets.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("node").alias("rep")), "set-classes")

    weight = _slot_weights(facts, slots)
    total = classes.agg(F.sum(F.expr(f"n - ceil(n * {percent} / 100) + 1"))).first()[0] or 0
    reps = _representatives(texts, sets, classes)
    index = saved(_lists(reps, words, percent, weight, max(1, math.ceil(total / BUCKET * 4))), "set-index")

    def enough(o: Column, sizes: Column) -> Column:
        """The intersection that a link needs, given (a lower bound of) both sizes together."""
        return o * (100 + percent) >= sizes * percent

    linking = enough(F.col("o"), F.col("na") + F.col("nb"))
    # A leader without a fair share of common first tokens would not be near; any choice is right.
    first = index.filter("lead != node").groupBy("node", "lead", "size").count().filter(
        "count * 40 >= size").groupBy("node").agg(
        F.max_by("lead", F.struct("count", -F.col("lead"))).alias("lead"))
    first = saved(overlaps(first.select(F.col("node").alias("a"), F.col("lead").alias("b")), texts, words, True)
                  .filter("gone is not null"), "set-leaders")
    derived = saved(_derived_links(first, percent), "set-derived").filter("node != root").toDF("a", "b")
    links = first.filter(linking).select("a", "b").union(derived)
    groups = components(links)

    led = first.select(F.col("a").alias("node"), F.col("b").alias("leader"), (F.col("na") - F.col("o")).alias("d"))
    known = saved(groups.join(led, "node", "full"), "set-known")
    entries = index.drop("lead").join(few(known), "node", "left").select(
        "token", "band", "node", "size", "pos", F.coalesce("component", "node").alias("component"),
        F.coalesce("leader", "node").alias("leader"), F.coalesce("d", F.lit(0)).alias("d"),
        F.floor(F.log2(F.col("pos") + 1)).alias("place"))
    mixed = entries.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    entries = saved(entries.join(mixed.select("token"), "token", "left_semi"), "set-mixed")

    # Blocks of the lists, and pairs of blocks that may hold a link between two classes.
    block = ["token", "band", "place", "leader", "component"]
    blocks = entries.groupBy(block).agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max("pos").alias("at"),
        F.max(F.col("size") - F.col("pos")).alias("rest"), F.max("d").alias("d"),
        F.max((F.col("node") != F.col("leader")).cast("int")).alias("led"))

    def side(df: DataFrame, mark: str, keep: tuple[str, ...] = ()) -> DataFrame:
        return df.select([F.col(c).alias(c if c in keep else f"{mark}_{c}") for c in df.columns])

    later = side(blocks, "r", ("token",)).withColumn("l_band", F.explode(F.array("r_band", F.col("r_band") - 1)))
    open_blocks = side(blocks, "l", ("token",)).join(later, ["token", "l_band"]).filter(
        (F.col("l_component") != F.col("r_component")) & (F.col("l_leader") != F.col("r_leader"))
        & ((F.col("l_band") != F.col("r_band")) | (F.col("l_leader") < F.col("r_leader")))
        & (F.col("l_most") * 100 >= F.col("r_least") * percent)
        & (F.col("r_most") * 100 >= F.col("l_least") * percent)
        & enough(F.least("l_at", "r_at") + F.least("l_rest", "r_rest"), F.col("l_least") + F.col("r_least")))
    open_blocks = saved(open_blocks.withColumn("a", F.greatest("l_leader", "r_leader"))
                        .withColumn("b", F.least("l_leader", "r_leader")), "set-blocks")
    # All tokens that two sets' prefixes share are met here, and beyond the prefix that ends first
    # no more are left than that set's rest.
    def rest(size: Column) -> Column:
        return F.ceil(size * percent / 100) - 1

    met = open_blocks.groupBy("a", "b").agg(
        F.count_distinct("token").alias("met"), F.min(F.col("l_least") + F.col("r_least")).alias("sizes"),
        F.max(rest(F.greatest("l_most", "r_most"))).alias("rest"))
    met = met.filter(enough(F.col("met") + F.col("rest"), F.col("sizes"))).select("a", "b")
    leads = saved(overlaps(met, texts, words), "set-leads")
    links = links.union(leads.filter(linking).select("a", "b"))

    # Blocks whose sets have become one class by now are settled.
    undecided = open_blocks.filter("l_led + r_led > 0").join(few(leads.select("a", "b", "o")), ["a", "b"]).filter(
        enough(F.col("o") + F.col("l_d") + F.col("r_d"), F.col("l_least") + F.col("r_least")))
    undecided = saved(undecided.select(
        "token", "o", "a", "b", *(f"{s}_{c}" for s in "lr" for c in block[1:])), "set-open")
    if undecided.limit(1).count():
        groups = saved(components(links), "set-groups")
        undecided = _apart(undecided, groups, "l_component", "r_component")
        for mark in "lr":
            member = side(entries.select(*block, "node", "size", "pos", F.col("d").alias("own")), mark, ("token",))
            undecided = undecided.join(member, ["token", *(f"{mark}_{c}" for c in block[1:])])
        pairs = undecided.filter(
            enough(F.col("o") + F.col("l_own") + F.col("r_own"), F.col("l_size") + F.col("r_size"))
            & enough(F.least("l_pos", "r_pos") + F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos")),
                     F.col("l_size") + F.col("r_size"))
        ).groupBy(F.greatest("l_node", "r_node").alias("a"), F.least("l_node", "r_node").alias("b")).agg(
            F.count("*").alias("met"), F.first(F.col("l_size") + F.col("r_size")).alias("sizes"),
            F.first(rest(F.greatest("l_size", "r_size"))).alias("rest"))
        pairs = pairs.filter(enough(F.col("met") + F.col("rest"), F.col("sizes"))).select("a", "b")
        links = links.union(overlaps(saved(pairs, "set-pairs"), texts, words).filter(linking).select("a", "b"))
    groups = components(links).withColumnRenamed("node", "rep")

    found = sets.join(classes, ["n", "d1", "d2"], "left").join(groups, "rep", "left").select(
        "node", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "node").alias("component"))
    if names is None:
        return found.select(F.col("node").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    found = found.join(names, "node")
    least = found.groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(least, "component").select(F.col("id").alias(id_col), "n_shingles", "component_id")
