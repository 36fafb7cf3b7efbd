"""Benchmark passages in documents: random-walk embedding, bit sampling, exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import mix, prepare, returning, texts_of, word_hashes

#: Benchmark items that are searched for in one pass over the documents.
ITEMS = 20_000
#: Words whose windows are embedded together, so that all arrays stay in a core's cache.
BLOCK = 1 << 14
#: Agreeing windows that are held at once.
HITS = 1 << 18
#: Least share of an item's copies with the most allowed edits that must become candidates.
RECALL = 0.995
#: Words of the largest window, and samples of each walk.
LARGEST, SAMPLES = 6, 4
#: Edited copies per kind of edit from which ``plan`` measures the recall.
TRIALS = 200
#: Items from so many words on, up to the next number, share a plan; the shortest has the most edits for its length.
CLASSES = (1, 2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)


def most_edits(words: int, similarity: float) -> int:
    return int(words * (1 - similarity) + 1e-9)


def window_size(words: int, edits: int) -> int:
    """Words of an item's windows: at most half the item, but all of one that allows no edit."""
    return min(LARGEST, max(1, words // 2) if edits else words)


def embed(
    words: np.ndarray, at: np.ndarray, ends: np.ndarray, size: int, samples: tuple[int, ...], walk: int, check: bool = False
) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Bit-sampled hashes of the random-walk embeddings of the windows that start at ``at``.

    Step j writes the word under the walk's pointer and moves the pointer on if a random bit, a
    function of j and the word, says so. An edit throws two walks out of step only until their
    bits differ the right way, so edit distance becomes Hamming distance. Past a window's
    ``size`` words (or its text's end) the walk writes blanks. A sample is the hash of the words
    written at some random steps; windows agree in it if their embeddings agree there. One walk
    serves all ``samples``, numbers of such steps. With ``check``, also returned is which samples hold
    that many words at different places of the window; one that holds fewer would agree with very many.
    """
    rng = np.random.default_rng([walk, size])
    steps = 2 * size
    factors = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    blank = np.concatenate([words, np.zeros(1, np.uint64)])
    stop = np.minimum(at + size, ends)
    here = at.copy()
    takers: list[list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]] = [[] for _ in range(steps)]
    found = []
    for places in samples:
        rng = np.random.default_rng([walk, size, places])
        # All steps are one sample, in which a window always agrees with its unchanged copy.
        every = places == steps
        chosen = [range(steps)] if every else [rng.choice(steps, places, replace=False).tolist() for _ in range(SAMPLES)]
        out = np.full((len(chosen), len(at)), (walk * 1000 + size) * 100 + places, np.uint64)
        whole = np.ones((len(chosen), len(at)), bool) if check else None
        found.append((out, whole))
        for s, own in enumerate(chosen):
            before = np.full(len(at), -1) if check and not every else None
            for j in own:
                takers[j].append((out[s], whole[s] if check else None, before))
    for j in range(max(j for j in range(steps) if takers[j]) + 1):
        inside = here < stop
        word = blank[np.where(inside, here, len(words))]
        for out, whole, before in takers[j]:
            out ^= word
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += np.uint64(j)
            if before is not None:
                whole &= inside & (before != here)
                before[:] = here
        here += (((word * factors[j]) >> np.uint64(63)) > 0) & inside
    return [(mix(out + np.arange(len(out), dtype=np.uint64)[:, None]), whole) for out, whole in found]


def edited(rng: np.random.Generator, item: np.ndarray, edits: int, kind: int, even: bool) -> np.ndarray:
    """The item with so many words replaced (kind 0), deleted (1) or inserted (2), evenly spread or anywhere."""
    n = len(item)
    at = (2 * np.arange(edits) + 1) * n // (2 * edits) if even and edits else rng.choice(n, edits, replace=False)
    fresh = rng.integers(1, 1 << 63, n, dtype=np.uint64)
    if kind == 0:
        out = item.copy()
        out[at] = fresh[at]
        return out
    return np.delete(item, at) if kind == 1 else np.insert(item, at, fresh[at])


@lru_cache(maxsize=None)
def recalls(words: int, edits: int, size: int, places: int, walks: int) -> list[float]:
    """Shares of edited copies that have a sample in common with their item, after 1, 2, ... walks.

    The least of the shares for replaced, deleted and inserted words, evenly spread and anywhere.
    """
    rng = np.random.default_rng([words, edits])
    mixes = [(kind, even) for kind in range(3) for even in (True, False)]
    items = [rng.integers(1, 1 << 63, words, dtype=np.uint64) for _ in range(TRIALS * len(mixes))]
    copies = [edited(rng, x, edits, *mixes[i % len(mixes)]) for i, x in enumerate(items)]
    around = [rng.integers(1, 1 << 63, words, dtype=np.uint64) for _ in items]
    texts = [np.concatenate([x[: words // 2], y, x[words // 2 :]]) for x, y in zip(around, copies, strict=True)]

    def side(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array([len(x) for x in parts])
        owner = np.repeat(np.arange(len(parts)), counts)
        return np.concatenate(parts), owner, np.cumsum(counts)[owner]

    (a, a_owner, a_ends), (b, b_owner, b_ends) = side(items), side(texts)
    at = np.flatnonzero(np.arange(len(a)) + size <= a_ends)
    hit, out = np.zeros(len(items), bool), []
    for walk in range(walks):
        [(one, whole)] = embed(a, at, a_ends[at], size, (places,), walk, check=True)
        [(two, _)] = embed(b, np.arange(len(b)), b_ends, size, (places,), walk)
        for s in range(SAMPLES):
            own = a_owner[at][whole[s]]
            keys = one[s][whole[s]] ^ mix(own.astype(np.uint64) + np.uint64(1))
            hit[own[np.isin(keys, two[s] ^ mix(b_owner.astype(np.uint64) + np.uint64(1)))]] = True
        out.append(min(float(hit[m :: len(mixes)].mean()) for m in range(len(mixes))))
    return out


@lru_cache(maxsize=None)
def plan(words: int, similarity: float = 0.75) -> tuple[int, int, int]:
    """(size, places, walks) for items of so many words: the most selective that reach ``RECALL``.

    Measured with the most edits allowed. More places make a sample more selective, and more walks
    make up for it; with two places walks are added until the recall is reached.
    """
    least = max(c for c in CLASSES if c <= words)
    edits = most_edits(words, similarity)
    if not edits:
        size = window_size(words, 0)
        return size, 2 * size, 1
    edits = math.ceil(least * (1 - similarity) - 1e-9)
    for size in range(window_size(least, edits), 0, -1):
        for places in range(min(size, 4), 0, -1):
            got = recalls(least, edits, size, places, 4 if places > 2 else 16)
            for walks, share in enumerate(got, 1):
                if share >= RECALL:
                    return size, places, walks
    raise ValueError(f"no plan reaches a recall of {RECALL} for items of {words} words at similarity {similarity}")


def best_match(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(edits, from, to): the least word edit distance of ``item`` to any stretch of ``part``.

    Rows of the usual table, with the first row all 0, so that a match may start anywhere. The
    insertions along a row are a running minimum of the cost minus the place.
    """
    n = len(part)
    places = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, np.int64), places.copy()
    for i, word in enumerate(item, 1):
        replace = cost[:-1] + (part != word)
        step = np.empty(n + 1, np.int64)
        source = np.empty(n + 1, np.int64)
        step[0], source[0] = i, 0
        delete = cost[1:] + 1
        step[1:] = np.minimum(replace, delete)
        source[1:] = np.where(replace <= delete, origin[:-1], origin[1:])
        slack = (step - places) * (n + 1) + places  # the place rides along in the minimum
        least = np.minimum.accumulate(slack)
        came = least % (n + 1)
        cost, origin = least // (n + 1) + places, source[came]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


class Table:
    """The items' words, their samples per plan, and a filter of which words an item has."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float):
        words, counts = word_hashes([t for _, t in items])
        self.parts = np.split(words, np.cumsum(counts)[:-1]) if len(items) else []
        self.counts = counts
        self.most = np.array([most_edits(n, similarity) for n in counts.tolist()], np.int64)
        #: A bit for each item and word; a few others fall on the same bits.
        self.bits = max(16, (8 * len(words)).bit_length())
        self.has = np.zeros(1 << self.bits, bool)
        self.has[self.slots(np.repeat(np.arange(len(items)), counts), words)] = True
        plans: dict[tuple[int, int, int], list[int]] = {}
        for k, n in enumerate(counts.tolist()):
            if n:
                size = window_size(n, int(self.most[k]))
                for way in {plan(n, similarity), (size, 2 * size, 1)}:
                    plans.setdefault(way, []).append(k)
        #: (size, walk) -> places -> per sample: sorted hashes with item and offset, and a filter of the hashes.
        self.samples: dict[tuple[int, int], dict[int, list[tuple[np.ndarray, ...]]]] = {}
        for size, places, walk in sorted({(s, p, w) for s, p, walks in plans for w in range(walks)}):
            own = sorted(k for (s, p, walks), ks in plans.items() if (s, p) == (size, places) and walk < walks for k in ks)
            every = np.concatenate([self.parts[k] for k in own])
            item = np.repeat(own, counts[own])
            ends = np.cumsum(counts[own])
            offset = np.arange(len(every)) - np.repeat(ends - counts[own], counts[own])
            ends = np.repeat(ends, counts[own])
            at = np.flatnonzero(np.arange(len(every)) + size <= ends)
            [(hashes, whole)] = embed(every, at, ends[at], size, (places,), walk, check=True)
            for s in range(len(hashes)):
                kept = hashes[s][whole[s]]
                order = np.argsort(kept, kind="stable")
                bits = max(16, (16 * len(kept)).bit_length())
                there = np.zeros(1 << bits, bool)
                there[kept >> np.uint64(64 - bits)] = True
                self.samples.setdefault((size, walk), {}).setdefault(places, []).append(
                    (kept[order], item[at][whole[s]][order], offset[at][whole[s]][order], there, np.uint64(64 - bits)))

    def slots(self, item: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (words ^ mix(item.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.75, items: int = ITEMS,
) -> DataFrame:
    """(id, item, edits, n_words, first_word, end_word): each benchmark item that a document holds.

    A document holds an item of n words if some stretch of it is within (1 - similarity) * n word
    edits (insert, delete, replace) of the item; words are runs without white space, A-Z as a-z.
    One row per document row and item, with the best such stretch found.

    Candidates come from windows of at most half an item, at every word of a document: random-walk
    embeddings turn edits into few changed places, and several samples of few places each collide
    with the items' own windows. Window size, places and walks follow from ``RECALL``: ``plan``
    takes those with which so large a share of copies with the most allowed edits collides at
    least once. An unchanged item always does. The exact distance decides.

    Every document is searched where it is read: nothing of it is shuffled. The benchmark is
    searched for in groups of ``items`` items, one pass each, so what is broadcast is bounded. A
    null or empty item matches nothing; a null text is empty. Items that repeat are reported each.
    """
    spark = prepare(docs.sparkSession)
    wanted = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    groups = max(1, -(-wanted.count() // items))
    form = (f"id {docs.schema[id_col].dataType.simpleString()}, item long, "
            "edits long, n_words long, first_word long, end_word long")
    out = None
    for g in range(groups):
        own = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()
        rows = sorted(((r["item"], (r["text"] or "").encode()) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = spark.sparkContext.broadcast((rows, Table(rows, similarity)))
        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _searcher(shared), form)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _searcher(shared):
    @returning
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, table = shared.value
        for batch in batches:
            ids, texts = batch.column("id"), texts_of(batch.column("text"))
            found: list[tuple[int, ...]] = []
            for low in _slices(texts):
                found += [(i + low.start, *rest) for i, *rest in _search(texts[low], table)]
            cols = list(zip(*found, strict=True)) if found else [()] * 6
            take = pa.array(cols[0], pa.int64())
            names = [rows[k][0] for k in cols[1]]
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), pa.array(names, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["id", "item", "edits", "n_words", "first_word", "end_word"])

    return search


def _slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[slice]:
    """Stretches of the batch of about a megabyte."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _candidates(words: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray, table: Table) -> list:
    """Sorted (text, item, place) where an item may begin: its windows agree there, and enough of its words are near."""
    found: list[tuple[int, int, int]] = []
    longest = int(table.counts.max())
    room = len(words) + longest

    def near(keys: np.ndarray) -> None:
        """Keeps those where so many of the item's words stand where it would, give or take the edits."""
        pair, place = np.divmod(keys, room)
        place -= longest
        text, item = np.divmod(pair, len(table.parts))
        n, most = table.counts[item], table.most[item]
        start, end = np.maximum(first[text], place - most), np.minimum(last[text], place + n + most)
        keep = np.zeros(len(keys), bool)
        order = np.argsort(n, kind="stable")
        for some in np.split(order, np.arange(4096, len(order), 4096)):
            at = start[some][:, None] + np.arange(int((end - start)[some].max()))
            inside = at < end[some][:, None]
            own = table.has[table.slots(item[some][:, None], words[np.minimum(at, len(words) - 1)])] & inside
            keep[some] = own.sum(1) >= n[some] - most[some]
        found.extend(zip(text[keep].tolist(), item[keep].tolist(), place[keep].tolist(), strict=True))

    for low in range(0, len(words), BLOCK):
        # Walks of a block see the words behind it that its windows reach.
        at = np.arange(low, min(low + BLOCK, len(words)))
        ends = last[owner[at]]
        held: list[np.ndarray] = []
        for (size, walk), ways in table.samples.items():
            made = embed(words[low : low + BLOCK + size], at - low, ends - low, size, tuple(ways), walk)
            pairs = [x for (hashes, _), kept in zip(made, ways.values(), strict=True) for x in zip(hashes, kept, strict=True)]
            for own, (known, item, offset, there, shift) in pairs:
                maybe = np.flatnonzero(there[own >> shift])
                start = np.searchsorted(known, own[maybe], "left")
                number = np.searchsorted(known, own[maybe], "right") - start
                # Common words can agree with very many windows: about ``HITS`` at a time.
                upto = np.cumsum(number)
                cuts = np.flatnonzero(np.diff(upto // HITS)) + 1
                for some in np.split(np.arange(len(maybe)), cuts):
                    count = number[some]
                    if not count.any():
                        continue
                    entry = np.repeat(start[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    place = np.repeat(at[maybe[some]], count)
                    held.append(np.unique(
                        (owner[place] * len(table.parts) + item[entry]) * room + place - offset[entry] + longest))
                    if sum(map(len, held)) >= HITS:
                        near(np.unique(np.concatenate(held)))
                        held.clear()
        if held:
            near(np.unique(np.concatenate(held)))
    return sorted(set(found))


def _search(texts: list[bytes], table: Table) -> Iterator[tuple[int, ...]]:
    """(text, item, edits, n_words, first_word, end_word) of all items found in these texts."""
    words, counts = word_hashes(texts)
    if not len(words) or not table.samples:
        return
    last = np.cumsum(counts)
    first = last - counts
    candidates = _candidates(words, np.repeat(np.arange(len(texts)), counts), first, last, table)
    parts = table.parts
    sets = {item: set(parts[item].tolist()) for _, item, _ in candidates}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for text, item, place in candidates:
        own = parts[item]
        most = int(table.most[item])
        low = max(int(first[text]), place - 2 * most - 2)
        high = min(int(last[text]), place + len(own) + 2 * most + 2)
        if any(a <= low and high <= b for a, b in done.get((text, item), ())):
            continue
        done.setdefault((text, item), []).append((low, high))
        # So many of its words must be there at all.
        if len(sets[item].intersection(words[low:high].tolist())) < len(sets[item]) - most:
            continue
        edits, start, end = best_match(own, words[low:high])
        if edits <= most:
            got = (edits, low + start - int(first[text]), low + end - int(first[text]))
            best[text, item] = min(best.get((text, item), got), got)
    for (text, item), (edits, start, end) in sorted(best.items()):
        yield text, item, edits, len(parts[item]), start, end
