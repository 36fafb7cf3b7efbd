"""The operators against plain re-computation, and on the cases data are known to have."""

from __future__ import annotations

import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tradewell.llm import (
    chat, common, decontaminate, embeddings, jaccard, mixing, queries, secrets, suffix_index, tokens, toxicity, urls,
)

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use inside.
CLASH = "doc_id long, text string, node long, component long, a string, b string, n int, __size string, id string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Near copies of one text, chains, common lines, short, empty and very long texts."""
    rng = random.Random(4)
    base = words(rng, 120, 5000)
    out = {}
    for i in range(60):
        copy = list(base)
        for _ in range(i % 9):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out[i] = " ".join(copy)
    chain = words(rng, 60, 5000)
    for i in range(60, 75):
        out[i] = " ".join(chain)
        chain = chain[4:] + words(rng, 4, 5000)
    for i in range(75, 100):
        out[i] = "A common line of ten words that many texts share\n" + " ".join(words(rng, 5 + i % 30, 60))
    out |= {100: "", 101: None, 102: "one two", 103: "ONE\ttwo", 104: "one two three four five", 105: " \n\t ",
            106: "é" * 300, 107: "é" * 300, 108: " ".join(words(rng, 30000, 10**6)), 109: "a" * 5000}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def clashing(spark):
    return spark.createDataFrame([
        (1, "a b c d e f g h", 5, 5, "x", "y", 1, "z", "q"), (2, "a b c d e f g h", 5, 5, "x", "y", 1, "z", "q"),
        (2, "other words stand in this text", None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None)], CLASH)


# --- 4 -----------------------------------------------------------------------------------

def test_similar_documents(docs, texts):
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar_documents(docs).collect()}
    assert got == brute.similar(texts)


@pytest.mark.parametrize("seed, percent", [(1, 75), (2, 60), (3, 90)])
def test_similar_documents_near_the_threshold(spark, seed, percent):
    rng = random.Random(seed)
    found, pool = {}, [words(rng, rng.randrange(8, 60), 300) for _ in range(6)]
    for i in range(150):
        text = list(rng.choice(pool))
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = f"y{rng.randrange(40)}"
        found[i] = " ".join(text[: rng.randrange(5, len(text) + 1)])
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in found.items()], DOC)
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar_documents(df, percent=percent).collect()}
    assert got == brute.similar(found, percent)


def test_long_lists_are_dealt_out(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 5)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    assert {r[0]: (r[1], r[2]) for r in jaccard.similar_documents(docs).collect()} == brute.similar(texts)


def test_groups_of_leaders_grow_with_the_input(docs, texts, monkeypatch):
    assert jaccard._groups(10, 10) == jaccard.GROUPS
    assert jaccard._groups(10**8, 10) >= 10**8 // jaccard.GROUP_SETS and jaccard._groups(10, 10**12) >= 10**12 // jaccard.GROUP_BYTES
    monkeypatch.setattr(jaccard, "GROUP_SETS", 1)
    monkeypatch.setattr(jaccard, "GROUPS", 1)
    dealt, groups = [], jaccard._groups
    monkeypatch.setattr(jaccard, "_groups", lambda *x: dealt.append(groups(*x)) or dealt[-1])
    assert {r[0]: (r[1], r[2]) for r in jaccard.similar_documents(docs).collect()} == brute.similar(texts)
    assert dealt[0] > 10


def test_counts_of_slots_are_arrays_not_rows(spark):
    rng, slots = random.Random(8), 1 << 18
    found = {i: " ".join(words(rng, 100, 10**6)) for i in range(300)}
    df = spark.createDataFrame(list(found.items()), "node long, text string").repartition(3)
    facts = jaccard._facts(df, 5, slots)
    assert facts.filter("part is null").count() == 300 and facts.count() <= 300 + 3 * slots // jaccard.PART
    want = np.zeros(slots, np.int64)
    for tokens_ in common.shingle_sets([t.encode() for t in found.values()], 5):
        np.add.at(want, (tokens_ >> np.uint64(46)).astype(np.int64), 1)
    assert want.sum() == 300 * 96 and (jaccard._slot_weights(facts, slots) == want).all()


@pytest.mark.parametrize("most", [1, 60, 1000])
def test_representatives_are_found_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
    found = {i: f"one text of {i % 90 if i < 100 else i} words or some more" for i in range(100)} | {100: "", 101: None}
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in found.items()], DOC)
    assert {r[0]: (r[1], r[2]) for r in jaccard.similar_documents(df).collect()} == brute.similar(found)


@pytest.mark.parametrize("rounds", [9, 10])
def test_words_built_by_doubling_are_apart(spark, rounds):
    a, b = "ab", "ba"
    for _ in range(rounds):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in jaccard.similar_documents(df).collect()) == [(1, 1, 1), (2, 1, 2)]
    assert decontaminate.find_leaks(df, spark.createDataFrame([(5, a)], "item_id long, text string")).select("doc_id").collect() == [(1,)]


def test_similar_documents_without_good_ids(spark):
    got = sorted(tuple(r) for r in jaccard.similar_documents(clashing(spark)).collect() if r[0] is not None)
    assert got == [(1, 4, 1), (2, 2, 2), (2, 4, 1)]
    assert jaccard.similar_documents(empty(spark)).count() == 0


# --- 3 -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(8)
    passage = " ".join(words(rng, 80, 10**6))
    out = {i: " ".join(words(rng, 50, 10**6)) + passage[i : i + 260] + " ".join(words(rng, 50, 10**6)) for i in range(12)}
    out |= {20: "ab" * 400, 21: "x" * 199, 22: "x" * 200, 23: "x" * 201, 24: None, 25: "", 26: "ü" * 150, 27: passage, 28: passage,
            29: " ".join(words(rng, 60000, 10**6)), 30: passage[:199], 31: "p" + passage + passage}
    out[32] = out[29][100_000:330_000]
    return out


@pytest.mark.parametrize("runs, batches", [(20_000, 2), (1, 3)])
def test_repeats(spark, repeats, runs, batches):
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in repeats.items()], DOC)
    out = suffix_index.remove_repeats(df, runs=runs, batches=batches)
    got = {r[0]: tuple(r[1:]) for r in out.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()}
    assert got == brute.without_repeats(repeats)


def test_repeats_without_good_ids(spark):
    long = "".join(f"{i} " for i in range(100))
    df = spark.createDataFrame([(1, long), (1, long), (None, None), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_index.remove_repeats(df).collect())
    assert got == [(0, 0, 0), (1, 290, 290), (1, 290, 290), (2, 5, 0)]
    assert suffix_index.remove_repeats(empty(spark)).count() == 0


def test_levels_merge_geometrically(spark):
    family = suffix_index.SuffixIndexFamily(spark)
    text = "".join(f"{i:04d}" for i in range(200))
    hits = []
    for k in range(7):
        part = spark.createDataFrame([(k, text if k in (2, 6) else str(k) * 300)], "node long, text string")
        hits.append(family.add(part).count() > 0)
    assert [size for size, _ in family.levels] == [4, 2, 1]
    assert hits[2] is False and hits[6] is True
    assert {r.node for r in family.repeated_entries().select("node").distinct().collect()} >= {2, 6}


# --- 2 -----------------------------------------------------------------------------------

def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 32))
    vectors = [centres[i % 30] + rng.standard_normal(32) * 0.02 * (i % 13) for i in range(600)]
    rows = [(i, [float(x) for x in np.float32(v)], i % 3) for i, v in enumerate(vectors)]
    rows += [(600 + i, rows[0][1], 9) for i in range(50)] + [(650, [2 * x for x in rows[0][1]], 1)]
    odd = [(700, None, 0), (701, [0.0] * 32, 0), (702, [float("nan")] + [1.0] * 31, 0), (703, [None] + [1.0] * 31, 0),
           (704, [], 0), (705, [float("inf")] + [1.0] * 31, 0), (706, [1.0, 2.0], 0), (707, [1e30, 2e30], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= 0.95
    group = brute.classes(range(len(rows)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i > j])
    names = [r[0] for r in rows]
    want = {names[i]: (int(near[i].sum()) - 1, names[group[i]], group[i] == i) for i in range(len(rows))}
    agree = sum(got[k] == v for k, v in want.items()) / len(want)
    assert agree > 0.99 and all(got[k][0] <= v[0] for k, v in want.items())
    assert all(got[k] == (0, k, True) for k in range(700, 706))
    assert got[706] == (1, 706, True) and got[707] == (1, 706, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# --- 1 -----------------------------------------------------------------------------------

def test_leaks(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n, 900))) for i, n in enumerate([3, 6, 9, 15, 20, 38, 59, 100])]
    items += [(20, None), (21, ""), (22, items[4][1])]
    rows = [(100, None), (101, ""), (102, "nothing here"), (103, " ".join(words(rng, 20000, 900)))]
    for k, (i, text) in enumerate(items[:8]):
        before, after = " ".join(words(rng, 40, 900)), " ".join(words(rng, 25, 900))
        parts = text.split()
        edited = list(parts)
        for _ in range(len(parts) // 8):
            edited[rng.randrange(len(edited))] = "zz"
        rows += [(k, f"{before} {text.upper()}\n{after}"), (50 + k, f"{before} {' '.join(edited)} {after}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(df, bench, items=4).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    want = {}
    for d, text in rows:
        for i, item in items:
            if text and item:
                own, all_words = item.lower().split(), text.lower().split()
                n = brute.edits(own, all_words)
                if n <= len(own) // 4:
                    want[d, i] = n
    assert got == want
    assert all(0 <= r.first_word < r.end_word for r in found)
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("kind", range(3))
@pytest.mark.parametrize("n", [4, 8, 20, 56, 60, 104, 200])
def test_leaks_reach_their_recall(n, kind):
    """Copies with 25 % of their words replaced, deleted or inserted, evenly spread or anywhere."""
    rng = random.Random(n * 3 + kind)
    pool = [f"w{i}" for i in range(30_000)]
    items, rows = [rng.sample(pool, n) for _ in range(100)], []
    for k, item in enumerate(items):
        at = {(2 * i + 1) * n // (2 * (n // 4)) for i in range(n // 4)} if k % 2 else set(rng.sample(range(n), n // 4))
        copy = [x for i, w in enumerate(item) for x in ([w] if i not in at else [["zz"], [], ["zz", w]][kind])]
        rows.append(rng.sample(pool, 30) + copy + rng.sample(pool, 30))
    table = decontaminate.Table([(i, " ".join(x).encode()) for i, x in enumerate(items)], 0.75)
    found = {(d, i): e for d, i, e, *_ in decontaminate._search([" ".join(x).encode() for x in rows], table)}
    some = range(0, 100, 10 if n > 60 else 1)
    assert all(brute.edits(items[k], rows[k]) <= n // 4 for k in some)
    assert all(found[k, k] == brute.edits(items[k], rows[k]) for k in some if (k, k) in found)
    assert sum((k, k) in found for k in range(100)) >= 98
    size, _, _ = decontaminate.plan(n)
    assert size <= n // 2


def test_unchanged_items_are_always_found():
    items = [["the"] * n for n in range(1, 30)] + [words(random.Random(n), n, 3) for n in range(1, 60)]
    texts = [" ".join(x).encode() for x in items]
    found = {(d, i): e for d, i, e, *_ in decontaminate._search(texts, decontaminate.Table(list(enumerate(texts)), 0.75))}
    assert all(found[i, i] == 0 for i in range(len(items)))


# --- 5 -----------------------------------------------------------------------------------

def test_secrets(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = "".join(rng.choice(alphabet) for _ in range(64))
    rows = [(1, 'TOKEN = "abcdef" and apikey:x'), (2, "AKIA" + "Z" * 16 + " é " + "0123456789abcdef" * 2), (3, None), (4, ""),
            (5, f"some words {token} more"), (6, "aaaaaaaaaaaa1bbbbbbbbbbbbbbbbAAAAAAAAAAAAAAAA" * 3), (7, "paßword=secret"),
            (8, "ſecret=abcdefgh"), (9, "password password=hunter22")]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def spans(k, which="base"):
        return [tuple(s) for s in got[k][which]]

    assert spans(1) == [(0, 15, "assign")]
    assert spans(2) == [(0, 20, "access"), (23, 55, "hex")]
    assert spans(5, "added") == [(11, 75, "base62")] and spans(6, "added") == []
    assert spans(3) == spans(4) == spans(7) == spans(8) == [] and spans(9) == [(9, 26, "assign")]


def test_rest_of_a_candidate_beside_a_base_span(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.choice(alphabet) for _ in range(63)) + "Z"
    text = f"see {key}/AKIA{'Q' * 20}"
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [tuple(s) for s in found.base] == [(69, 93, "access")]
    assert [(s.start, s.end) for s in found.added] == [(4, 69)]


def test_randomness_battery():
    rng = random.Random(2)
    places = {c: i for i, c in enumerate(dict(secrets.ENCODINGS)["base62"])}
    p = [secrets.battery("".join(rng.choice(list(places)) for _ in range(80)), places) for _ in range(300)]
    assert sum(x < 0.05 for x in p) < 30
    assert secrets.battery("abab" * 20, places) < 1e-6 and secrets.battery("thequickbrownfoxjumps" * 4, places) < 1e-6


# --- 6 -----------------------------------------------------------------------------------

def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ana", "Hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "x<|y", "é!"),
            (2, 0, "system", "alone"), (None, None, None, "lost"), *[(3, i // 2, "ab"[i % 2], f"t{i}") for i in range(20)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.perspectives(df, per_row=8).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "ana"), (1, "bob"), (1, "x<|y"), (None, "unknown"), (3, "a"), (3, "b")}
    bob = next(r for r in got if (r.conv_id, r.speaker) == (1, "bob"))
    assert bob.rendered == ("<|system|>\nBe kind.<|end|>\n<|user name=ana|>\nHi<|end|>\n<|assistant|>\n<|end|>\n"
                            "<|assistant|>\n<|end|>\n<|user name=x__y|>\né!<|end|>\n")
    assert [bob.rendered[s.start : s.end] for s in bob["mask"]] == ["<|end|>", "<|end|>"]
    parts = sorted((r.chunk, r.n_turns, r.rendered) for r in got if (r.conv_id, r.speaker) == (3, "a"))
    assert [p[1] for p in parts] == [8, 8, 4]
    assert "".join(p[2] for p in parts).count("<|assistant|>") == 10
    assert chat.perspectives(df.limit(0)).count() == 0


# --- 7 -----------------------------------------------------------------------------------

def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    rows += [(3000, None, "s1"), (3001, "x", None), (3002, " ", "none"), (None, "a b", "s2"), (5, "a b", "s2"), (5, "a b", "s2")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, offset string")
    got = mixing.copies(df).collect()
    assert len(got) == len(rows) and all(0 <= r["__copies"] <= 3 for r in got)
    sources = {}
    for r in got:
        at = sources.setdefault(r.source, [r["__target"], r["__source_size"], 0])
        at[2] += r["__copies"] * r["__size"]
    total = sum(s for _, s, _ in sources.values())
    assert sum(t for t, *_ in sources.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 for t, s, _ in sources.values())
    assert all(abs(taken - t) <= 60 for t, _, taken in sources.values())
    level = [sources[f"s{i}"][0] / (1 + (["none", *(f"s{j}" for j in range(7))].index(f"s{i}") % 3)) for i in range(7)]
    free = [x for i, x in enumerate(level) if sources[f"s{i}"][0] < 3 * sources[f"s{i}"][1] - 1e-6]
    assert max(free) == pytest.approx(min(free))
    again = {(r.doc_id, r["__size"]): r["__copies"] for r in mixing.copies(df.repartition(5)).collect() if r.doc_id != 5}
    assert again == {(r.doc_id, r["__size"]): r["__copies"] for r in got if r.doc_id != 5}
    mix = mixing.mixed(df)
    assert mix.columns == df.columns and mix.count() == sum(r["__copies"] for r in got)
    assert mixing.copies(df.limit(0)).count() == 0


def test_rows_without_ids_spread_over_the_groups(spark):
    """A third of all rows has no id; their texts alone deal them out."""
    rows = [(None if i % 3 == 0 else i, f"w{i} " * 8, "s") for i in range(20_000)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                              F.md5("text"))), 1, 8), 16, 10).cast("long")
    groups = 1 << (20_000 // mixing.GROUP).bit_length()
    largest = got.groupBy(F.floor(key * groups / (1 << 32))).count().agg(F.max("count")).first()[0]
    assert got.count() == 20_000 and largest <= 2 * mixing.GROUP


# --- 8 -----------------------------------------------------------------------------------

def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/1?x"), (2, "https://example.net/EN/"), (3, "https://b.example.com/de/x"), (4, "x://org/fr/?/a"),
            (5, "no scheme"), (6, None), (7, "http://"), (8, "http://notnet/"), (9, "ftp://u.net"), (10, "http://h.net#a/b"), (11, "a://b://c.net/")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i, _ in rows] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("example.net", "/EN/", "net/"), ("b.example.com", "/de/x", "example.com/de/"),
        ("org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("", "", None), ("notnet", "/", None), ("u.net", "", None),
        ("h.net", "", None), ("b:", "//c.net/", None)]
    assert (got[1].verdict, got[2].verdict, got[3].verdict, got[5].verdict) == ("allow", "block", "block", "allow")


def test_mined_rules_match_a_plain_count(spark):
    rng = random.Random(6)
    baskets = [(sorted({rng.choice("abcdef") for _ in range(3)}), rng.choice(["allow", "block"])) for _ in range(200)]
    baskets = [(b, "block" if "a" in b else label) for b, label in baskets]
    df = spark.createDataFrame(baskets, "items array<string>, label string")
    got = {(tuple(r.antecedent), r.label) for r in urls.mine_rules(df, 0.02, 0.8).collect()}
    want = {}
    for b, label in baskets:
        for mask in range(1, 1 << len(b)):
            key = tuple(x for i, x in enumerate(b) if mask >> i & 1)
            for seen in (label, None):
                want[key, seen] = want.get((key, seen), 0) + 1
    strong = {(k, lab): n / want[k, None] for (k, lab), n in want.items() if lab and n >= 0.02 * 200 and n / want[k, None] >= 0.8}
    least = {(k, lab) for (k, lab), c in strong.items() if not any(
        set(o) < set(k) and l2 == lab and c2 >= c for (o, l2), c2 in strong.items())}
    assert got == least


def test_long_rules_and_copies_of_long_urls(spark):
    """Only all of a..f together mean block; a large group of equal urls of 40 tokens is mined quickly."""
    five = [[x for x in "abcdef" if x != y] for y in "abcdef"]
    baskets = [(list("abcdef"), "block")] * 20 + [(b, "allow") for b in five for _ in range(3)]
    long = [f"t{i:02d}" for i in range(40)]
    baskets += [(long, "block")] * 20
    df = spark.createDataFrame(baskets, "items array<string>, label string")
    classes = urls.token_classes(df, 0.02)
    rules = urls.mine_rules(df, 0.02, 0.95, classes).cache()
    assert {(tuple(r.antecedent), r.label) for r in rules.collect()} == {(tuple("abcdef"), "block"), (("t00",), "block")}
    asked = [[*"abcdef", "z"], [*"abcde", "z"], ["t07", "t31", "z"], ["z"]]
    found = urls.match_rules(spark.createDataFrame([(a,) for a in asked], "items array<string>"), rules, classes)
    assert {tuple(r["items"]): (r.label, r.antecedent) for r in found.collect()} == {
        tuple(asked[0]): ("block", list("abcdef")), tuple(asked[2]): ("block", ["t07"])}


# --- 9 -----------------------------------------------------------------------------------

def test_segments_match_the_definition():
    model = toxicity.Model({"x": 3.0, "y": 1.5}, -1.0, 1.0, ((0.0, 0.0),))
    rng = random.Random(3)
    for _ in range(200):
        text = [rng.choice("xyabcd") for _ in range(30)]
        scores = [model.weights.get(w, model.other) for w in text]
        want, parts = [], [(0, 30)]
        while parts:  # the best segment, then the same to its left and right
            low, high = parts.pop()
            best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
            if best[0] > 0:
                i = -best[2]
                want.append((i, i - best[1], best[0]))
                parts += [(low, i), (i - best[1], high)]
        got = model.segments(text)
        assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in want))


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(800):
        toxic = i % 5 == 0
        text = ["".join(chr(97 + int(c)) for c in w[1:]) for w in words(rng, rng.randrange(20, 300), 300)]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "nasty", "awful"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "VILE nasty, awful!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.training_labels(known))
    assert set(model.weights) == {"vile", "nasty", "awful"}
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["__predicted"] == t for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[902]["__predicted"] == 1 and got[900]["__score"] == got[901]["__score"] < 0.1
    nothing = toxicity.fit(docs, known.limit(0))
    assert not nothing.weights and toxicity.score(docs.limit(0), nothing).count() == 0


def test_every_toxic_token_is_kept(spark):
    names = ["v" + "".join("abcdefghij"[int(d)] for d in f"{i:05d}") for i in range(21_000)]
    toxic, clean = " ".join(names), " ".join("c" + x for x in names)
    docs = spark.createDataFrame([(i, toxic if i < 50 else clean) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(100)], "doc_id long, toxic int")
    assert set(toxicity.fit(docs, labels).weights) == set(names)


# --- 10 ----------------------------------------------------------------------------------

@pytest.mark.parametrize("width", [2, 4])
def test_tokens(spark, texts, width, tmp_path):
    from tokenizers import Tokenizer

    more = {200: "Ünïcode e\u0301 İSTANBUL ΣΑΣ <|endoftext|> a<|startoftext|>b\tx\r\ny\u00a0z\u2003q  it's 12,5 !!\x1c?"}
    rows = [(k, t) for k, t in {**texts, **more}.items()]
    df = spark.createDataFrame([*rows, (None, "x"), (104, "again"), (104, "again")], "doc_id long, text string")
    manifest = tokens.write_tokens(df, queries.vocabulary(), str(tmp_path / "ids"), width=width)
    got = sorted(tokens.read_tokens(manifest, width, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([k for k, _ in rows] + [104, 104])]
    tokenizer, at, known = Tokenizer.from_file(queries.vocabulary()), 0, dict(rows)
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id not in (None, 104):
            assert r.ids == [*tokenizer.encode(known[r.doc_id] or "", add_special_tokens=False).ids, 1]
        at += len(r.ids)
    empty_manifest = tokens.write_tokens(df.limit(0), queries.vocabulary(), width=width)
    assert tokens.read_tokens(empty_manifest, width).count() == 0


def test_encoder_memory_is_bounded_in_bytes(monkeypatch):
    """Long pieces are never remembered, and what is remembered starts anew beyond its bytes."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMORY", 100_000)
    tokenizer, encoder, rng = Tokenizer.from_file(queries.vocabulary()), tokens.Encoder(queries.vocabulary(), np.dtype("<u2")), random.Random(4)
    long = "".join(rng.choice("abcdefgh,") for _ in range(200_000))
    most = 0
    for _ in range(40):
        texts = [" ".join(words(rng, 50, 10**6)) for _ in range(5)] + [f"a {long}. b" if _ == 7 else "x"]
        got = encoder.batch(texts)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        most = max(most, len(encoder.known) + len(encoder.before))
        assert all(len(x) <= tokens.LONGEST for x in encoder.known)
    assert most < 1500 and encoder.held < 300_000


def test_tokens_of_a_long_piece_without_spaces(spark):
    text = "".join(random.Random(8).choice("abcdefgh") for _ in range(2_000_000))
    manifest = tokens.write_tokens(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), queries.vocabulary(), width=2)
    got = {r.doc_id: r.n_tokens for r in tokens.read_tokens(manifest, 2).collect()}
    assert got[2] == 2 and got[1] > 100_000


def test_encoder_of_odd_texts():
    """Lowering, marks behind words and letters that decompose change no id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    encoder = tokens.Encoder(queries.vocabulary(), np.dtype("<u2"))
    letters, rng = "abAB'sStlLdé́İΣσς.,;:!? \n ½3中ſKﬁ\U0001e900̇ͅIi", random.Random(1)
    odd = ["", "<|STARTOFTEXT|> <|endoftext|>, a<|endoftext|>", "ﬁ, ǅ. क़, नमस्ते, \x85a, ​z. 'S, a'S. ª, ʰ. ß! ẞ."]
    for text in odd + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.batch([text])[0], "<u2").tolist() == want, ascii(text)


def test_encoder_looks_up_only_the_pieces_of_a_batch():
    """What a batch costs does not grow with the words that are remembered."""
    import time

    encoder = tokens.Encoder(queries.vocabulary(), np.dtype("<u2"))
    encoder.batch(["some words of a text"])
    encoder.known.update((str(i), b"") for i in range(1_000_000))
    began = time.process_time()
    for _ in range(200):
        encoder.batch(["some words of a text"])
    assert time.process_time() - began < 2


def test_encoder_learns_a_word_once_for_all_its_capitals_and_marks():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    encoder, rng = tokens.Encoder(queries.vocabulary(), np.dtype("<u2")), random.Random(3)
    assert encoder.plain.get_vocab_size(with_added_tokens=False) == tokenizer.get_vocab_size(with_added_tokens=False)
    texts = ["Thandor THANDOR thandor$$$ Thandor&&& thandor?!, thandor", "<|STARTOFTEXT|>A <|startoftext|>B É\xc0", "A'S, b's$ c_d e-f g\u0338= H\u0331 h\u0331"]
    letters = "abABéÉß'sS\xa0\x85\t\r\n  12" + string.punctuation
    for _ in range(5000):
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 14))))
    for text in texts:
        got = np.frombuffer(encoder.batch([text])[0], "<u2").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
    encoder = tokens.Encoder(queries.vocabulary(), np.dtype("<u2"))
    learnt: list[str] = []
    for name in ("_learn_words", "_learn_pieces"):
        def learn(pieces, *rest, own=getattr(encoder, name)):
            learnt.extend(pieces)
            return own(pieces, *rest)

        setattr(encoder, name, learn)
    encoder.batch(texts[:1])
    assert sorted(learnt) == ["$$$", "&&&", "?!,", "thandor"]


def test_workers_give_back_memory_when_a_task_ends(monkeypatch):
    """Also when nobody reads on, and when the work fails."""
    from tradewell.llm import common

    calls: list[int] = []
    monkeypatch.setattr(common, "release_memory", calls.append)

    def work(batches):
        for x in batches:
            yield 1 // x

    assert list(common.returning(work)([1, 1])) == [1, 1] and len(calls) == 1
    begun = common.returning(work)([1, 1])
    next(begun)
    begun.close()
    assert len(calls) == 2
    with pytest.raises(ZeroDivisionError):
        list(common.returning(work)([0]))
    assert len(calls) == 3
