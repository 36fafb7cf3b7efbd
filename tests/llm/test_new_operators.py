"""Piece encoding, importance resampling and the prefix trie against plain re-computation."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewell.llm import pieces, prefix_trie, queries, resampling
from tradewell.llm.common import word_hashes

DOC = "doc_id long, text string"
TURN = "conv_id long, turn long, role string, text string"


# --- 11 ----------------------------------------------------------------------------------

ODD = ["", None, " ", "   ", "▁", "a▁b ▁ c", "  two  spaces   three    ", "line\nend\ttab\r\n x", "é é ﬁ   　 中文字", "\x00\x01 \x00",
       "<s> </s> <0x0A> <unk>", "😀 👩‍👩‍👧 \U0001e900", "1234567890 3.14", "x" * 3000, " " * 70, "word " * 5000, "same same same"]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.mark.parametrize("block_letters, together", [(1 << 24, 200_000), (50, 7)])
def test_pieces(spark, model, monkeypatch, block_letters, together):
    monkeypatch.setattr(pieces, "TOGETHER", together)
    path, processor = model
    rng = random.Random(2)
    letters = "ab ▁ \n.é中😀1T"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", None, None), (3, "again", "y", 2), (3, "again", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, ids int")
    got = pieces.decode_pieces(pieces.encode_pieces(df, path, block_letters=block_letters), path).collect()
    want = Counter((i, tuple([*processor.encode(t or ""), 2])) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.decoded == processor.decode(r.ids) for r in got)
    assert pieces.encode_pieces(df.limit(0), path).count() == 0


def test_pieces_of_one_long_text_without_spaces(spark, model):
    path, processor = model
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh.é") for _ in range(1_000_000))
    got = pieces.encode_pieces(spark.createDataFrame([(1, text), (2, f"{text} {text}")], DOC), path).collect()
    assert {r.doc_id: r.ids for r in got} == {1: [*processor.encode(text), 2], 2: [*processor.encode(f"{text} {text}"), 2]}


def test_models_whose_pieces_cross_marks_are_not_cut(model):
    segmenter = pieces.Segmenter(model[0])
    assert segmenter.cuts and list(segmenter.chunks("a  b")) == [["▁a", "▁▁b"]]
    segmenter.cuts = False
    assert list(segmenter.chunks("a  b")) == [["a  b"]]
    assert segmenter.segment(["a  b"]) == [model[1].encode("a  b")]


# --- 12 ----------------------------------------------------------------------------------

def resampled(docs, target, longest=1, buckets=10_000, percent=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for text in docs:
        s.update(map(bucket, features(text[1])[0]))
    for text in target:
        t.update(map(bucket, features(text)[0]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for place, (id_, text) in enumerate(docs):
        f, n = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"2024:{'null' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        out.append([id_, len(f), weight, score, n >= 20, (-score, id_ is None, id_ or 0, zlib.crc32((text or "").encode()), place)])
    able = sorted((r for r in out if r[4]), key=lambda r: r[5])
    ranks = {r[5]: k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return Counter((*r[:4], ranks.get(r[5])) for r in out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["a", "B", "c1", "dé", "e-f", "中"]) + str(rng.randrange(30)) for _ in range(rng.randrange(10, 60))))
            for i in range(400)]
    docs += [(-5, None), (401, ""), (None, docs[0][1]), (None, docs[0][1]), (None, docs[1][1]), (7, docs[7][1]), (7, docs[7][1]), (7, docs[8][1]),
             (1 << 61, "word " * 25), (403, "w" * 3_000_000), (404, "two words, " * 200_000)]
    return docs, ["a1 B2 c13 a1 a1", None, "", "a1 a2 a3 c11"]


@pytest.mark.parametrize("longest, buckets, percent, block", [(1, 10_000, 10, 4096), (2, 50, 100, 16), (3, 500, 35, 4096)])
def test_resampling(spark, corpus, monkeypatch, longest, buckets, percent, block):
    monkeypatch.setattr(resampling, "PIECE", 1000)
    monkeypatch.setattr(resampling.radix_sort, "__defaults__", (block,))
    docs, target = corpus
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, place long, digit string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance_ranks(df, wanted, longest=longest, buckets=buckets, percent=percent).collect()
    assert Counter(map(tuple, got)) == resampled(docs, target, longest, buckets, percent)


def test_resampled_documents_keep_their_columns(spark, corpus):
    docs, target = corpus
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = resampling.resampled(df, wanted, percent=20).collect()
    want = sorted(((r[4], r[0]) for r in resampled(docs, target, percent=20).elements() if r[4]), key=str)
    assert sorted(((r["__rank"], r.doc_id) for r in drawn), key=str) == want
    assert {(r.doc_id, r.text, r.score) for r in drawn} <= {(*d, "x") for d in docs}
    with pytest.raises(ValueError):
        resampling.resampled(df.withColumn("__row", F.lit(1)), wanted)


def test_resampling_of_nothing(spark):
    none, wanted = spark.createDataFrame([], DOC), spark.createDataFrame([(None,)], "text string")
    assert resampling.importance_ranks(none, wanted).count() == 0
    few = resampling.importance_ranks(spark.createDataFrame([(1, "short"), (2, None)], DOC), wanted.limit(0)).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in sorted(few)] == [(1, 1, None), (2, 0, None)]


@pytest.mark.parametrize("seed", range(3))
def test_radix_sort_is_a_stable_sort(spark, seed):
    rng = random.Random(seed)
    high = [5, 1 << 20, (1 << 40) - 1][seed]
    keys = [rng.randrange(high + 1) if i % 3 else high // 2 for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, key long").repartition(4)
    passes = resampling.digits(F.col("id"), 2999) + resampling.digits(F.col("key"), high)
    got = sorted((r.place, r.key, r.id) for r in resampling.radix_sort(df, passes, block=100).collect())
    assert [g[1:] for g in got] == sorted((k, i) for i, k in enumerate(keys)) and [g[0] for g in got] == list(range(3000))


def test_ids_at_both_ends_of_their_range(spark):
    docs = [(x, "same words here " * 10) for x in (-(1 << 63), (1 << 63) - 1, 0, -1, 5)]
    df, wanted = spark.createDataFrame(docs, DOC), spark.createDataFrame([("same",)], "text string")
    got = resampling.importance_ranks(df, wanted, percent=100).collect()
    assert Counter(map(tuple, got)) == resampled(docs, ["same"], percent=100)


# --- 13 ----------------------------------------------------------------------------------

def trie(rows, group=100, heads=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = own.get(c - c % group, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
        ends[tuple(rebuilt[c])].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1]) if path else 0
    return sorted((
        who[0], len(path), members[path[:-1]][0] if path else -1, len(who), children[path], leaves[path], saved[path],
        hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()) for path, who in members.items())


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie.prefix_trie(df).collect())


def dialogues(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), *range(150, 330), -7, 10**12, 10**12 + 3]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 17])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "bot", None]), rng.choice(["hi", "hé", "", None, "😀 long text"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_trie(spark, sized, seed):
    rows = dialogues(seed) + [(None, 1, "user", "lost"), (5, 1, "user", "hi"), (5, 1, "user", "hi")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TURN}, rep string, depth int")
    assert found(df) == trie(rows)


def test_trie_of_a_long_dialogue_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie._ends, "__defaults__", (4,))
    rows = [(c, t, "user", f"t{t}") for c in range(60, 90) for t in range(7)]  # one dialogue, thirty times
    rows += [(1, t, "ab"[t % 2], f"x{t}") for t in range(700)]
    rows += [(2, t, "ab"[t % 2], f"x{t}" if t < 650 else "other") for t in range(660)]
    assert found(spark.createDataFrame(rows, TURN)) == trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURN)
    assert prefix_trie.prefix_trie(none).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TURN)).count() == 0
    one = spark.createDataFrame([(101, None, None, None)], TURN)  # its only turn is before its own part begins
    assert found(one) == trie([(101, None, None, None)])


# --- words -------------------------------------------------------------------------------

@pytest.mark.parametrize("rounds", [5, 9, 10, 11])
def test_words_built_by_doubling_do_not_meet(rounds):
    """Sums of values times powers modulo 2^64 are equal for these two at every base."""
    a, b = "ab", "ba"
    for _ in range(rounds):
        a, b = a + b, b + a
    hashes, counts = word_hashes([a.encode(), b.encode(), f"{a} {b}".encode()])
    assert counts.tolist() == [1, 1, 2] and len(set(hashes.tolist())) == 2


def test_word_hashes_depend_on_the_word_only():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(n)) for n in [*range(1, 90), 64, 65, 500, 300_000]]
    text = "\t".join(words)
    alone = np.concatenate([word_hashes([w.encode()])[0] for w in words])
    assert word_hashes([text.encode()])[0].tolist() == alone.tolist()
    assert len(set(alone.tolist())) == len(set(words))
