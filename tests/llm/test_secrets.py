"""The secret scan: the whole query again in plain Python, its power by encoding, and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tradewell.llm import queries, secrets

FOLDER = "/root/testdata/sf0.001"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def plain(texts, rate=0.01, miss=0.001):
    """[(base, added, tested, random)] for a list of texts, with the rule applied to sorted p-values."""
    counts = np.zeros(256)
    for text in texts:
        rest = re.sub(r"[A-Za-z0-9+/_-]{16,}={0,2}", " ", text or "")
        counts += np.bincount(np.frombuffer(rest.encode(), np.uint8), minlength=256)
    known, rows, groups = secrets.ordinary(counts), [], {}
    for text in texts:
        base = [(a, b, ("assign", "access", "hex")[k]) for a, k, b in plain_base(text or "")]
        own = []
        for a, b in secrets.outside(text or "", base):
            kind, places = secrets.infer(text[a:b])
            p = 10 ** (-min(400, int(-20 * math.log10(max(1e-20, secrets.evidence(text[a:b], places, known[kind]))))) / 20)
            own.append((a, b, kind, p, secrets.battery(text[a:b], places) >= miss))
            groups.setdefault((kind, (b - a).bit_length()), []).append(p)
        rows.append((base, own))
    limit = {}
    for group, ps in groups.items():
        ps.sort()
        limit[group] = max((p for k, p in enumerate(ps, 1) if p <= rate * k / len(ps)), default=-1.0)
    return [(base, [(a, b, kind) for a, b, kind, p, ok in own if ok and p <= limit[kind, (b - a).bit_length()]],
             len(own), sum(ok for *_, ok in own)) for base, own in rows]


def spelled(spans, order):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order.index(s[2]))))


def test_query_against_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    order = ["assign", "access", "hex", *(k for k, _ in secrets.ENCODINGS)]
    want = {}
    for id_, (base, added, tested, passed) in zip(texts, plain(list(texts.values())), strict=True):
        kinds = [k for *_, k in base]
        want[id_] = (
            kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
            hashlib.sha256(spelled(base, order).encode()).hexdigest(), spelled(base + added, order), tested, passed)
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op5_secrets"](spark, FOLDER).collect()}
    assert got == want
    assert sum(w[5] for w in want.values()) > 0


def text_around(rng, secret):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [" ".join("".join(rng.choices(letters, secrets.ENGLISH, k=rng.randrange(2, 9))) for _ in range(12)) for _ in range(2)]
    return f"{words[0]} {secret} {words[1]}"


@pytest.mark.parametrize("length", [16, 20, 32, 64])
def test_random_strings_of_every_encoding_are_found(spark, length):
    rng = random.Random(length)
    rows = []
    for kind, chars in secrets.ENCODINGS[1:]:
        rows += [(len(rows) + i, kind, text_around(rng, "".join(rng.choices(chars, k=length)))) for i in range(50)]
    words = [len(rows) + i for i in range(500)]
    ordinary = [text_around(rng, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", secrets.ENGLISH, k=length))) for _ in words]
    table = spark.createDataFrame([(i, t) for i, _, t in rows] + list(zip(words, ordinary, strict=True)), "doc_id long, text string")
    got = {r.doc_id: len(r.base) + len(r.added) for r in secrets.find_secrets(table).collect()}
    shares = {kind: sum(got[i] > 0 for i, k, _ in rows if k == kind) / 50 for kind, _ in secrets.ENCODINGS[1:]}
    # Beside ten times as many ordinary strings of its group, a short one tells less in some alphabets.
    least = {"hexupper": {16: 0, 20: 0.5}, "base32": {16: 0.7, 20: 0.8}, "upper": {16: 0.8}, "lower": {16: 0.8, 20: 0.85}}
    assert all(share >= least.get(kind, {}).get(length, 0.94) for kind, share in shares.items()), shares
    assert sum(got[i] > 0 for i in words) <= 5


@pytest.mark.parametrize("chars", ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
def test_letters_alone_in_a_small_table(spark, chars):
    rng = random.Random(4)
    key = "".join(rng.choices(chars, k=64))
    [row] = secrets.find_secrets(spark.createDataFrame([(1, f"see {key}")], "doc_id long, text string")).collect()
    assert [(s.start, s.end) for s in row.added] == [(4, 68)] and (row.n_tested, row.n_random) == (1, 1)


def test_ordinary_words_and_numbers_are_not(spark):
    folder = "/root/testdata/sf0.01"
    got = secrets.find_secrets(spark.read.parquet(f"{folder}/documents.parquet")).selectExpr(
        "sum(size(added)) as added", "sum(n_tested) as tested").first()
    assert got.tested > 100 and got.added == 0
    numbers = [(i, f"call {random.Random(i).randrange(10**19, 10**20)} now") for i in range(100)]
    assert secrets.find_secrets(spark.createDataFrame(numbers, "doc_id long, text string")).filter("size(added) > 0").count() == 0


def test_odd_rows(spark):
    key = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40))
    rows = [(1, None, 1), (None, "", 2), (7, key, 3), (7, key, 3), (8, "a" * 3_000_000, 4), (9, f"{'ab ' * 500_000}{key}", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more int").withColumnRenamed("more", "base")
    got = secrets.find_secrets(df).collect()
    assert sorted((r.doc_id or 0, len(r.added)) for r in got) == [(0, 0), (1, 0), (7, 1), (7, 1), (8, 0), (9, 1)]
    assert secrets.find_secrets(df.limit(0)).count() == 0
