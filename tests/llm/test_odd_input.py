"""Operators and stages on empty tables, clashing names, null and repeated ids, and very long texts."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tradewell.llm import chat, decontaminate, pieces, resampling, secrets, suffix_index, tokens, toxicity, urls
from tradewell.llm.common import prepare
from tradewell.llm.queries import URL_RULES, vocabulary

FOLDER = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the input.
NAMES = ("node", "item", "label", "spans", "conv", "host", "items", "id", "key", "base", "score", "place", "block", "digit", "words", "n")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "en", "web", 1, *["x"] * len(NAMES)) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    long = " ".join(rng.choices(words, k=200_000))
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(30)]
    rows += [(None, "lost " + rows[0][1]), (None, rows[1][1] + " more"), (7, "again " + rows[2][1]), (7, "once " + rows[3][1]), (40, None), (41, ""),
             (42, " \n\t"), (43, long), (44, "a" * 400_000), (45, "short")]
    return clashing(spark, rows)


ITEMS = "item_id long, text string, node string, id string"
OPERATORS = {
    "leaks": lambda docs: decontaminate.find_leaks(docs, docs.sparkSession.createDataFrame([(1, "w1 w2 w3 w4 w5 w6", "n", "i")], ITEMS)),
    "repeats": lambda docs: suffix_index.remove_repeats(docs),
    "secrets": lambda docs: secrets.find_secrets(docs),
    "toxicity": lambda docs: toxicity.score(docs, toxicity.fit(docs, toxicity.training_labels(
        docs.sparkSession.createDataFrame([(1, 1, "x"), (2, 0, "y")], "doc_id long, toxic int, text string")))),
    "tokens": lambda docs: tokens.read_tokens(tokens.write_tokens(docs, vocabulary(), width=2), width=2),
    "pieces": lambda docs: pieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model")),
    "resampling": lambda docs: resampling.importance_ranks(docs, docs.limit(3)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_on_odd_tables(odd, name):
    out = OPERATORS[name](odd)
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    if name != "leaks":
        assert ids == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_urls_and_dialogues_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "p", "q"), (None, None, "p", "q"), (1, "http://a.net/x", "p", "q")],
                                  "page_id long, url string, items string, label string")
    got = urls.filter_urls(pages, URL_RULES).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "block"), (1, "block")]
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0
    turns = spark.createDataFrame([(1, 1, "ana", "hi", "x", 5), (1, 2, "bob", "yo", "x", 5)],
                                  "conv_id long, turn long, role string, text string, conv string, n int")
    assert chat.perspectives(turns).count() == 2


def test_constant_and_periodic_texts_lose_what_repeats(spark):
    texts = {1: "b" * 60_000, 2: "xy" * 20_000 + "end", 3: "c" * 199, 4: "c" * 200, 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_index.remove_repeats(df).collect()}
    assert got == {1: (60_000, 60_000), 2: (40_003, 40_000), 3: (199, 0), 4: (200, 0), 5: (0, 0)}


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_tables(spark, odd, place):
    name, stage = corpus_pipeline.STAGES[place]
    rows = odd.count()
    out = stage(spark, odd, FOLDER)
    last = place == len(corpus_pipeline.STAGES) - 1
    if last:
        assert out.count() == rows
    else:
        assert out.columns == odd.columns and set(map(str, out.collect())) <= set(map(str, odd.collect()))
    if name in ("toxicity", "decontamination"):
        assert out.count() == rows  # nothing of this is toxic or a benchmark item
    if name == "similar documents":
        kept = {k: t for k, t in enumerate(r.text for r in odd.orderBy(F.monotonically_increasing_id()).collect())}
        assert out.count() == len({c for _, c in brute.similar(kept).values()})
    empty = stage(spark, odd.limit(0), FOLDER)
    assert empty.count() == 0 and (last or empty.columns == odd.columns)


def test_token_files_of_the_pipeline_are_small(spark, monkeypatch):
    """A task sorts the rows of one file: the pipeline's files are bounded, and their size changes no row."""
    docs = spark.createDataFrame([(i, f"text {i} " * 200) for i in range(64)], "doc_id long, text string")
    files = []
    written = tokens.write_tokens

    def write(*args, **options):
        files.append(written(*args, **options))
        return files[-1]

    monkeypatch.setattr(tokens, "write_tokens", write)
    whole = corpus_pipeline.write_ids(spark, docs, FOLDER).collect()
    monkeypatch.setattr(corpus_pipeline, "TOKEN_FILE_BYTES", 4000)
    assert sorted(corpus_pipeline.write_ids(spark, docs, FOLDER).collect()) == sorted(whole)
    assert files[0].count() <= spark.sparkContext.defaultParallelism < files[1].count()


def test_arrow_batches_are_bounded_in_bytes(spark):
    """A batch is held several times by the executor's JVM and by its Python worker."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes], "n": [batch.num_rows]})

    docs = prepare(spark).range(0, 3000, 1, 1).select("id", F.lpad(F.col("id").cast("string"), 8192, "x").alias("text"))
    made = docs.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r.n for r in made) == 3000
    assert max(r.size for r in made) < 3 << 20
