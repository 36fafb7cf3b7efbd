"""The registered queries: SQL where there is some, brute force on a small table elsewhere."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm import brute
from tests.oracle import connect, difference
from tradewell.llm.queries import ORACLES, QUERIES, URL_RULES, vocabulary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert difference(connect(FOLDER), QUERIES[name](spark, FOLDER), ORACLES[name]) is None


def test_similar(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, FOLDER).collect()}
    assert got == brute.similar(texts)


def test_repeats(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_suffix_dedup"](spark, FOLDER).collect()}
    assert got == brute.without_repeats(texts)


def test_leaks(spark, texts):
    """Every document against every item by edit distance, where enough of the item's words are there at all."""
    items = {r["item_id"]: brute.WORD.findall((r["text"] or "").translate(brute.ASCII_LOWER))
             for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()}
    want = {}
    for doc, text in texts.items():
        own = brute.WORD.findall((text or "").translate(brute.ASCII_LOWER))
        for item, words in items.items():
            if words and len(set(words) & set(own)) >= len(set(words)) - len(words) // 4:
                edits = brute.edits(words, own)
                if edits <= len(words) // 4:
                    want[doc, item] = edits
    found = QUERIES["op1_decontaminate"](spark, FOLDER).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in found} == want and len(found) == len(want) > 0


def test_url_rules(spark):
    """Host, path and given rule again in plain Python; the method decides only where no rule does."""
    pages = {r["page_id"]: r["url"] or "" for r in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()}
    got = {r.page_id: r for r in QUERIES["op8_url_filter"](spark, FOLDER).collect()}
    assert got.keys() == pages.keys()
    for page, url in pages.items():
        _, sep, rest = url.partition("://")
        at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = rest[:at].translate(brute.ASCII_LOWER) if sep else ""
        tail = rest[at:] if sep else ""
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(h + p, verdict) for h, p, verdict in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule), url
        assert got[page].verdict == verdict if rule else got[page].verdict in ("allow", "block")


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = QUERIES["op9_toxicity"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    found = [p for t, p in judged if t]
    marked = [p for t, p in judged if not t]
    assert sum(found) >= 0.8 * len(found) and sum(marked) <= 0.03 * len(marked)


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(vocabulary()), 0
    got = {r.doc_id: tuple(r[1:4]) for r in QUERIES["op10_tokens"](spark, FOLDER).collect()}
    for doc in sorted(texts):
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {}
    for doc, text in texts.items():
        ids = [*model.encode(text or ""), model.eos_id()]
        want[doc] = (len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids)))
    assert {r.doc_id: tuple(r[1:]) for r in QUERIES["op11_pieces"](spark, FOLDER).collect()} == want


def test_pipeline(spark, texts):
    """Every stage drops what it must; the last one writes what the one before has left."""
    docs = corpus_pipeline.table(spark, FOLDER, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.saved(stage(spark, docs, FOLDER), "stage")
        assert after.columns == docs.columns
        left = {r.doc_id for r in after.collect()}
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "similar documents":
            assert left == {k for k, (_, c) in brute.similar(before).items() if c == k}
        if name == "decontamination":
            items = [brute.WORD.findall(r["text"].lower()) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
            for k, text in before.items():
                own = brute.WORD.findall(text.translate(brute.ASCII_LOWER))
                near = [i for i in items if len(set(i) & set(own)) >= 0.7 * len(set(i))]
                assert (k in left) == (not any(brute.edits(i, own) <= len(i) // 4 for i in near))
        docs = after
    mixed = sorted(r.doc_id for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == mixed and sum(r.n_tokens for r in out) > 0


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """Copies of one id or without ids go, and a clean row stays whatever its id."""
    x, y, z, leak = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyzl")
    rows = [(5, x), (5, z), (1, x), (2, y), (2, y), (None, y + " end"), (None, "n " + z), (None, leak), (7, leak), (7, "clean"),
            (None, None), (None, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, "")
    key = lambda r: str(r)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=key) == sorted(
        [(1, x), (2, y), (5, z), (7, leak), (7, "clean"), (None, None), (None, ""), (8, None)], key=key)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert sorted((tuple(r) for r in left.collect()), key=key) == sorted((r for r in rows if r[1] != leak), key=key)
