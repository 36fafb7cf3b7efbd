"""Envelopes read in pieces against the reader that sees a whole file."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driver_queries.stored import land_document, land_documents
from tests.conftest import rows
from tradewell.sources import envelopes, feeds

FEED = feeds.Feed(
    T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.StringType())])))]),
    ("Data", "results"), {"a": "valor"})
ODD = [
    '{"status":"OK","results":[]}', '{"status":"OK","results":[{}]}', '{"status":"OK"}', "{}", "", "[]", "5", "<html>{no}</html>",
    '{"status":"ERROR","results":[{"a":1}]}', '{"status":"OK","results":[{"a":1},{"a":2}', '{"status":"OK","results":null}',
    '﻿{"status":"OK","results":[{"a":"ñ"}]}\n', '{"results":[{"a":1}],"status":"OK"}', '{"status":"OK","Data":[],"results":[{"a":1}]}',
    '{"status":"OK","results":[{"a":1}],"Data":[{"a":2},3]}', '{"status":"OK","meta":{"x":{"results":[1]}},"results":[{"a":1}]}',
    '{"status":"OK","otro":[{"a":9},{"a":8}],"results":[{"a":1}]}', '{ "status" : "OK" ,\n "results" : [ 1 , {"a" : 1 } , "}" , null , [ {"a":5} ] , {"a":2} , 7 ] }',
    '{"status":"OK","results":["]}","{[",{"a":"}\\"{[,]"},{"a":"\\\\"},{"a":"\\\\\\"}"}]}', '{"status":"OK","results":[[[[[[[[[]]]]]]]],{"a":1}]}',
    '{"status":"OK","results":[{"a":1}]}}', '{"status":"OK","results":[{"a":"1"}],"nota":"x}]"}', '{"status":"}","results":[{"a":1}]}',
    '{"status":"OK","results":[[],[],{"a":1},[]]}',
]


def texts(seed):
    rng = random.Random(seed)
    words = ["", "}", "{", "[", "]", ",", '"', "\\", "ñ😀", "x" * 40, "\n", '\\"}']

    def item():
        kind = rng.randrange(8)
        if kind < 5:
            return {"a": "".join(rng.choices(words, k=rng.randrange(4))), "b": [{"c": rng.choice(words)} for _ in range(rng.randrange(3))]}
        return [rng.choice(words), rng.randrange(99), [item() for _ in range(rng.randrange(3))]][kind - 5]

    out = []
    for _ in range(12):
        document = {"status": "OK", rng.choice(["Data", "results"]): [item() for _ in range(rng.randrange(30))], "fin": rng.choice(words)}
        out.append(json.dumps(document, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
    return out


def land(folder, documents):
    paths = {}
    for company, own in documents.items():
        (folder / company).mkdir(parents=True)
        for i, text in enumerate(own):
            (folder / company / f"{i:03d}.json").write_text(text, encoding="utf-8")
        paths[company] = str(folder / company)
    return paths


def plain(df):
    return rows(df.select("empresa_erp", F.regexp_extract("archivo", "([^/]*)$", 1), "posicion", "valor", F.to_json("b")))


@pytest.mark.parametrize("bytes_", [1, 7, 40, 1 << 20])
def test_files_cut_anywhere(spark, tmp_path, bytes_):
    folders = land(tmp_path, {"ODD": ODD, "UNO": texts(1), "DOS": texts(2)}) | {"NADA": str(tmp_path / "nada")}
    want = plain(feeds.read_envelopes(spark, folders, FEED))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    # Splits of one byte would be many thousand tasks: those files are few.
    if bytes_ == 1:
        folders = land(tmp_path / "uno", {"UNO": ODD[17:19] + texts(3)[:1]})
        want = plain(feeds.read_envelopes(spark, folders, FEED))
    spark.conf.set(names[0], str(bytes_))
    spark.conf.set(names[1], "0")
    try:
        got = plain(envelopes.split_envelopes(spark, folders, FEED))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert got == want and len(want) > 3


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    document = json.dumps({"status": "OK", "results": [{"a": str(i), "b": [{"c": "x" * (i % 50)}]} for i in range(20_000)]})
    folders = land(tmp_path, {"UNO": [document]})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = envelopes.fragments(spark, folders)
        assert read.select("bloque").distinct().count() > 8
        got = envelopes.split_envelopes(spark, folders, FEED)
        some = got.select("posicion", "valor").filter("posicion % 1000 = 7").collect()
        assert sorted(map(tuple, some)) == [(i, str(i)) for i in range(7, 20_000, 1000)]
        assert got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_only_chunks_of_the_text_are_kept(spark, tmp_path, monkeypatch):
    """Steps kept a row for each brace of the files, most of them with its text."""
    document = json.dumps({"status": "OK", "results": [{"a": str(i), "b": [{"c": "x" * (i % 50)}]} for i in range(20_000)]})
    folders = land(tmp_path, {"UNO": [document]})
    kept, stored = {}, envelopes.stored

    def counted(df, name):
        out = stored(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(envelopes, "stored", counted)
    assert envelopes.split_envelopes(spark, folders, FEED).count() == 20_000
    assert 0 < sum(kept.values()) < 2_000


def test_documents_are_landed_at_once(spark, tmp_path):
    lines = spark.range(4000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("empresa"), F.format_string(',{"a":"%d"}', "id").alias("value"))
    folders = land_documents(lines, ["A", "B", "C"], '{"status":"OK","results":[null', "]}", str(tmp_path / "sobres"))
    assert [len(spark.read.text(f).inputFiles()) for f in folders.values()] == [1, 1, 1]
    for c, want in (("A", [i for i in range(4000) if i % 3 == 0]), ("B", [i for i in range(4000) if i % 3]), ("C", [])):
        (file,) = (tmp_path / "sobres" / f"empresa={c}").glob("part*")
        assert sorted(int(r["a"]) for r in json.loads(file.read_text())["results"][1:]) == want


def test_no_files(spark, tmp_path):
    assert envelopes.split_envelopes(spark, {"NADA": str(tmp_path / "nada")}, FEED).count() == 0


def test_a_document_is_landed_without_sorting(spark, tmp_path):
    lines = spark.range(5000, numPartitions=7).select(F.format_string(',{"a":"%d"}', "id").alias("value"))
    for rows_, name in ((lines, "UNO"), (lines.limit(0), "DOS")):
        land_document(rows_, '{"status":"OK","results":[null', "]}", str(tmp_path / name))
    (file,), (empty,) = ([p for p in (tmp_path / n).iterdir() if p.name.startswith("part")] for n in ("UNO", "DOS"))
    text = file.read_text()
    assert json.loads(empty.read_text()) == {"status": "OK", "results": [None]} and text.startswith('{"status"')
    assert sorted(int(r["a"]) for r in json.loads(text)["results"][1:]) == list(range(5000))
