"""A training corpus from raw documents: five stages, each an operator of ``tradewell.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever these are; only
names that begin with two underscores are reserved. Every row is judged by its own text, also where ids
are null or repeat; null texts count as empty, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.llm import decontaminate, jaccard, mixing, tokens, toxicity
from tradewell.llm.common import few, saved
from tradewell.llm.queries import THRESHOLD, table, vocabulary


#: Bytes for remembered words: the Python workers already hold what the earlier stages have left.
WORD_MEMORY = 48 << 20
#: Bytes of text per token file: a task sorts its file's rows in the JVM, beside what earlier stages have left there.
TOKEN_FILE_BYTES = 32 << 20


def without(docs: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """``docs`` but those whose ``row`` is among ``rows``; texts are not shuffled while rows are few."""
    rows = rows.select(F.col(row).alias("__gone")).distinct()
    return docs.join(few(rows), docs[row] == F.col("__gone"), "left_anti")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, the column that tells its rows apart): doc_id, or else a row number, saved with the rows."""
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return docs, "doc_id"
    return saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows"), "__row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the operator predicts to be toxic go; the model learns from the labelled rows among ``docs``.

    Rows without text have the lowest score and stay, and so does every row if no label is known. Rows of one id
    are scored each by its own text.
    """
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, threshold=THRESHOLD).filter("__predicted = 0").select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar rows the one of the smallest doc_id stays (null last, then by text and row)."""
    rows, row = numbered(docs)
    classes = saved(jaccard.similar_documents(rows, row), "classes")
    if row == "doc_id":
        return without(docs, classes.filter("doc_id != component_id"), row)
    order = rows.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row).alias("place"))
    # A row without shingles is a class of its own.
    first = classes.join(order, row).groupBy("component_id").agg(F.min("place")[row].alias("kept"))
    gone = classes.join(first, "component_id").filter(F.col(row) != F.col("kept"))
    return without(rows, gone, row).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item within its edits go, however long they are; rows without text stay."""
    rows, row = numbered(docs)
    leaks = saved(decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), row), "leaks")
    return without(rows, leaks, row).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, from never to three times; a null source is a source of its own.

    A source without words takes nothing. Repeated rows are sampled like any others.
    """
    return mixing.mixed(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row from the files written; rows without text have the end id only.

    Null ids come first, rows of one id one after another.
    """
    written = tokens.write_tokens(docs, vocabulary(), width=2, file_bytes=TOKEN_FILE_BYTES, memory=WORD_MEMORY)
    return tokens.read_tokens(written, width=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("similar documents", keep_one_of_similar),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token ids", write_ids),
]

#: No SQL says what the fitted model, the tokenizer and edit distances do; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
