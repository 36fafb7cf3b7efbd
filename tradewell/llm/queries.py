"""Each operator on its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.llm import (
    chat, decontaminate, embeddings, jaccard, mixing, pieces, prefix_trie, resampling, secrets, suffix_index, tokens,
    toxicity, urls,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: host, path, verdict; fixed values.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
THRESHOLD = 0.3


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: DuckDB has no crc32: a table for a byte at a time, made from the polynomial, and the sum of a text's bytes.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
    FROM range(256) t(i)))"""


def crc32_sql(text: str) -> str:
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, by start and then by kind in order of their list."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_decontaminate")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x,
    list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
    AND list_bool_or(list_transform(embedding, lambda e: e <> 0)) AS usable FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.b, root FROM reach JOIN links ON links.a = node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, root = vec_id AS kept
FROM v JOIN least ON node = vec_id LEFT JOIN many ON a = vec_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT links.b, root FROM reach JOIN links ON links.a = node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, root AS component_id FROM s JOIN least ON node = doc_id""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


@query("op5_secrets")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    kinds = [k for k, *_ in secrets.BASE] + [k for k, *_ in secrets.ENCODINGS]
    places = F.create_map(*[F.lit(x) for k, i in zip(kinds, range(len(kinds)), strict=True) for x in (k, i)])
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), places[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, ("assign", "access", "hex")),
        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(every).alias("spans"), "n_tested", "n_random")


@query("op6_chat", """
WITH numbered AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS n
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id AS of, role AS speaker FROM numbered WHERE role <> 'system'),
parts AS (
  SELECT conv_id, speaker, n, n // 64 AS chunk, role = speaker AS own, text || '<|end|>' AS body,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>'
      ELSE '<|user name=' || regexp_replace(role, '[<>|\\r\\n]', '_', 'g') || '|>' END || chr(10) AS head
  FROM numbered JOIN speakers ON conv_id IS NOT DISTINCT FROM of),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, speaker, chunk ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
    + length(head) AS body_at FROM parts)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN body_at || ':' || (body_at + length(body)) END, ',' ORDER BY n), '') AS mask
FROM placed GROUP BY conv_id, speaker, chunk""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return chat.perspectives(table(spark, folder, "conversations")).withColumn("mask", mask)


@query("op7_mix", r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS hash,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size::DOUBLE * 3 AS cap, row_number() OVER (ORDER BY source_size::DOUBLE * 3 / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight::DOUBLE) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, k) FROM levels WHERE cap >= level * weight)) AS target FROM levels),
keyed AS (
  SELECT *, length(bin(size)) * 4 + CASE rpad(substr(bin(size), 2, 2), 2, '0') WHEN '00' THEN 0 WHEN '01' THEN 1 WHEN '10' THEN 2 ELSE 3 END AS class,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || hash), 1, 8))::BIGINT AS key FROM sized),
placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY class, key, doc_id, size) AS n FROM keyed),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS share,
    ('0x' || substr(md5('mix|' || coalesce(source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS start FROM targets)
SELECT doc_id, size, source_size, target,
  size * least(floor(n * share + start) - floor((n - 1) * share + start), 3)::BIGINT AS taken
FROM placed p JOIN shares s ON p.source IS NOT DISTINCT FROM s.source""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.copies(table(spark, folder, "documents")).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


@query("op8_url_filter")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages"), URL_RULES).withColumn("mined", F.array_join("mined", " "))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, folder, "labels")))
    return toxicity.score(docs, model, threshold=THRESHOLD).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
        F.col("__predicted").alias("predicted"), F.size("__passages").cast("long").alias("n_passages"))


@query("op10_tokens")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(table(spark, folder, "documents"), vocabulary(), width=2), width=2)


@query("op11_pieces")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    decoded = pieces.decode_pieces(pieces.encode_pieces(table(spark, folder, "documents"), model), model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_FEATURES = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op12_resample", f"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS words FROM documents),
own AS (SELECT r, unnest(words) AS word FROM docs),
wanted AS (SELECT unnest({_FEATURES}) AS word FROM benchmark),
hashed AS (
  SELECT word, {crc32_sql("word")} % 10000 AS bucket
  FROM (SELECT word FROM own UNION SELECT word FROM wanted), crc_table),
held AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
    SELECT word, 1 AS s, 0 AS t FROM own UNION ALL SELECT word, 0, 1 FROM wanted) JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000))))::BIGINT AS gain FROM held),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))))::BIGINT AS score FROM docs LEFT JOIN weights USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END::BIGINT AS rank FROM ranked""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.importance_ranks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_prefix_trie", f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id AS conv, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (
  SELECT o.conv, {crc32_sql("o.conv::VARCHAR")} % 6 AS h, o.turns, b.turns AS base
  FROM own o CROSS JOIN crc_table LEFT JOIN own b ON b.conv = o.conv - o.conv % 100),
rebuilt AS (SELECT conv, list_concat(coalesce(base[1:h], []), turns[h + 1:]) AS seq FROM headed),
members AS (SELECT conv, seq, unnest(range(len(seq) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT seq[1:depth] AS path, depth, min(conv) AS conv, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN len(seq) = depth THEN conv::VARCHAR END, ',' ORDER BY conv), '') AS ends
  FROM members GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
whole AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS tokens FROM nodes LEFT JOIN kids USING (path, depth)),
above AS (SELECT path[1:up] AS path, up AS depth, n_children, tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM whole)),
totals AS (
  SELECT path, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(tokens) AS tokens FROM above GROUP BY 1, 2)
SELECT w.conv AS conv_id, w.depth, p.conv AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children,
  t.n_leaves, t.tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN totals t USING (path, depth) LEFT JOIN whole p ON p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
