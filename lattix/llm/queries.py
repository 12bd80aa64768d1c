"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit_packing, chat_format, decontaminate, html_extract, ngram_join, secret_scan, sharding, token_counts, topk_search, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's count before and after three edits at places that its id and length give: a word put in, a stretch taken out, one replaced."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), n + 1).cast("int").alias("at")
    edit = lambda i, removed, inserted: F.struct(at(i), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    return token_counts.counts(docs.withColumn("edits", F.array(edit(0, 0, " amended"), edit(1, 40, ""), edit(2, 12, "it's 2 words"))))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack(_table(spark, sf_dir, "documents"), capacity=2048)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], own.schema)
    return chat_format.read_back(chat_format.formatted(own.union(added)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=16)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def typed_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 on typed parts: every turn's text in two halves with an image between, then an audio part and a document."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    part = lambda kind, **known: F.struct(F.lit(kind).alias("kind"), *[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("text", "string"), ("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "long"), ("pages", "int"))])
    parts = [
        part("text", text=F.substr(text, F.lit(1), half)),
        part("image", ref=F.concat(F.lit("i"), F.col("conv_id").cast("string")), width=F.lit(600), height=F.lit(500)),
        part("text", text=F.substr(text, half + 1)),
        part("audio", ref=F.lit("a"), millis=1500 * (F.col("turn") + 1)),
        part("document", ref=F.lit("d"), pages=F.col("turn") % 3 + 1),
    ]
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array(*parts).alias("parts"))
    return chat_format.read_back(chat_format.formatted(own))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"typed_chat_parts": typed_chat_parts, "pipeline": pipeline}


ORACLE_SQL: dict[str, str] = {
    "op4_topk_search": """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_ngram_jaccard_join": """
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(other) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op7_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length('<|turn|><|says|><|end|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM f GROUP BY 1""",
    "typed_chat_parts": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
h AS (SELECT *, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM c),
f AS (SELECT *, length('<|turn|><|says|><|image:1|><|audio:3|><|document:4|><|end|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(a, '\', '\\'), '<|', '<\|')) + length(replace(replace(b, '\', '\\'), '<|', '<\|')) AS n,
  85 * 2 + 25 * ((1500 * (turn + 1) + 999) // 1000) + 600 * (turn % 3 + 1) AS more FROM h)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(sum(more) AS BIGINT) AS expanded_tokens
FROM f GROUP BY 1""",
}
