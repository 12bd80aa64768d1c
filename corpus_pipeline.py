"""From raw documents to packed training bins, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; run() writes
each to Parquet in the shared folder and hands the next one what it reads there, so a lost executor costs a task. All but
the last stage return the columns of documents.

- toxicity: rows that the factorization machine, learnt from the labels, scores 0.5 or more go;
- near_duplicates: of each component of documents that are 80 % similar in five-word shingles the row with the smallest
  id stays (of rows with that id and equal texts one; rows with a null id or without words stay);
- decontamination: rows of which half of a benchmark item's template windows or more are found go;
- secrets: what the secret scan reports is replaced by its kind in brackets;
- packing: every row's pieces get bins.

SQL can express none of the learnt, hashed and searched steps, so ORACLE_SQL is None; tests compare with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm import bestfit_packing, decontaminate, ngram_join, secret_scan, toxicity
from lattix.llm.common import drop, scope, written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The labels speak of the documents as they came, so the machine learns from these rows.
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.similar(docs)
    gone = found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    # Rows that repeat an id are one document, of which the first stays. Only such ids, if any, are sorted.
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    again = written(again)
    alone = kept.join(again, "doc_id", "left_anti").select(docs.columns)
    # The first in the order of all columns; equal rows are one. Maximum and minimum combine before the shuffle.
    rows = kept.join(again, "doc_id", "left_semi").select("doc_id", F.struct(*[c for c in docs.columns if c != "doc_id"]).alias("row"))
    ones = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("doc_id", "row.*").select(docs.columns)
    return alone.union(ones)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        after: list[DataFrame] = []
        # What a stage wrote for itself goes when its result is written, and so does what it read.
        with scope(lambda: after[0] if after else None):
            after.append(written(stage(spark, docs, sf_dir)))
        drop(docs)
        docs = after[0]
    return docs
