"""Count matrices from star-schema tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CountMatrix

#: Bytes of files whose rows one task sums.
PART = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _summed(items: DataFrame, barcode: str) -> DataFrame:
    """Quantities summed by part and barcode. Nearly every item is a group of its own, so rows are dealt before any are summed, into a part for each PART bytes of files: a task's groups then don't grow with the table. (Adaptive merging goes by compressed bytes, and ids take few.)"""
    size = int(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(items.sparkSession.sparkContext.defaultParallelism, size // PART)
    x = items.select(F.col("l_partkey").alias("ft_id"), F.col(barcode).alias("bc_id"), "l_quantity")
    return x.repartition(n, "ft_id", "bc_id").groupBy("ft_id", "bc_id").agg(F.sum("l_quantity").alias("value"))


def _features(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("ft_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id_feature"), F.col("p_brand").alias("feature"), F.col("p_type").alias("feature_type"))


def orders_by_parts(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """Barcodes are orders, some without any item; features are parts; values are quantities, summed where an order names a part twice."""
    records = _summed(table(spark, sf_dir, "lineitem"), "l_orderkey")
    bc = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bc_id"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("barcode"), "o_orderstatus", "o_orderpriority")
    return CountMatrix(bc, _features(table(spark, sf_dir, "part")), {"raw": records})


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of orders by parts with duplicate coordinates left in."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ft_id"), F.col("l_orderkey").alias("bc_id"), F.col("l_quantity").alias("value"), F.col("l_linenumber").cast("long").alias("line"))


def suppliers_by_parts(spark: SparkSession, sf_dir: str) -> CountMatrix:
    records = _summed(table(spark, sf_dir, "lineitem"), "l_suppkey")
    bc = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bc_id"), F.col("s_name").alias("barcode"), "s_nationkey")
    return CountMatrix(bc, _features(table(spark, sf_dir, "part")), {"raw": records})


def customers_by_brands(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """Barcodes are customers with a segment and a nation; features are the brands."""
    part = table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct().withColumn("ft_id", F.row_number().over(Window.orderBy("p_brand")).cast("long") - 1)  # some tens of rows
    items = table(spark, sf_dir, "lineitem").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    records = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    records = records.join(F.broadcast(brands), "p_brand").groupBy("ft_id", F.col("o_custkey").alias("bc_id")).agg(F.sum("l_quantity").alias("value"))
    bc = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bc_id"), F.col("c_name").alias("barcode"), "c_mktsegment", "c_nationkey")
    ft = brands.select("ft_id", F.col("p_brand").alias("id_feature"), F.col("p_brand").alias("feature"), F.lit("brand").alias("feature_type"))
    return CountMatrix(bc, ft, {"raw": records})


def synthetic_cells(spark: SparkSession, sf_dir: str, samples: int, keep: int = 1) -> DataFrame:
    """(id_cell): orders as cells, with a 16-letter barcode of the order's number in base four and a sample of its customer."""
    k = F.col("o_orderkey")
    letters = F.translate(F.lpad(F.conv(k.cast("string"), 10, 4), 16, "0"), "0123", "ACGT")
    x = table(spark, sf_dir, "orders").where(k % keep == 0)
    return x.select(F.concat(F.lit("s"), (F.col("o_custkey") % samples).cast("string"), F.lit("-"), letters, F.lit("-1")).alias("id_cell"))
