"""Smaller operators: dictionaries, one-hot labels, byte offsets, record splits, selector kinds, key-value tables, a standard recipe."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import embed, summary
from .filtering import renumbered


def dictionary(values: DataFrame, order: str, value: str, start: int = 0) -> DataFrame:
    """(value, position) by order; of equal values the last position stands."""
    x = renumbered(values, order, "_p").join(values, order)
    return x.groupBy(value).agg((F.max("_p") + start).alias("position"))


def one_hot(labels: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """A column for each value: the value where the row has it, else null."""
    return labels.select(key, *[F.when(F.col(column) == v, F.col(column)).alias(f"{column}_{v}") for v in values])


def byte_index(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, start, stop) in bytes of each entry's lines in a text file sorted by key, a line end included; entries are blocks of ids summed in two levels."""
    sizes = lines.groupBy(key).agg(F.sum(F.octet_length(line).cast("long") + 1).alias("n"))
    x = sizes.withColumn("_b", F.floor(F.col(key) / 100_000))
    blocks = x.groupBy("_b").agg(F.sum("n").alias("_n"))
    before = blocks.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_upto", upto).join(F.broadcast(before), "_b").select(key, (F.col("_before") + F.col("_upto") - F.col("n")).alias("start"), (F.col("_before") + F.col("_upto")).alias("stop"))


def split_records(records: DataFrame, path: str, most: int = 10_000_000, form: str = "parquet") -> None:
    """Files of at most so many records; the writer's success marker tells a finished split. Tasks move their own files into the folder: the driver, one file after another, would take most of the time of many."""
    records.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", most).format(form).save(path)


def is_mask(values: Iterable) -> bool:
    """Whether a selector looks like a mask: more than two values, the first ten of them 0, 1 or booleans."""
    seen = list(values)
    return len(seen) > 2 and all(isinstance(v, (bool, int)) and v in (0, 1) for v in seen[:10])


def as_mask(spark: SparkSession, values: Iterable, key: str = "bc_id") -> DataFrame:
    """(key, mask) from a list of bits."""
    return spark.createDataFrame([(i, bool(v)) for i, v in enumerate(values)], T.StructType([T.StructField(key, T.LongType()), T.StructField("mask", T.BooleanType())]))


def in_chunks(df: DataFrame, n: int, func: Callable, schema: str, key: str | None = None) -> DataFrame:
    """A function of a pandas frame run over n chunks, or over the rows of each key, in Spark's own workers."""
    if key:
        return df.groupBy(key).applyInPandas(func, schema)

    def run(batches):
        for pdf in batches:
            yield func(pdf)

    return df.repartition(n).mapInPandas(run, schema)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


class KeyValues:
    """A small persistent dictionary as JSON rows: a missing key is None, later writes win, a writable folder hides a read-only one."""

    def __init__(self, spark: SparkSession, path: str, over: str | None = None):
        self.spark, self.path, self.over = spark, path.rstrip("/"), over.rstrip("/") if over else None

    def _read(self, path: str | None, keys: list[str] | None) -> dict:
        from ..sources.files import exists

        if not path or not exists(self.spark, path):
            return {}
        rows = self.spark.read.parquet(path)
        rows = rows.where(F.col("key").isin(keys)) if keys is not None else rows
        return {r.key: json.loads(r.value) for r in rows.groupBy("key").agg(F.max_by("value", "written").alias("value")).collect() if r.value is not None}

    def all(self, keys: list[str] | None = None) -> dict:
        """What the keys asked for hold, or all keys; those without a value are left out."""
        got = self._read(self.path, keys) | self._read(self.over, keys)
        return {k: v for k, v in got.items() if v is not None}

    def keys(self) -> set[str]:
        return set(self.all())

    def __contains__(self, key: str) -> bool:
        return key in self.all([key])

    def __getitem__(self, key: str):
        return self.all([key]).get(key)

    def __setitem__(self, key: str, value) -> None:
        row = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(json.dumps(value)).alias("value"), F.unix_micros(F.current_timestamp()).alias("written"))
        row.write.mode("append").parquet(self.over or self.path)

    def __delitem__(self, key: str) -> None:
        self[key] = None


def recipe(matrix, min_genes: int = 200, min_cells: int = 3, prefix: str = "MT-", target: float = 10_000, n_variable: int = 2000, most: float = 10.0, components: int = 40) -> dict[str, DataFrame]:
    """The usual processing: cells and features that pass, shares of prefixed features, natural-log normal values, the most variable features scaled and capped, and their components (for embed.neighbours and embed.kmeans) of every cell that passes. The components are empty where no feature is variable enough or only one cell passes."""
    from pyspark.ml.functions import array_to_vector

    raw = matrix.layers["raw"]
    # Cells and their records are read again and again: both are written once.
    cells = summary.kept(raw.groupBy("bc_id").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total")).where(F.col("n_genes") >= min_genes))
    kept = raw.join(cells.select("bc_id"), "bc_id", "left_semi")
    genes = kept.groupBy("ft_id").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    kept = summary.kept(kept.join(genes.select("ft_id"), "ft_id", "left_semi"))
    marked = matrix.features.where(F.col("feature").startswith(prefix)).select("ft_id", F.lit(True).alias("marked"))
    quality = kept.join(marked, "ft_id", "left").groupBy("bc_id").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"), (F.coalesce(F.sum(F.when(F.col("marked"), F.col("value"))), F.lit(0)) / F.sum("value") * 100).alias("percent_marked"))
    n_cells = cells.count()
    n = max(2, n_cells)
    log = summary.normalized(kept, target).withColumn("value", F.log1p("value"))
    variable = summary.kept(summary.most_variable(summary.moments(kept, n, target), n_variable).select("ft_id"))
    ids = summary.kept(renumbered(variable, "ft_id", "nth"))
    scaled = summary.scaled(log.join(variable, "ft_id", "left_semi"), n, most)
    width = ids.count()
    vectors = embed.vectors(scaled.join(ids, "ft_id").select(F.col("nth").alias("ft_id"), "bc_id", "value"), width)
    # A cell without any variable feature is a row of zeros; fitting passes over the rows again and again.
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), width))
    rows = cells.select("bc_id").join(vectors, "bc_id", "left").select("bc_id", F.coalesce("features", zeros).alias("features")).persist()
    if width and n_cells > 1:
        pca = embed.apply_pca(embed.train_pca(rows, min(components, width)), rows)
    else:  # no feature is variable enough, or nothing varies: every cell has no component
        pca = rows.withColumn("X_pca", F.array().cast("array<double>"))
    return {"quality": quality, "layer": scaled, "pca": pca}
