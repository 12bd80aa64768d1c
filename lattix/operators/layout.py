"""Combining, ordering, indexing and reshaping matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filtering import renumbered


def combined(*matrices: DataFrame) -> DataFrame:
    """One long table (barcode, id_feature, value) from several: records at the same place are summed, so matrices that share no barcode, or no feature, are just put together."""
    names = ["barcode", "id_feature", "value"]
    return reduce(DataFrame.unionByName, [m.select(*names) for m in matrices]).groupBy("barcode", "id_feature").agg(F.sum("value").alias("value"))


def combined_features(*features: DataFrame) -> DataFrame:
    """A row for each feature id, with the smallest of its names and types."""
    return reduce(DataFrame.unionByName, features).groupBy("id_feature").agg(F.min("feature").alias("feature"), F.min("feature_type").alias("feature_type"))


def summed(records: DataFrame) -> DataFrame:
    """Duplicate coordinates become their sum."""
    return records.groupBy("ft_id", "bc_id").agg(F.sum("value").alias("value"))


def last_written(records: DataFrame, order: str) -> DataFrame:
    """Of duplicate coordinates the record that is last in order."""
    return records.groupBy("ft_id", "bc_id").agg(F.max_by("value", order).alias("value"))


def ordered(records: DataFrame, by_feature: bool = True) -> DataFrame:
    """A total order: by one axis, then the other. Spark's range sort spills by itself."""
    return records.orderBy(*(["ft_id", "bc_id"] if by_feature else ["bc_id", "ft_id"]))


def sorted_copy(records: DataFrame, path: str, by: str) -> None:
    """A physical copy for queries by one axis: ranged and sorted, so row groups have narrow bounds of that id."""
    records.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def _running(counts: DataFrame, key: str) -> DataFrame:
    """counts (key, n) with the sum of n before and after each key, in two levels: within blocks of ids and over blocks."""
    x = counts.withColumn("_b", F.floor(F.col(key) / 100_000))
    blocks = x.groupBy("_b").agg(F.sum("n").alias("_n"))
    before = blocks.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_upto", upto).join(F.broadcast(before), "_b").select(key, "n", (F.col("_before") + F.col("_upto")).alias("after"))


def sparse_index(records: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """(key, start, stop) of each entry's records in a copy sorted by key; (0, 0) where it has none."""
    counts = axis.select(key).join(records.groupBy(key).agg(F.count("*").alias("c")), key, "left").select(key, F.coalesce("c", F.lit(0)).alias("n"))
    r = _running(counts, key)
    some = F.col("n") > 0
    return r.select(key, F.when(some, F.col("after") - F.col("n")).otherwise(F.lit(0)).cast("long").alias("start"), F.when(some, F.col("after")).otherwise(F.lit(0)).cast("long").alias("stop"))


def indptr(records: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """(position, pointer) of compressed columns: 0, then the records up to each entry."""
    counts = axis.select(key).join(records.groupBy(key).agg(F.count("*").alias("c")), key, "left").select(key, F.coalesce("c", F.lit(0)).alias("n"))
    body = _running(counts, key).select((F.col(key) + 1).alias("position"), F.col("after").cast("long").alias("pointer"))
    return body.unionByName(records.sparkSession.range(1).select(F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("pointer")))


def expanded(pointers: DataFrame) -> DataFrame:
    """(position, entry) of every record from compressed columns; the entry of each record's place."""
    b = pointers.select(F.col("position").alias("p1"), F.col("pointer").alias("stop"))
    a = pointers.select((F.col("position") + 1).alias("p1"), F.col("pointer").alias("start"))
    return a.join(b, "p1").where("stop > start").select((F.col("p1") - 1).alias("entry"), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("position"))


def whole_counts(records: DataFrame) -> DataFrame:
    """Real values as counts: rounded half to even, and never to 0."""
    r = F.rint("value")
    return records.withColumn("value", F.when(r == 0, F.lit(1)).otherwise(r).cast("long"))


def dense(records: DataFrame, n_features: int, key: str = "bc_id", other: str = "ft_id") -> DataFrame:
    """(key, values) with a dense array a row, duplicates summed, absent records 0. An array has n_features entries, set in time linear in them; for rows much wider than their records see dense_blocks."""
    import pyarrow as pa

    entry = F.struct(F.col(other).cast("long").alias("i"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"))
    m = summed(records).groupBy(key).agg(F.collect_list(F.when(F.col(other).between(0, n_features - 1), entry)).alias("r"))
    rows = m.select(key, F.transform("r", lambda x: x["i"]).alias("i"), F.transform("r", lambda x: x["v"]).alias("v"))
    most = max(1, (1 << 20) // max(1, n_features))  # rows of a batch that is returned: 8 MB, or one row

    def run(batches):
        import numpy as np

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                at, values = part.column(1), part.column(2)
                ends = at.offsets.to_numpy()
                flat = np.zeros(part.num_rows * n_features)
                flat[np.repeat(np.arange(part.num_rows), np.diff(ends)) * n_features + at.flatten().to_numpy()] = values.flatten().to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * n_features, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "values"])

    return rows.mapInArrow(run, f"{key} {dict(records.dtypes)[key]}, values array<double>")


def dense_blocks(records: DataFrame, n_features: int, key: str = "bc_id", other: str = "ft_id", wide: int = 16) -> DataFrame:
    """(key, n_values, blocks): the dense rows of n_values entries, in blocks (start, values) of so many neighbours by start, duplicates summed, absent records 0.

    A block without any record isn't stored: all of its entries are 0. So what is held grows with the records, not with
    rows times features.
    """
    x = summed(records).withColumn("_b", F.when(F.col(other).between(0, n_features - 1), F.floor(F.col(other) / wide))).repartition(key)
    filled = x.groupBy(key, "_b").agg(F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct((F.col(other) - F.col("_b") * wide).cast("int"), F.col("value").cast("double"))))).alias("m"))
    start, zero = F.col("_b") * wide, F.lit(0.0)
    entries = F.sequence(F.lit(0), F.least(F.lit(wide), F.lit(n_features) - start).cast("int") - 1)
    block = F.struct(start.cast("long").alias("start"), F.transform(entries, lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("values"))
    return filled.groupBy(key).agg(F.lit(n_features).alias("n_values"), F.sort_array(F.collect_list(F.when(F.col("_b").isNotNull(), block))).alias("blocks"))


def pivoted(records: DataFrame, features: list[int], prefix: str = "ft_") -> DataFrame:
    """(bc_id, one column a feature) for a narrow choice of features."""
    return records.groupBy("bc_id").agg(*[F.coalesce(F.sum(F.when(F.col("ft_id") == f, F.col("value"))), F.lit(0)).alias(f"{prefix}{f}") for f in features])


def as_text(records: DataFrame) -> DataFrame:
    """Coordinate lines, 1-based, of 0-based records."""
    return records.select(F.concat_ws(" ", (F.col("ft_id") + 1).cast("string"), (F.col("bc_id") + 1).cast("string"), F.col("value").cast("string")).alias("line"))


def from_text(lines: DataFrame, kind: str = "double", transpose: bool = False) -> DataFrame:
    """0-based records of coordinate lines; whole numbers written as reals are cut towards zero for integer kinds."""
    parts = F.split(F.trim("line"), r"\s+")
    value = parts[2].cast("double")
    row, col = ("bc_id", "ft_id") if transpose else ("ft_id", "bc_id")
    out = lines.select((parts[0].cast("long") - 1).alias(row), (parts[1].cast("long") - 1).alias(col), value.cast(kind).alias("value"))
    return out.select("ft_id", "bc_id", "value")


def strided(rows: DataFrame, n: int, order: str) -> DataFrame:
    """chunk = position mod n, positions in order."""
    return renumbered(rows, order, "position").withColumn("chunk", F.pmod("position", F.lit(n)).cast("int"))


def even_chunks(rows: DataFrame, n: int, order: str, length: int) -> DataFrame:
    """chunk of ceil(length / n) neighbours."""
    wide = max(1, -(-length // n))
    return renumbered(rows, order, "position").withColumn("chunk", F.floor(F.col("position") / wide).cast("int"))


def weighted_chunks(rows: DataFrame, n: int, order: str, weight: str) -> DataFrame:
    """Contiguous chunks of about equal weight: with W the ceiling of total / n, an element opens the next chunk when the running sum passes W times the chunks so far; one boundary an element at most.

    With t(i) the chunk that the running sum alone would give the i-th element, its chunk is the least of i + 1 and of
    t(j) + i - j over all j up to i, so a running minimum does, in two levels: within blocks of ids and over blocks.
    """
    total, heaviest = rows.agg(F.sum(weight), F.max(weight)).first()
    if not total:
        return rows.select(order, weight).withColumn("chunk", F.lit(0))
    w = -(-int(total) // n) if float(total).is_integer() else total / n
    block = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda c, f: F.coalesce(f(c).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # noqa: E731  a row a block
    x = rows.select(F.col(order), F.col(weight), F.floor(F.col(order) / 100_000).alias("_b"))
    sums = x.groupBy("_b").agg(F.sum(weight).alias("_s"), F.count("*").alias("_k"))
    before = sums.select("_b", earlier("_s", F.sum).alias("_s"), earlier("_k", F.sum).alias("_k"))
    x = x.withColumns({"_u": F.sum(weight).over(block), "_i": F.row_number().over(block)}).join(F.broadcast(before), "_b")
    free = F.greatest(F.ceil((F.col("_s") + F.col("_u")) / F.lit(w)) - 1, F.lit(0))
    x = x.select(order, weight, "_b", (F.col("_k") + F.col("_i")).alias("_i"), (free - F.col("_k") - F.col("_i")).alias("_d"))
    if heaviest <= w:  # the running sum alone
        return x.select(order, weight, (F.col("_i") + F.col("_d")).cast("int").alias("chunk"))
    least = x.groupBy("_b").agg(F.min("_d").alias("_m"))
    held = least.select("_b", earlier("_m", F.min).alias("_m"))  # 0: the i-th, from 1, is in chunk i at most
    x = x.withColumn("_w", F.min("_d").over(block)).join(F.broadcast(held), "_b")
    return x.select(order, weight, (F.col("_i") + F.least("_w", "_m", F.lit(0))).cast("int").alias("chunk"))
