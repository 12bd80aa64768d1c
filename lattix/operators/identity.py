"""Cell identifiers: barcodes within them, matching of batches, metadata by shared barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .summary import kept


def barcode(id_cell: Column, least: int = 16) -> Column:
    """The leftmost run of `least` or more of ATGC, in any case; null if there is none."""
    return F.nullif(F.regexp_extract(id_cell, f"(?i)[ATGC]{{{least},}}", 0), F.lit(""))


def channel(id_cell: Column, least: int = 16, found: Column | None = None) -> Column:
    """What stands before and after the barcode (found, where it is known already), joined by |; null without a barcode."""
    cb = barcode(id_cell, least) if found is None else found
    at = F.position(cb, id_cell)  # a run of that length has no earlier equal
    return F.concat(F.substr(id_cell, F.lit(1), at - 1), F.lit("|"), F.substr(id_cell, at + F.length(cb)))


def parsed(cells: DataFrame, column: str = "id_cell") -> DataFrame:
    """cells with the barcode CB and id_sample; each pattern is sought once."""
    return cells.withColumn("CB", barcode(F.col(column))).withColumn("id_sample", channel(F.col(column), found=F.col("CB")))


def barcodes_by_sample(cells: DataFrame) -> DataFrame:
    """(id_sample, CB), each pair once; the sets that a dictionary would hold stay rows."""
    return parsed(cells).where("CB is not null").select("id_sample", "CB").distinct()


def matched_samples(cells_1: DataFrame, cells_2: DataFrame, by_second: bool = True) -> DataFrame:
    """(id_sample_1, id_sample_2, prop): samples of one list matched with those of the other by shared barcodes.

    prop is the share of the second's (or the first's) barcodes. The best first sample is kept for each second one, then
    the best second for each first; ties go to the smaller names. Of pairs without overlap only one can win: that of a
    second sample that overlaps nothing with the smallest first name.
    """
    return _matched(_sought(cells_1), _sought(cells_2), by_second)


def _sought(cells: DataFrame) -> DataFrame:
    """(id_cell, CB, id_sample) of the cells with a barcode, written once: what follows reads it several times, and seeking barcodes is what takes time."""
    return kept(parsed(cells.select("id_cell")).where("CB is not null"))


def _matched(cells_1: DataFrame, cells_2: DataFrame, by_second: bool = True) -> DataFrame:
    """matched_samples of cells whose barcodes are known."""
    a = kept(cells_1.select(F.col("id_sample").alias("id_sample_1"), "CB").distinct())
    b = kept(cells_2.select(F.col("id_sample").alias("id_sample_2"), "CB").distinct())
    common = a.join(b, "CB").groupBy("id_sample_1", "id_sample_2").agg(F.count("*").alias("common"))
    n1, n2 = a.groupBy("id_sample_1").agg(F.count("*").alias("n1")), b.groupBy("id_sample_2").agg(F.count("*").alias("n2"))
    smallest = n1.agg(F.min("id_sample_1").alias("id_sample_1")).where("id_sample_1 is not null")  # one row
    alone = n2.select("id_sample_2").join(common, "id_sample_2", "left_anti").join(F.broadcast(smallest)).select("id_sample_1", "id_sample_2", F.lit(0).cast("long").alias("common"))
    sizes, key = (n2, "id_sample_2") if by_second else (n1, "id_sample_1")
    x = common.unionByName(alone).join(sizes, key).withColumn("prop", F.col("common") / F.col("n2" if by_second else "n1").cast("double"))
    for key, other in (("id_sample_2", "id_sample_1"), ("id_sample_1", "id_sample_2")):
        w = Window.partitionBy(key).orderBy(F.desc("prop"), other)
        x = x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return x.select("id_sample_1", "id_sample_2", "prop")


def matched_cells(cells_1: DataFrame, cells_2: DataFrame) -> DataFrame:
    """(id_cell_1, id_cell_2): the cells of matched samples, id_cell_2 null where the barcode isn't in the other list."""
    cells_1, cells_2 = _sought(cells_1), _sought(cells_2)
    s = kept(_matched(cells_1, cells_2))  # a row a sample at most
    a = cells_1.select(F.col("id_cell").alias("id_cell_1"), "CB", F.col("id_sample").alias("id_sample_1")).join(s, "id_sample_1")
    b = cells_2.select(F.col("id_cell").alias("id_cell_2"), "CB", F.col("id_sample").alias("id_sample_2"))
    return a.join(b, ["CB", "id_sample_2"], "left").select("id_cell_1", "id_cell_2")


def with_metadata(cells: DataFrame, metadata: DataFrame, suffix: str = "_meta") -> DataFrame:
    """cells with the metadata of the matched cell; columns of one name get the suffix. Every cell stays."""
    pairs = matched_cells(cells, metadata).where("id_cell_2 is not null")
    taken = set(cells.columns)
    meta = metadata.select(F.col("id_cell").alias("id_cell_2"), *[F.col(c).alias(c + suffix if c in taken else c) for c in metadata.columns if c != "id_cell"])
    return cells.join(pairs.join(meta, "id_cell_2").drop("id_cell_2").withColumnRenamed("id_cell_1", "id_cell"), "id_cell", "left")
