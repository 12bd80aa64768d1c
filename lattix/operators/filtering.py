"""Filters of axes and records, thresholds, masks and selections."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .summary import barcode_totals, feature_totals


def surviving(records: DataFrame, min_counts=None, min_features=None, min_cells=None, features: DataFrame | None = None, barcodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bc_id), (ft_id) that pass; thresholds are inclusive and all taken before anything is removed. Entries without records never pass."""
    bc, ft = barcode_totals(records), feature_totals(records)
    for df_cond, value in ((F.col("total"), min_counts), (F.col("n_features"), min_features)):
        bc = bc.where(df_cond >= value) if value is not None else bc
    ft = ft.where(F.col("n_cells") >= min_cells) if min_cells is not None else ft
    bc = bc.join(barcodes.select("bc_id").distinct(), "bc_id", "left_semi") if barcodes is not None else bc
    ft = ft.join(features.select("ft_id").distinct(), "ft_id", "left_semi") if features is not None else ft
    return bc.select("bc_id"), ft.select("ft_id")


def renumbered(ids: DataFrame, key: str, new: str = "new_id", order: list[Column] | None = None) -> DataFrame:
    """(key, new) with dense 0-based ids in ascending order of the old, or in another order, without a single-task window: ids are ranged, counted per range, and numbered within."""
    by = order or [F.col(key)]
    ranged = ids.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    within = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*by))).select(key, "_part", "_nth")
    sizes = within.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return within.join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_nth") - 1).alias(new))


def filtered(records: DataFrame, renumber: bool = False, **thresholds) -> DataFrame:
    """Records whose barcode and feature both survive, with dense new ids if asked for."""
    bc, ft = surviving(records, **thresholds)
    if not renumber:
        return records.join(bc, "bc_id", "left_semi").join(ft, "ft_id", "left_semi").select("ft_id", "bc_id", "value")
    out = records.join(renumbered(bc, "bc_id", "new_bc"), "bc_id").join(renumbered(ft, "ft_id", "new_ft"), "ft_id")
    return out.select(F.col("new_ft").alias("ft_id"), F.col("new_bc").alias("bc_id"), "value")


def raised_threshold(totals: DataFrame, start: int = 1, most: int = 20_000, top: int = 100_000, stop: int = 2000) -> DataFrame:
    """One row (min_counts): start, doubled while more than `most` of the largest `top` totals lie strictly above it and it is under `stop`. All doublings are counted in one pass."""
    steps, x = [], start
    while x < stop:
        steps.append(x)
        x *= 2
    largest = totals.orderBy(F.desc("total")).limit(top)
    counts = largest.agg(*[F.count_if(F.col("total") > s).alias(f"n{i}") for i, s in enumerate(steps)])
    pick = F.lit(x)
    for i, s in reversed(list(enumerate(steps))):
        pick = F.when(F.col(f"n{i}") <= most, F.lit(s)).otherwise(pick)
    return counts.select(pick.alias("min_counts"))


def selected(df: DataFrame, deselect: bool = False, **choices) -> DataFrame:
    """Rows whose columns equal, or are among, what is asked; negated one by one by deselect. Unknown columns are skipped."""
    for name, want in choices.items():
        if name in df.columns:
            cond = F.col(name).isin(list(want)) if isinstance(want, Iterable) and not isinstance(want, str) else F.col(name) == want
            df = df.where(~cond if deselect else cond)
    return df


def thresholds(every: bool = True, **limits) -> Column:
    """`<column>a=x`: above x; `<column>b=x`: below x; strict, and joined by AND, or OR unless every."""
    conds = [F.col(k[:-1]) > v if k[-1] == "a" else F.col(k[:-1]) < v for k, v in limits.items()]
    return reduce(and_ if every else or_, conds, F.lit(True) if every else F.lit(False)) if conds else F.lit(True)


def matches(text: Column, *queries: str, ignore_case: bool = True) -> Column:
    """Whether every query is in the text; a leading - asks that it isn't."""
    low = F.lower(text) if ignore_case else text
    conds = []
    for q in queries:
        negated, q = q.startswith("-"), q.removeprefix("-")
        c = low.contains(q.lower() if ignore_case else q)
        conds.append(~c if negated else c)
    return reduce(and_, conds, F.lit(True))


def sliced(ids: Column, start: int | None, stop: int | None, step: int = 1, length: int | None = None) -> Column:
    """Membership of a 0-based id in a slice; negative bounds need the length."""
    if step < 1:
        raise ValueError("a positive step is needed")
    start, stop = (x + length if x is not None and x < 0 else x for x in (start, stop))
    cond = ids >= (start or 0)
    cond = cond & (ids < stop) if stop is not None else cond
    return cond & ((ids - F.lit(start or 0)) % step == 0)


def mask_of(axis: DataFrame, ids: DataFrame, key: str, name: str = "mask") -> DataFrame:
    """The axis with a boolean column: whether the id is among ids."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return axis.join(hit, key, "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def positions(axis: DataFrame, key: str, name: str = "mask", value: bool = True) -> DataFrame:
    return axis.where(F.col(name) == F.lit(value)).select(key)


def segments(axis: DataFrame, key: str, name: str = "mask", by: list[str] | None = None) -> DataFrame:
    """(start, stop) of every run of set entries, stop exclusive. Runs within a group `by` are windows of their own; without one, ids are dealt in blocks and runs that meet at a block's edge are joined."""
    bits = axis.where(F.col(name)).select(*(by or []), key)
    if by:
        run = F.col(key) - F.row_number().over(Window.partitionBy(*by).orderBy(key))
        return bits.withColumn("_run", run).groupBy(*by, "_run").agg(F.min(key).alias("start"), (F.max(key) + 1).alias("stop")).drop("_run")
    # An entry begins a run if its neighbour is not set, and ends one likewise: neighbours meet by an equi-join.
    prev, nxt = bits.select((F.col(key) + 1).alias(key)), bits.select((F.col(key) - 1).alias(key))
    starts, stops = bits.join(prev, key, "left_anti"), bits.join(nxt, key, "left_anti")
    block = F.floor(F.col(key) / 1_000_000)
    s = starts.select(F.col(key).alias("start"), block.alias("b")).withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy("start")))
    e = stops.select((F.col(key) + 1).alias("stop"), block.alias("b")).withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy("stop")))
    # The i-th start of all has the i-th end of all; blocks' counts move the numbers.
    shift = lambda x: x.groupBy("b").agg(F.count("*").alias("n")).select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    s = s.join(F.broadcast(shift(s)), "b").select("start", (F.col("before") + F.col("nth")).alias("i"))
    e = e.join(F.broadcast(shift(e)), "b").select("stop", (F.col("before") + F.col("nth")).alias("i"))
    return s.join(e, "i").select("start", "stop")


def orthogonal(records: DataFrame, barcodes: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Records in the product of two sets of ids."""
    out = records.join(barcodes.select("bc_id").distinct(), "bc_id", "left_semi") if barcodes is not None else records
    out = out.join(features.select("ft_id").distinct(), "ft_id", "left_semi") if features is not None else out
    return out.select("ft_id", "bc_id", "value")


def at_points(records: DataFrame, points: DataFrame, fill=0) -> DataFrame:
    """The value at each point (ft_id, bc_id), fill where there is no record."""
    return points.join(records, ["ft_id", "bc_id"], "left").select("ft_id", "bc_id", F.coalesce("value", F.lit(fill)).alias("value"))


def overlaid(base: DataFrame, over: DataFrame, keys: list[str] = ["ft_id", "bc_id"]) -> DataFrame:  # noqa: B006
    """base with the rows of over in place of those with the same keys: a local layer over a read-only one."""
    return over.unionByName(base.join(over.select(*keys).distinct(), keys, "left_anti"))


def masked_write(records: DataFrame, cond: Column, value) -> DataFrame:
    return records.withColumn("value", F.when(cond, F.lit(value)).otherwise(F.col("value")))


def resized(records: DataFrame, n_features: int, n_barcodes: int) -> DataFrame:
    """Records within a matrix of the new size; growing adds nothing, as absent records are 0."""
    return records.where((F.col("ft_id") < n_features) & (F.col("bc_id") < n_barcodes))
