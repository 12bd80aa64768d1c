"""A count matrix: two annotated axes and layers of records over them, as DataFrames; nothing runs before it is asked for."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filtering, summary
from .operators.layout import sorted_copy


def _by_entry(records: DataFrame, key: str, func: Callable, schema: str, many: bool) -> DataFrame:
    """func(entry, other ids, values) of each entry of an axis, which gives a dict of a row's values, or with many a dict of arrays of rows; entries are sorted together and cut from Arrow batches as slices, so one costs no frame of its own."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    other = "ft_id" if key == "bc_id" else "bc_id"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import numpy as np

        held: list[tuple] = []  # the last entry's slices: it may go on in the next batch
        rows: list[dict] = []
        size = 0

        def done():
            nonlocal held, size
            e, others, values = held[0][0], *(x[0] if len(x) == 1 else np.concatenate(x) for x in ([h[1] for h in held], [h[2] for h in held]))
            held = []
            got = func(int(e), others, values)
            rows.append(got)
            size += max(1, *map(len, got.values())) if many else 1

        def packed():
            nonlocal rows, size
            cols = []
            for f in out:
                parts = [r.get(f.name) for r in rows]
                if many:
                    parts = np.concatenate([x for x in parts if len(x)] or parts)
                cols.append(pa.array(parts, f.type, from_pandas=True))
            rows, size = [], 0
            return pa.RecordBatch.from_arrays(cols, schema=out)

        for batch in batches:
            keys, others, values = (np.array(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0][0] != keys[a]:
                    done()
                    if size >= 10_000:
                        yield packed()
                held.append((keys[a], others[a:b], values[a:b]))
        if held:
            done()
        if rows:
            yield packed()

    return records.select(key, other, "value").repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


@dataclass
class Axis:
    """The table of an axis, with its id, the column of its names and the active filter; None is all entries."""

    table: DataFrame
    key: str
    name: str
    filter: Column | None = None

    @property
    def active(self) -> DataFrame:
        return self.table if self.filter is None else self.table.where(self.filter)

    def all(self) -> Axis:
        return replace(self, filter=None)

    def filtered(self, cond: Column) -> Axis:
        return replace(self, filter=cond if self.filter is None else self.filter & cond)

    def save_filter(self, column: str, description: dict | None = None) -> Axis:
        """The active filter as a boolean column, described in its metadata."""
        mask = F.coalesce(self.filter, F.lit(False)) if self.filter is not None else F.lit(True)
        return replace(self, table=self.table.withColumn(column, mask).withMetadata(column, {"description": json.dumps(description or {})}))

    def change_filter(self, column: str) -> Axis:
        return replace(self, filter=F.col(column))

    def count(self) -> int:
        return self.active.count()

    @property
    def n_rows(self) -> int:
        """All entries, whatever the filter."""
        return self.table.count()

    def as_dict(self, column: str, most: int = 10_000_000) -> dict:
        """A column of the active entries by id, in memory; an error above `most` entries."""
        rows = self.active.select(self.key, column).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} entries")
        return {r[0]: r[1] for r in rows}

    def names(self) -> DataFrame:
        return self.active.select(self.name)

    def named(self, names: list[str]) -> Axis:
        return self.filtered(F.col(self.name).isin(names))

    def meta(self, *columns: str) -> DataFrame:
        return self.active.select(self.key, *columns)

    def column(self, column: str, index: int = -1) -> DataFrame:
        """A column, or with an index one column of a two-dimensional one."""
        x = F.col(column) if index < 0 else F.get(F.col(column), F.lit(index))
        return self.active.select(self.key, x.alias(column))

    def with_meta(self, values: DataFrame, on: str | None = None) -> Axis:
        """Columns joined by the id; entries without a row have null, and columns of the same name are replaced."""
        on = on or self.key
        old = [c for c in values.columns if c != on and c in self.table.columns]
        return replace(self, table=self.table.drop(*old).join(values, on, "left"))

    def set_categories(self, column: str, names: dict[str, str]) -> Axis:
        """Category names changed; several may become one, and others stay."""
        from .functions.strings import mapped

        return replace(self, table=self.table.withColumn(column, mapped(F.col(column), names, keep=True)))

    def sample(self, fraction: float, seed: int = 0) -> Axis:
        from .operators.clusters import drawn

        return self.filtered(drawn(seed, self.key) < F.lit(f"{min((1 << 32) - 1, int(fraction * (1 << 32))):08x}")) if fraction < 1 else self


@dataclass
class CountMatrix:
    barcodes: DataFrame
    features: DataFrame
    layers: dict[str, DataFrame]
    bc: Axis = field(init=False)
    ft: Axis = field(init=False)

    def __post_init__(self):
        self.bc = Axis(self.barcodes, "bc_id", "barcode")
        self.ft = Axis(self.features, "ft_id", "id_feature")

    def __getitem__(self, at) -> tuple[DataFrame, DataFrame, DataFrame]:
        """matrix[layer, barcodes, barcode columns, features, feature columns]: records, barcode table, feature table.

        A slice (:) is the active filter, a list names entries, a Column is a condition; columns are a list, or : for all.
        """
        layer, bcs, bc_cols, fts, ft_cols = (list(at) + [slice(None)] * 5)[:5] if isinstance(at, tuple) else (at, *[slice(None)] * 4)
        pick = lambda axis, x: axis if isinstance(x, slice) else axis.filtered(x) if isinstance(x, Column) else axis.named([x] if isinstance(x, str) else list(x))
        bc, ft = pick(self.bc, bcs), pick(self.ft, fts)
        cols = lambda axis, x: axis.active if isinstance(x, slice) else axis.active.select(axis.key, axis.name, *[c for c in ([x] if isinstance(x, str) else x) if c not in (axis.key, axis.name)])
        records = self.layers[layer]
        whole = lambda axis, x: axis.filter is None and isinstance(x, slice)
        records = filtering.orthogonal(records, None if whole(self.bc, bcs) else bc.active, None if whole(self.ft, fts) else ft.active)
        return records, cols(bc, bc_cols), cols(ft, ft_cols)

    def expression(self, names: list[str], layer: str = "raw") -> DataFrame:
        """(bc_id, expression): the sum over the named features for every active barcode, 0 where there is none."""
        fts = self.ft.all().named(names).active
        sums = self.layers[layer].join(F.broadcast(fts.select("ft_id")), "ft_id", "left_semi").groupBy("bc_id").agg(F.sum("value").alias("e"))
        return self.bc.active.select("bc_id").join(sums, "bc_id", "left").select("bc_id", F.coalesce("e", F.lit(0)).alias("expression"))

    def summarized(self, layer: str, axis: str = "barcode") -> CountMatrix:
        """Adds <layer>_sum and <layer>_num_nonzero_values to an axis."""
        a = self.bc if axis == "barcode" else self.ft
        sums = self.layers[layer].groupBy(a.key).agg(F.sum("value").alias(f"{layer}_sum"), F.count_if(F.col("value") != 0).alias(f"{layer}_num_nonzero_values"))
        table = a.with_meta(sums).table.fillna(0, [f"{layer}_sum", f"{layer}_num_nonzero_values"])
        return self.with_axis(axis, table)

    def summarized_by(self, layer: str, axis: str, func: Callable, schema: str) -> CountMatrix:
        """A function of (entry, other ids, values) to a dict for each entry of an axis; its results become columns <layer>_<name>."""
        a = self.bc if axis == "barcode" else self.ft
        key = a.key
        got = _by_entry(self.layers[layer], key, lambda entry, others, values: {key: entry, **func(entry, others, values)}, f"{key} long, {schema}", False)
        return self.with_axis(axis, a.with_meta(got.select(key, *[F.col(c).alias(f"{layer}_{c}") for c in got.columns if c != key])).table)

    def applied(self, layer: str, out: str, func: Callable[[Column], Column] | None = None, by: str | None = None, entry: Callable | None = None) -> CountMatrix:
        """A new layer: a Column function of the value, or a function of (entry, others, values) to (others, values) for each entry of an axis."""
        records = self.layers[layer]
        if func is not None:
            new = records.withColumn("value", func(F.col("value")))
        else:
            key, other = ("bc_id", "ft_id") if by == "barcode" else ("ft_id", "bc_id")

            def run(e, others, values):
                import numpy as np

                others, values = (np.asarray(x) for x in entry(e, others, values))
                return {key: np.full(len(others), e), other: others, "value": values}

            new = _by_entry(records, key, run, "ft_id long, bc_id long, value double", True)
        return replace_layers(self, {**self.layers, out: new})

    def _repr_html_(self) -> str:
        """What a notebook shows: axes with their columns and filters, and layers."""
        from html import escape

        line = lambda a, kind: f"<tr><td>{kind}</td><td>{escape(a.name)}</td><td>{escape(', '.join(c for c in a.table.columns if c != a.key))}</td><td>{escape(str(a.filter)) if a.filter is not None else 'all'}</td></tr>"
        return f"<table><tr><th>axis</th><th>names</th><th>metadata</th><th>filter</th></tr>{line(self.bc, 'barcodes')}{line(self.ft, 'features')}</table><p>layers: {escape(', '.join(self.layers))}</p>"

    def with_axis(self, axis: str, table: DataFrame) -> CountMatrix:
        out = CountMatrix(table if axis == "barcode" else self.barcodes, table if axis == "feature" else self.features, self.layers)
        out.bc.filter, out.ft.filter = self.bc.filter, self.ft.filter
        return out

    def prepared(self, min_counts=None, min_features=None, max_counts=None, max_features=None, target: float = summary.TARGET, n_variable: int = 2000, most: float = 10.0, raw: str = "raw", capped: str = "normalized_log1p_capped", filter_name: str = "filtered_barcodes", variable_name: str = "filter_normalized_log1p_highly_variable") -> CountMatrix:
        """Quality filter, normal values, log10(x + 1), the most variable features and a capped layer; bounds are strict."""
        limits = {"totala": min_counts, "totalb": max_counts, "n_featuresa": min_features, "n_featuresb": max_features}
        good = summary.barcode_totals(self.layers[raw]).where(filtering.thresholds(**{k: v for k, v in limits.items() if v is not None})).select("bc_id")
        records = self.layers[raw].join(good, "bc_id", "left_semi")
        var = summary.most_variable(summary.moments(records, max(1, good.count()), target), n_variable).select("ft_id")
        log = summary.logged(summary.normalized(records, target))
        bc = filtering.mask_of(self.barcodes, good, "bc_id", filter_name)
        ft = filtering.mask_of(self.features, var, "ft_id", variable_name)
        return CountMatrix(bc, ft, {**self.layers, capped: summary.capped(log.join(F.broadcast(var), "ft_id", "left_semi"), most)})

    def write(self, path: str, modes: tuple[str, ...] = ("bc_id",)) -> None:
        """Axes and layers as Parquet: one copy of a layer for each axis it is queried by."""
        self.barcodes.write.mode("overwrite").parquet(f"{path}/barcodes")
        self.features.write.mode("overwrite").parquet(f"{path}/features")
        for name, records in self.layers.items():
            for by in modes:
                sorted_copy(records, f"{path}/layers/{name}/{by}", by)


def replace_layers(m: CountMatrix, layers: dict[str, DataFrame]) -> CountMatrix:
    out = CountMatrix(m.barcodes, m.features, layers)
    out.bc.filter, out.ft.filter = m.bc.filter, m.ft.filter
    return out


def opened(spark: SparkSession, path: str, layers: list[str], by: str = "bc_id", over: str | None = None) -> CountMatrix:
    """A written matrix; with `over`, a writable folder whose layers' records stand in place of the read-only ones'."""
    from .sources.mex import exists

    got = {}
    for name in layers:
        base = spark.read.parquet(f"{path}/layers/{name}/{by}")
        mine = f"{over}/layers/{name}/{by}" if over else None
        got[name] = filtering.overlaid(base, spark.read.parquet(mine)) if mine and exists(spark, mine) else base
    axis = lambda name: spark.read.parquet(f"{over}/{name}" if over and exists(spark, f"{over}/{name}") else f"{path}/{name}")
    return CountMatrix(axis("barcodes"), axis("features"), got)


class Catalog:
    """Named written matrices that share a list of cells; opened when asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._open = spark, root.rstrip("/"), {}

    def update(self, name: str, matrix: CountMatrix) -> None:
        if not name.replace("_", "").isalnum():
            raise ValueError("names are of letters, digits and underscores")
        matrix.write(f"{self.root}/{name}")
        self._open.pop(name, None)

    def load(self, name: str, layers: list[str]) -> CountMatrix:
        if name not in self._open:
            self._open[name] = opened(self.spark, f"{self.root}/{name}", layers)
        return self._open[name]

    def unload(self, name: str) -> None:
        self._open.pop(name, None)

    def delete(self, name: str) -> None:
        from .sources.mex import remove

        self.unload(name)
        remove(self.spark, f"{self.root}/{name}")

    def empty(self, matrix: CountMatrix) -> CountMatrix:
        return replace_layers(matrix, {k: v.limit(0) for k, v in matrix.layers.items()})

    def transferred(self, to: CountMatrix, source: CountMatrix, features: bool = False) -> CountMatrix:
        """Axis tables of another matrix on the layers of this one."""
        return CountMatrix(source.barcodes, source.features if features else to.features, to.layers)
