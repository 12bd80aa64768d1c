"""Blocks of records as bytes: one block for each entry of an axis, in one of five formats; and lines of text files parsed as they are read."""

from __future__ import annotations

import gzip
import io
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats of blocks.
FORMATS = ("mtx_gzipped", "pickle", "pickle_gzipped", "feather", "feather_lz4")


def table_bytes(table: pa.Table, compression: str | None = None) -> bytes:
    """An Arrow table as a Feather file."""
    from pyarrow import feather

    out = io.BytesIO()
    feather.write_feather(table, out, compression=compression or "uncompressed")
    return out.getvalue()


def bytes_table(data: bytes) -> pa.Table:
    from pyarrow import feather

    return feather.read_table(io.BytesIO(data))


def encoder(form: str, index: str = "int64", value: str = "float64") -> Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]:
    """A function of (ft_ids, bc_ids, values) to the block's bytes; ids from 0, in text from 1."""

    def text(ft, bc, v):
        whole = np.issubdtype(v.dtype, np.integer)
        lines = (f"{a + 1} {b + 1} {int(x) if whole else repr(float(x))}\n" for a, b, x in zip(ft.tolist(), bc.tolist(), v.tolist()))
        return gzip.compress("".join(lines).encode(), mtime=0)

    def arrow(compression):
        return lambda ft, bc, v: table_bytes(pa.table({"ft_id": ft, "bc_id": bc, "value": v}), compression)

    kinds = {"mtx_gzipped": text, "pickle": lambda *x: pickle.dumps(x), "pickle_gzipped": lambda *x: gzip.compress(pickle.dumps(x), mtime=0), "feather": arrow(None), "feather_lz4": arrow("lz4")}
    if form not in kinds:
        raise ValueError(f"{form} is none of {', '.join(FORMATS)}")
    return lambda ft, bc, v: kinds[form](np.asarray(ft).astype(index), np.asarray(bc).astype(index), np.asarray(v).astype(value))


def decoder(form: str, index: str = "int64", value: str = "float64") -> Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The way back: (ft_ids, bc_ids, values)."""

    def text(data):
        rows = [line.split() for line in gzip.decompress(data).decode().splitlines()]
        return [int(r[0]) - 1 for r in rows], [int(r[1]) - 1 for r in rows], [float(r[2]) for r in rows]

    arrow = lambda data: [c.to_numpy() for c in bytes_table(data).columns]
    kinds = {"mtx_gzipped": text, "pickle": pickle.loads, "pickle_gzipped": lambda data: pickle.loads(gzip.decompress(data)), "feather": arrow, "feather_lz4": arrow}
    if form not in kinds:
        raise ValueError(f"{form} is none of {', '.join(FORMATS)}")
    return lambda data: tuple(np.asarray(x).astype(t) for x, t in zip(kinds[form](data), (index, index, value)))


def packed(records: DataFrame, form: str = "feather_lz4", by: str = "bc_id") -> DataFrame:
    """(id, n, data): the records of each entry of an axis as one block; a block holds as many as the entry has."""
    kind = "int64" if dict(records.dtypes)["value"] in ("int", "bigint", "smallint") else "float64"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["ft_id", "bc_id"])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(pdf)], "data": [encoder(form, value=kind)(pdf["ft_id"].to_numpy(), pdf["bc_id"].to_numpy(), pdf["value"].to_numpy())]})

    return records.select("ft_id", "bc_id", "value").groupBy(by).applyInPandas(run, f"{by} long, n long, data binary")


def unpacked(blocks: DataFrame, form: str = "feather_lz4", value: str = "double") -> DataFrame:
    """(ft_id, bc_id, value) of blocks, block by block."""
    kind = "int64" if value == "long" else "float64"

    def run(batches):
        read = decoder(form, value=kind)
        for batch in batches:
            for data in batch.column(0):
                ft, bc, v = read(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ft), pa.array(bc), pa.array(v)], ["ft_id", "bc_id", "value"])

    return blocks.where(F.col("data").isNotNull()).select("data").mapInArrow(run, f"ft_id long, bc_id long, value {value}")


def parsed_lines(spark: SparkSession, path: str, func: Callable[[str], tuple | None], schema: str) -> DataFrame:
    """A row for each line of a text file, gzipped or not, that the function makes a record of; lines that give None are left out."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([r for r in map(func, pdf["value"]) if r is not None], columns=names)

    return spark.read.text(path).mapInPandas(run, schema)
