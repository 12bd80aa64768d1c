"""What the training-data operators share: the shared folder, written tables, Arrow maps and fixed-size sketches."""

from __future__ import annotations

import functools
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows turned into Python objects at a time, so that a worker never holds a whole batch of texts twice.
SLICE_ROWS = 256
#: Sketches travel in so many pieces, so that no task gathers all of them.
PIECES = 16


class _Scopes(threading.local):
    """A thread's open scopes of written tables, the innermost last."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, and survives the loss of executors.

    The table goes with its scope, at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattix-{uuid.uuid4().hex}"
    where, files = _place(spark, path)
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    except BaseException:
        files.delete(where, True)
        raise
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattix_path = path
    if _scopes.open:
        _scopes.open[-1].append(out)
    return out


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete a table made by written() that nothing needs any more."""
    if path := getattr(df, "_lattix_path", None):
        where, files = _place(df.sparkSession, path)
        files.delete(where, True)
        df._lattix_path = None


def _read_by(df: DataFrame) -> str:
    """The folders that a frame's plan reads, as text."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaf.relation().location().rootPaths().mkString(" "))
    return " ".join(found)


@contextmanager
def scope(kept: Callable[[], DataFrame | None] = lambda: None):
    """Tables written within are deleted at its end, also when it fails, but those that the kept frame reads: these pass to the scope around it."""
    own: list[DataFrame] = []
    _scopes.open.append(own)
    reads = ""
    try:
        yield
        reads = _read_by(kept()) if kept() is not None else ""
    finally:
        _scopes.open = [s for s in _scopes.open if s is not own]
        for table in own:
            path = getattr(table, "_lattix_path", None)
            if path and path.rpartition("/")[2] in reads:
                if _scopes.open:
                    _scopes.open[-1].append(table)
            else:
                drop(table)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator in a scope of its own: what its result doesn't read is gone when it returns."""

    @functools.wraps(operator)
    def run(*args, **kwargs):
        out: list[DataFrame] = []
        with scope(lambda: out[0] if out else None):
            out.append(operator(*args, **kwargs))
        return out[0]

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table as PIECES compressed rows (piece, data)."""
    pieces = np.array_split(table, PIECES)
    yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in pieces], pa.binary())], ["piece", "data"])


def merged_sketch(rows: DataFrame, dtype: type, add: Callable) -> np.ndarray:
    """The tables of all tasks added up piece by piece on the executors; only one table of fixed size reaches the driver."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(data.as_py()), dtype)
                if piece in sums:
                    add(sums[piece], x, out=sums[piece])
                else:
                    sums[piece] = x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["piece", "data"])

    got = rows.repartition(PIECES, "piece").mapInArrow(total, "piece int, data binary").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(bytes(r.data)), dtype) for r in sorted(got, key=lambda r: r.piece)]) if got else np.zeros(0, dtype)


def bloom_slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    h = mix(hashes.astype(np.uint64, copy=False))
    mask = np.uint64((1 << bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


class Bloom:
    """A set of 64-bit hashes in 2**bits bits; may say yes wrongly, never no."""

    def __init__(self, packed: bytes, bits: int):
        self.packed, self.bits, self._table = packed, bits, None

    def __getstate__(self):
        return self.packed, self.bits

    def __setstate__(self, state):
        self.packed, self.bits = state
        self._table = None

    def __contains__(self, x: int) -> bool:
        return bool(self.test(np.array([x], np.uint64))[0])

    def test(self, hashes: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.frombuffer(self.packed, np.uint8)
        a, b = bloom_slots(hashes, self.bits)
        hit = lambda s: (self._table[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1
        return (hit(a) & hit(b)).astype(bool)


def bloom_of(hashes: DataFrame, bits: int) -> Bloom:
    """A filter over the one long column of hashes, built on the executors; 2**bits bits, whatever the input."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.bool_)
        some = False
        for batch in batches:
            for s in bloom_slots(batch.column(0).to_numpy().view(np.uint64), bits):
                table[s.astype(np.int64)] = True
            some = some or batch.num_rows > 0
        if some:
            yield from sketch_rows(np.packbits(table, bitorder="little"))

    got = merged_sketch(hashes.mapInArrow(fill, "piece int, data binary"), np.uint8, np.bitwise_or)
    return Bloom((got if len(got) else np.zeros((1 << bits) // 8, np.uint8)).tobytes(), bits)


#: Links that one task joins by itself, in some hundred MB.
ONE_TASK_LINKS = 1_000_000


def _joined(edges: DataFrame) -> DataFrame:
    """The components of at most ONE_TASK_LINKS links, by union-find in one task's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b), component the smallest node reachable.

    Up to ONE_TASK_LINKS links, counted first, are joined in one task. More are contracted by alternating stars (every
    neighbour, then every smaller one, is hung on the smallest); each round is a window minimum per node, spilled and
    never gathered, and ends as a written table. Stops when a round changes nothing. Both give the same result.
    """
    from pyspark.sql import Window

    spread = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = written(edges.select("a", "b"))
    if edges.count() <= ONE_TASK_LINKS:
        return _joined(edges)
    e = written(spread(edges))
    drop(edges)
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = spread(large)
        low = F.min("b").over(Window.partitionBy("a"))
        small = large.withColumn("m", low)
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b")
        then = written(spread(small))
        drop(e)
        now, e = mark(then), then
        if now == seen:
            break
        seen = now
    labels = e.groupBy("a").agg(F.min("b").alias("component"))
    return labels.select(F.col("a").alias("node"), "component")
