"""Operator 5, conflict-constrained best-fit packing.

Documents are packed into bins of `capacity` words, at most one document of a source and one of a duplicate cluster in a
bin. Rows are dealt into shards of some thousand documents by the hash of their id, so sources and clusters, hot ones too,
spread evenly; each shard is packed by itself in its task's stream, largest first. Its open bins are kept in the order
of their residual capacity, and each bin carries two bitmaps: the sources and the clusters that it holds, numbered
within the shard. The search starts at the smallest residual that fits and goes on to its successors until a bin meets
neither bit; that is the tightest compatible bin. If there is none, a bin is opened.

A document of more than `capacity` words fills bins of its own with whole pieces; its last piece is packed as above.

Nulls and edges: a null or wordless text has size 0 and is packed all the same; a null source is a source; without a
cluster column equal texts are a cluster, empty ones too. Rows with a null or repeated id are rows of their own. An empty
table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Documents of a shard, about.
SHARD = 4096


class Bins:
    """The open bins of a shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.numbers: dict[tuple, int] = {}

    def bit(self, *name) -> int:
        return 1 << self.numbers.setdefault(name, len(self.numbers))

    def put(self, size: int, source: str | None, cluster: int) -> int:
        s, c = self.bit("source", source), self.bit("cluster", cluster)
        for at in range(bisect_left(self.order, (size, -1)), len(self.order)):
            residual, bin_ = self.order[at]
            if not (self.sources[bin_] & s or self.clusters[bin_] & c):
                del self.order[at]
                break
        else:
            residual, bin_ = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[bin_] |= s
        self.clusters[bin_] |= c
        insort(self.order, (residual - size, bin_))
        return bin_

    def fill(self) -> int:
        """A bin that one piece fills."""
        self.sources.append(-1)
        self.clusters.append(-1)
        return len(self.sources) - 1


def packed(rows: Iterable[tuple], capacity: int) -> Iterator[tuple]:
    """(row's place, piece, size, bin) of a shard's rows (size, source, cluster), largest first."""
    bins = Bins(capacity)
    for i, (size, source, cluster) in enumerate(rows):
        pieces = max(0, size - 1) // capacity
        for piece in range(pieces):
            yield i, piece, capacity, bins.fill()
        last = size - pieces * capacity
        yield i, pieces, last, bins.fill() if last == capacity else bins.put(last, source, cluster)


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(doc_id, piece, size, shard, bin) of every piece of every row; bins are numbered within the shard."""
    shards = max(1, -(-docs.count() // SHARD))
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.lit(None).cast("long")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            same = [c if c is not None else xxhash.xxh3_64_intdigest(t) - (1 << 63) for c, t in zip(batch.column(3).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same, pa.int64()), pa.array([len(t.split()) for t in texts], pa.int32())], ["doc_id", "source", "cluster", "size"])

    sized = own.mapInArrow(measure, "doc_id long, source string, cluster long, size int")
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "source"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done():
            out = [(held[i][0], piece, size, held[i][4], bin_) for i, piece, size, bin_ in packed(((h[3], h[1], h[2]) for h in held), capacity)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "piece", "size", "shard", "bin"])

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[4] != held[0][4]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    order = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "cluster", "source")
    return order.select("doc_id", "source", "cluster", "size", "shard").mapInArrow(run, "doc_id long, piece int, size int, shard int, bin int")
