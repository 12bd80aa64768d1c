"""Operator 9, sharding by minimax contiguous partition. Built-in DataFrame functions only.

Documents with equal texts form an atomic group. Groups stand in the order of their text's digest, an order that no
input can skew, and are cut into contiguous shards so that the largest shard is as small as any such cut allows: the
smallest feasible capacity is found by bisection, each capacity being checked greedily, and the groups are cut under it.

The search never sees all groups. It works on prefix sums over ranges of the digest, 4096 at first; every check gives a
lower and an upper bound for each cut, and only ranges in which a cut may still lie are split further (a factor of 4096
a round), so the driver holds some ten thousand numbers at 100 TB as here, and the result is exact.

Nulls: a null text counts as an empty one (size 1); a null id is kept. Repeated rows are rows of their own and share a
shard. An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scoped, written

#: Hex digits of the digest by which a range is split.
STEP = 3


class Ranges:
    """Prefix sums over ordered ranges of digests: names[i] covers sums[i] to sums[i + 1]; single where it is one group."""

    def __init__(self, fetch: Callable[[list[str]], list[tuple[str, int, int]]]):
        self.fetch = fetch
        self._set(fetch([""]))

    def _set(self, rows: list[tuple[str, int, int]]) -> None:
        self.rows = sorted(rows)
        self.names, self.single, self.sums = [r[0] for r in self.rows], [r[2] == 1 for r in self.rows], [0]
        for r in self.rows:
            self.sums.append(self.sums[-1] + r[1])
        self.total = self.sums[-1]

    def below(self, x: int, upper: bool = False) -> tuple[int, int]:
        """Where the last cut at or below x is, at least (or at most, with upper), and the range it lies in."""
        i = bisect_right(self.sums, x) - 1
        if i >= len(self.rows) or self.single[i] or not upper or x == self.sums[i]:
            return self.sums[i], i
        return min(x, self.sums[i + 1] - 1), i

    def greedy(self, capacity: int, shards: int, upper: bool = False, start: int = 0) -> list[int]:
        """The cuts that filling each shard as far as it goes makes."""
        at, cuts = start, []
        for _ in range(shards):
            at = self.below(at + capacity, upper)[0] if at + capacity < self.total else self.total
            cuts.append(at)
        return cuts

    def least(self, shards: int, upper: bool, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, upper)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def split(self, which: set[int]) -> None:
        names = [self.names[i] for i in which]
        self._set([r for i, r in enumerate(self.rows) if i not in which] + self.fetch(names))

    def capacity(self, shards: int, largest: int) -> int:
        """The smallest capacity under which the groups, in order, fit into so many shards."""
        while True:
            floor = max(largest, -(-self.total // shards))
            low = self.least(shards, True, floor, max(self.total, floor))
            high = self.least(shards, False, low, max(self.total, low))
            spans = list(zip(self.greedy(low, shards), self.greedy(high, shards, True)))
            open_ = set()
            for a, b in spans:
                i = self.below(a)[1]
                while i < len(self.rows) and self.sums[i] <= b:
                    if not self.single[i] and b > self.sums[i]:
                        open_.add(i)
                    i += 1
            if low == high and not open_:
                return high
            if not open_:
                return high
            self.split(open_)

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """The digests at which the second and later shards begin: each shard takes its part of what is left, within the capacity and as long as the rest still fits."""
        while True:
            at, out, open_ = 0, [], set()
            for left in range(shards, 1, -1):
                even = at - (-(self.total - at) // left)
                tries = [min(even, at + capacity), at + capacity]
                for x in tries:
                    cut, i = self.below(x) if x < self.total else (self.total, len(self.rows))
                    if i < len(self.rows) and not self.single[i] and x != self.sums[i]:
                        open_.add(i)
                    if cut == at and i < len(self.rows):  # one group above the even part
                        cut, i = self.sums[i + 1], i + 1
                        if cut > at + capacity:
                            continue
                    rest = self.greedy(capacity, left - 1, start=cut)
                    if rest[-1] >= self.total:
                        break
                else:
                    cut, i = self.below(at + capacity)
                at = cut
                out.append(self.names[i] if i < len(self.rows) else "g")  # above every hex digit
            if not open_:
                return out
            self.split(open_)


@scoped
def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, by the law `bytes`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("key"),
        )
    )
    groups = written(base.groupBy("key").agg(F.sum("size").alias("bytes")))

    def fetch(names: list[str]) -> list[tuple[str, int, int]]:
        out = []
        for long in {len(n) for n in names}:
            own = groups if not long else groups.where(F.substring("key", 1, long).isin([n for n in names if len(n) == long]))
            out += [tuple(r) for r in own.groupBy(F.substring("key", 1, long + STEP).alias("name")).agg(F.sum("bytes"), F.count("*")).collect()]
        return out

    rows, largest = base.count(), groups.agg(F.max("bytes")).first()[0] or 0
    ranges = Ranges(fetch)
    cuts = ranges.cuts(ranges.capacity(shards, largest), shards) if rows else []
    at: Column = F.lit(0)
    for name in cuts:
        at = at + (F.col("key") >= F.lit(name)).cast("int")

    # Slots: rows are dealt by the hash of the id, numbered within each part, and moved by the rows of the parts before.
    parts = min(4096, max(64, rows // 500_000))
    dealt = base.select("doc_id", "size", "text_crc32", "key", at.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).alias("part"))
    counts = written(dealt.groupBy("shard", "part").agg(F.count("*").alias("n")), 1)  # shards x parts rows at most
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key"))
    return (
        dealt.withColumn("within", within.cast("long") - 1)
        .join(F.broadcast(before), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
