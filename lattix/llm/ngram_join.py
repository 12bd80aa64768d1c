"""Operator 6, n-gram Jaccard self-join by prefix trees.

A document's set holds its distinct n-word shingles as 64-bit numbers in one global order: shingles that fill crowded
cells of a count sketch over the whole corpus come last, ties by hash. Two sets with a Jaccard similarity of at least t
share one of the first n - ceil(t n) + 1 numbers of each, and k of the first n - ceil(t n) + k (their prefixes; k here is
1 and a tenth of n), so:

1. One pass over the texts gives each row its set's identity and size, and the sketch. Rows with one set (copies) become
   one node, the smallest id.
2. A second pass sends out (number, id) for the prefixes. Numbers held by one node alone are dropped, and so are nodes
   left with fewer numbers than a similar set would share with them; the holders of the numbers left are groups, those with the same smallest node one group. Nodes with no other of a fitting size in their group go.
3. Each group is joined locally: its sets are stored in a path-compressed trie, a probe walks down the trie carrying the
   overlap so far, so documents that begin alike share that work, and a subtree is left where the lengths that remain
   can't reach the overlap needed. Subtrees already connected to the probe are left too (union-find), so a group of
   thousands of near copies costs a few comparisons each.

Groups are described by their distinct set sizes, counted before anything is shuffled by group, so a group that holds a
third of all rows is a few rows a size. Large groups are dealt into blocks by set size. After all blocks are joined by
themselves, a group of several blocks that still holds two components is joined again: rows of its main component lie in
one block, all others visit, as probes, the blocks that hold sets of a fitting size, so each two rows of different
components that may be linked meet, and no task stores more than a block. That makes the result exact. Numbers of crowded
cells are counted in two steps, others in a window. The sketch and the filter that finds the texts wanted have fixed or
capped sizes; a full filter lets through texts that the join by node then drops.

Nulls and edges: a null text or one without words has an empty set, size 0, linked with nothing. With fewer than n words
the whole sequence is the one shingle. A row with a null id is returned without component and links nothing. Rows that
repeat an id are one node. An empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_of, components, drop, merged_sketch, scoped, sketch_rows, slices, written
from .words import shingles

SKETCH_BITS = 22
#: Rows of a group that one task stores.
BLOCK_ROWS = 1024
#: Percent of a set's size by which its prefix is longer than one shared number needs; similar sets then share so many more.
EXTRA = 10
#: Level (quarter octaves over the mean) from which a cell is crowded, and the parts in which its numbers are dealt.
CROWDED, SALTS = 16, 4096
#: The filter takes 16 bits an entry, from 2**20 to 2**30 in all.
FILTER_BITS = 30
MULTIPLIER = 0x9E3779B97F4A7C15


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The hashes as numbers of the global order: six bits of the cell's level, then the hash."""
    return np.sort((levels[cells(hashes)].astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6)))


def prefix(size: int, percent: int) -> int:
    """How many of a set's first numbers are sent: two similar sets share as many there as the smaller one's `share`."""
    return size - -(-percent * size // 100) + share(size)


def share(size: int) -> int:
    return 1 + size * EXTRA // 100


class Links:
    """Union-find over the sets of one block."""

    def __init__(self):
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(j)] = self.find(i)


class Node:
    __slots__ = ("run", "children", "rows", "low", "high", "tail", "one")

    def __init__(self, run: np.ndarray, size: int, row: int):
        self.run, self.children, self.rows = run, {}, []
        self.low = self.high = size  # set sizes below
        self.tail = len(run)  # most numbers from this run's start to a leaf
        self.one = row  # a row of the one component below, or -1


class PrefixTree:
    """Globally ordered sets, stored so that equal beginnings are one path."""

    def __init__(self, percent: int):
        self.root, self.percent, self.links = Node(np.empty(0, np.uint64), 0, -1), percent, Links()
        self.root.low, self.root.tail = 1 << 60, 0

    def insert(self, s: np.ndarray, row: int) -> None:
        node, at, find = self.root, 0, self.links.find
        while True:
            node.low, node.high = min(node.low, len(s)), max(node.high, len(s))
            node.tail = max(node.tail, len(node.run) + len(s) - at)
            if node.one >= 0 and find(node.one) != find(row):
                node.one = -1
            if at == len(s):
                node.rows.append(row)
                return
            key = int(s[at])
            child = node.children.get(key)
            if child is None:
                node.children[key] = leaf = Node(s[at:], len(s), row)
                leaf.rows.append(row)
                return
            rest = s[at:]
            wide = min(len(rest), len(child.run))
            differ = np.flatnonzero(rest[:wide] != child.run[:wide])
            same = int(differ[0]) if len(differ) else wide
            if same < len(child.run):  # the path forks within the run
                fork = Node(child.run[:same], child.low, child.one)
                fork.high, fork.tail = child.high, child.tail
                child.run, child.tail = child.run[same:], child.tail - same
                fork.children[int(child.run[0])] = child
                node.children[key] = child = fork
            node, at = child, at + same

    def probe(self, s: np.ndarray, row: int) -> list[int]:
        """Rows of other components that s is linked with; one at least of each, joined to row's component on the way."""
        size, need, found, find = len(s), self.percent, [], self.links.find
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            if node.one >= 0 and find(node.one) == find(row) or need * size > 100 * node.high or need * node.low > 100 * size:
                continue
            run, fits = node.run, True
            for start in range(0, len(run), 64):
                # i / (size + other - i) >= t needs i >= t (size + other) / (1 + t)
                if (100 + need) * (overlap + min(size - at, node.tail - start)) < need * (size + node.low):
                    fits = False
                    break
                part = run[start : start + 64]
                upto = at + int(np.searchsorted(s[at:], part[-1], "right"))
                if upto > at:
                    x = s[at:upto]
                    where = np.searchsorted(x, part)
                    where[where == len(x)] = len(x) - 1
                    overlap += int(np.count_nonzero(x[where] == part))
                at = upto
            if not fits or (100 + need) * (overlap + min(size - at, node.tail - len(run))) < need * (size + node.low):
                continue
            if node.rows:
                other = len(self.sets[node.rows[0]])
                if 100 * overlap >= need * (size + other - overlap):
                    for r in node.rows:
                        if find(r) != find(row):
                            self.links.join(row, r)
                            found.append(r)
            stack += [(child, at, overlap) for child in node.children.values()]
        return found

    sets: list[np.ndarray]


def joined(rows: Iterator[tuple[bool, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links within one block from rows (visits, id, set), stored rows first: enough of them to connect all that are linked."""
    tree = PrefixTree(percent)
    tree.sets, ids, stored, seen = [], [], True, {}
    for visits, doc, s in rows:
        if doc in seen and np.array_equal(tree.sets[seen[doc]], s):
            continue
        row = tree.links.add()
        tree.sets.append(s if not visits else s[:0])
        ids.append(doc)
        for r in tree.probe(s, row):
            yield doc, ids[r]
        if not visits:
            seen[doc] = row
            tree.insert(s, row)


class _Pass:
    """What a pass over the texts needs; travels to the executors by broadcast."""

    def __init__(self, n: int, percent: int, levels: np.ndarray):
        self.n, self.percent, self.levels = n, percent, levels


def _identities(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, set_id, n_shingles, piece, data): a row for each document, and the task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, many = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        names = ["doc_id", "set_id", "n_shingles", "piece", "data"]
        some = False
        for batch in slices(batches):
            out = []
            for s in shingles(batch.column(1).to_pylist(), n):
                out.append((xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, len(s)))
                held.append(s)
                many += len(s)
                if many > 2_000_000:
                    table += np.bincount(cells(np.concatenate(held)), minlength=len(table)).astype(np.uint32)
                    held, many = [], 0
            some = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())], names)
        if some:
            if held:
                table += np.bincount(cells(np.concatenate(held)), minlength=len(table)).astype(np.uint32)
            for batch in sketch_rows(table):
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), batch.column(0), batch.column(1)], names)

    return docs.mapInArrow(run, "doc_id long, set_id binary, n_shingles long, piece int, data binary")


def _levels(counts: np.ndarray) -> np.ndarray:
    """How crowded each cell is against the mean, in quarter octaves."""
    if not len(counts):
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    over = counts / max(1.0, float(counts.mean()))
    return np.clip(np.floor(4 * np.log2(np.maximum(over, 1))), 0, 63).astype(np.uint8)


def _prefixes(docs: DataFrame, about) -> DataFrame:
    """(number, doc_id) for each prefix; a task sends copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, seen = about.value, set()
        for batch in slices(batches):
            numbers, owners = [], []
            for doc, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1).to_pylist(), x.n)):
                if doc is None or not len(s) or (key := xxhash.xxh3_64_intdigest(s.tobytes())) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                s = ordered(s, x.levels)[: prefix(len(s), x.percent)]
                numbers.append(s)
                owners.append(np.full(len(s), doc, np.int64))
            if numbers:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers).view(np.int64)), pa.array(np.concatenate(owners))], ["number", "doc_id"])

    return docs.mapInArrow(run, "number long, doc_id long")


def _texts(docs: DataFrame, nodes) -> DataFrame:
    """(node, text): the whole texts, compressed, of the rows that may be nodes wanted; it takes a fifth of the room of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        those, pack = nodes.value, zstandard.ZstdCompressor(3).compress
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            asked = [i for i, ok in enumerate(those.test(np.array([d or 0 for d in ids], np.int64).view(np.uint64))) if ok and ids[i] is not None]
            if asked:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in asked], pa.int64()), pa.array([pack(batch.column(1)[i].as_py() or b"") for i in asked], pa.binary())], ["node", "text"])

    return docs.mapInArrow(run, "node long, text binary")


def _linked(members: DataFrame, about, parts: int) -> DataFrame:
    """Links (a, b) found in each block. Rows stream through in order; a task holds one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        x, unpack = about.value, zstandard.ZstdDecompressor().decompress

        def rows():
            for batch in slices(batches):
                for at in range(0, batch.num_rows, 32):
                    low, block, visits, doc, data = (c.to_pylist() for c in batch.slice(at, 32).columns)
                    sets = shingles([unpack(d) for d in data], x.n)
                    yield from zip(low, block, visits, doc, (ordered(s, x.levels) for s in sets))

        links: list[tuple[int, int]] = []
        for _, group in groupby(rows(), key=lambda r: r[:2]):
            links += joined((r[2:] for r in group), x.percent)
            if len(links) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return members.repartition(parts, "low", "block").sortWithinPartitions("low", "block", "visits").select("low", "block", "visits", "node", "text").mapInArrow(run, "a long, b long")


@scoped
def similar(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id reachable by links of percent % similarity."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    first = written(_identities(docs, n))
    rows = first.where("piece is null").select("doc_id", "set_id", "n_shingles")
    levels = _levels(merged_sketch(first.where("piece is not null").select("piece", "data"), np.uint32, np.add))
    about = spark.sparkContext.broadcast(_Pass(n, percent, levels))

    copies = written(rows.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1").select("set_id", "node"))
    nodes = written(rows.join(copies, "set_id", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"), "n_shingles"))

    # Numbers that two nodes or more hold; their groups, merged by the smallest node of each. Numbers of crowded cells are
    # taken as held by several, and their least and greatest nodes are aggregated, so that no window holds a frequent one.
    crowded = F.shiftrightunsigned("number", 58) >= CROWDED
    w = Window.partitionBy("number", F.when(crowded, F.pmod("doc_id", F.lit(SALTS))).otherwise(F.lit(0)))
    shared = written(_prefixes(docs, about).withColumn("holders", F.when(crowded, F.lit(2)).otherwise(F.count("*").over(w))).where("holders > 1").select("number", "doc_id"))
    known = nodes.where("node is not null")
    # A set similar to another shares at least as many prefix numbers as the smallest set that can be similar to it has to.
    least = F.expr(f"((n_shingles * {percent} + 99) div 100 * {EXTRA}) div 100 + 1")
    held = shared.join(known.distinct(), "doc_id").withColumn("common", F.count("*").over(Window.partitionBy("doc_id", "node", "n_shingles"))).where(F.col("common") >= least)
    held = written(held.select("number", "node"))
    drop(shared)
    ends = lambda x: [F.min("node").alias("low"), F.max("node").alias("high")] if x is None else [F.min("node").over(x).alias("low"), F.max("node").over(x).alias("high")]
    few = held.where(~crowded).select("number", "node", *ends(Window.partitionBy("number")))
    many = held.where(crowded).join(held.where(crowded).groupBy("number").agg(*ends(None)), "number")
    grouped = few.union(many.select(few.columns)).where("low <> high").groupBy("low", "node").agg(F.lit(1).alias("one"))

    # Sets of very different sizes can't be linked: a node without a neighbour in size in its group goes.
    sizes = known.where("node = doc_id").groupBy("node").agg(F.max("n_shingles").alias("most"), F.min("n_shingles").alias("least"))
    groups = written(grouped.join(sizes, "node").select("low", "node", "least", "most"))
    drop(held)
    by_size = Window.partitionBy("low").orderBy("least", "most")
    near = lambda small, large: small * 100 >= large * percent
    kinds = groups.groupBy("low", "least", "most").agg(F.count("*").alias("alike"))
    kinds = kinds.withColumns({"next": F.lead("least").over(by_size), "before": F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1))})
    kinds = kinds.where((F.col("alike") > 1) | near(F.col("most"), F.col("next")) | near(F.col("before"), F.col("least")))
    kinds = kinds.withColumns({"before": F.sum("alike").over(by_size) - F.col("alike"), "blocks": F.ceil(F.sum("alike").over(Window.partitionBy("low")) / F.lit(BLOCK_ROWS)).cast("int")})
    kinds = written(kinds.select("low", "least", "most", "alike", "before", "blocks"))
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("low", "node"), "alike")) / F.lit(BLOCK_ROWS)).cast("int")
    members = written(groups.join(kinds, ["low", "least", "most"]).select("low", "node", "least", "most", "blocks", block.alias("block")))
    drop(groups)
    links = _joined_groups(docs, about, members.select("low", "node", "block", F.lit(False).alias("visits")))
    copied = known.where("node <> doc_id").select("doc_id", "node")

    # Groups of several blocks that still hold two components: all but the most frequent component visit every block that
    # holds a set of a fitting size.
    large = members.where("blocks > 1")
    if not large.isEmpty():
        left = large.join(written(components(links)), "node", "left").withColumn("component", F.coalesce("component", "node"))
        per = left.groupBy("low", "component").agg(F.count("*").alias("n"))
        main = per.groupBy("low").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
        open_ = written(left.join(written(main), "low").select("low", "node", "least", "most", "block", (F.col("component") == F.col("main")).alias("stays")))
        ranges = open_.groupBy("low", "block").agg(F.min("least").alias("from"), F.max("most").alias("to"))
        asked = open_.where("not stays").select("low", "least", "most").distinct()
        visits = written(asked.join(ranges, "low").where(near(F.col("to"), F.col("least")) & near(F.col("most"), F.col("from"))).select("low", "least", "most", F.col("block").alias("visited")))
        visiting = open_.where("not stays").join(visits, ["low", "least", "most"]).select("low", "node", F.col("visited").alias("block"), (F.col("visited") != F.col("block")).alias("visits"))
        met = visits.select("low", F.col("visited").alias("block")).distinct()
        staying = open_.where("stays").join(met, ["low", "block"], "left_semi").select("low", "node", "block", F.lit(False).alias("visits"))
        links = links.union(_joined_groups(docs, about, visiting.union(staying)))
    final = components(links.union(copied).toDF("a", "b"))
    return nodes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _joined_groups(docs: DataFrame, about, members: DataFrame) -> DataFrame:
    """Links found in each block of members (low, node, block, visits)."""
    spark = docs.sparkSession
    members = written(members)
    many = members.count()
    if not many:
        return spark.createDataFrame([], "a long, b long")
    bits = min(FILTER_BITS, max(20, int(np.ceil(np.log2(16 * many)))))
    wanted = spark.sparkContext.broadcast(bloom_of(members.select("node"), bits))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // 50_000)
    return written(_linked(_texts(docs, wanted).join(members, "node"), about, parts))
