"""Operator 4, exact top-k inner products by norm-bucketed retrieval.

Vectors (each component x as floor(64 x), in the smallest integers that hold them) are dealt into buckets of similar
length, the longest first. The queries meet the longest buckets first, which gives each query a score and an id that its
k-th answer can't fall below. In every other bucket that score, divided by the query's length and the bucket's greatest
length, is the query's local cosine threshold t:

- above 1 the bucket is left out for the query;
- by the bucket's median t, its vectors are then pruned either by length (only a prefix of the bucket, sorted by length,
  is long enough) or by coordinates: a unit vector at a cosine of t or more to the query has its component f between
  q_f t - r and q_f t + r, r = sqrt((1 - t^2)(1 - q_f^2)), which is tested on the query's largest coordinates.

What is left is verified by its product in integers, so the result is exact. Queries are a stated part of the rows,
dealt into blocks by the length that a vector must have for them. Some thousand rows of neighbouring buckets are a band,
some thousand queries of neighbouring blocks a band too; the heads of the bands alone (a number each) tell which two
bands may hold an answer, and only those are sent to a common task. It holds the band's queries and takes the buckets
one by one, longest first, so that each raises the thresholds for the next; of a pair of bands a query returns its best k.

Nulls and edges: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
vectors of different dimension never meet. Equal scores rank by id. Rows with the query's own id are not its answers;
a repeated row is an answer of its own, and a repeated query is answered each time. An empty table gives an empty result;
other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scoped, slices, written

#: Vectors of a bucket and queries of a block; rows of a band of either.
BUCKET, QUERIES, BAND = 2048, 1024, 8192
#: Median local threshold from which coordinates prune better than lengths, and the coordinates tested.
STEEP, COORDINATES = 0.5, 4
_SCHEMA = "id long, dim int, norm double, x binary"


def narrowest(x: np.ndarray) -> type:
    """The smallest kind of integers that holds all of x."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


def matrix(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of one dimension, each in integers of its own size, as one array."""
    rows = [np.frombuffer(x, f"i{len(x) // dim}") for x in data]
    return np.stack(rows) if len({r.dtype for r in rows}) == 1 else np.stack([r.astype(np.int64) for r in rows])


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, norm, x) of the rows that take part, x as integers of one, two, four or eight bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.column(1)
            wide = np.asarray(pc.fill_null(pc.list_value_length(rows), -1))
            values = rows.flatten()
            holes = np.asarray(values.is_null())
            values = np.asarray(pc.fill_null(values, 0), dtype=np.float64)
            ids, out, at = batch.column(0).to_pylist(), [], 0
            for i, n in zip(ids, wide.tolist()):
                if n < 0:
                    continue
                v, gone = values[at : at + n], holes[at : at + n]
                at += n
                if i is None or not n or gone.any() or not np.isfinite(v).all():
                    continue
                x = np.floor(64 * v).astype(np.int64)
                out.append((i, n, float(np.sqrt((x.astype(float) ** 2).sum())), x.astype(narrowest(x)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.float64(), pa.binary()))], ["id", "dim", "norm", "x"])

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.mapInArrow(run, _SCHEMA)


def _packed(rows: DataFrame, room: int) -> DataFrame:
    """Blocks (part, dim, top, ids, xs, keys, least, last, reach, n) of at most `room` neighbouring rows (dim, norm, id, x, key, least, last) of a partition.

    top is the greatest length, reach the least length that a vector must have for any of the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block():
            dim, col = held[0]["dim"], lambda c, kind: np.array([h[c] for h in held], kind)
            least, norm, xs = col("least", float), col("norm", float), matrix([h["x"] for h in held], held[0]["dim"])
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(np.isneginf(least) | (norm == 0), -np.inf, least / norm).min()
            one = [dim, norm.max(), col("id", np.int64).tobytes(), xs.tobytes(), col("key", np.int64).tobytes(), least.tobytes(), col("last", np.int64).tobytes(), float(reach) * (1 - 1e-12) - 1e-9, len(held)]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(one, kinds)], names)

        names = ["dim", "top", "ids", "xs", "keys", "least", "last", "reach", "n"]
        kinds = [pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32()]
        for batch in slices(batches):
            for r in batch.to_pylist():
                if held and (len(held) >= room or r["dim"] != held[0]["dim"]):
                    yield block()
                    held = []
                held.append(r)
        if held:
            yield block()

    own = rows.select("dim", "norm", "id", "x", "key", "least", "last")
    return own.mapInArrow(run, "dim int, top double, ids binary, xs binary, keys binary, least binary, last binary, reach double, n int").withColumn("part", F.spark_partition_id())


def _banded(blocks: DataFrame, rows: int) -> DataFrame:
    """Blocks with their band: neighbouring partitions of BAND rows together, by the partitions' mean."""
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    return blocks.withColumn("band", F.floor(F.col("part") * F.lit(rows / parts) / F.lit(BAND)).cast("int"))


def answers(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, last: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query that has any in this bucket: its position, and ids and scores of the best k that rank before the score `least` of the id `last`."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, v.shape[1]) < 2**53
    kind = np.float64 if exact else np.int64
    v, q = v.astype(kind), q.astype(kind)
    norms = np.sqrt((v.astype(float) ** 2).sum(1))
    by = np.argsort(-norms, kind="stable")
    v, v_ids, norms = v[by], v_ids[by], norms[by]
    lengths = np.sqrt((q.astype(float) ** 2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(np.isneginf(least), -np.inf, least / lengths)  # the length that a vector must have
    need[(lengths == 0) & (least <= 0)] = -np.inf
    need[(lengths == 0) & (least > 0)] = np.inf
    top = norms[0] if len(norms) else 0.0
    slack = 1e-9 * max(1.0, top)
    live = np.flatnonzero(need <= top + slack)
    if not len(live):
        return
    t = np.clip(need[live] / max(top, 1e-300), -1, 1)
    if top > 0 and np.median(t) >= STEEP:  # by coordinates
        unit = v.astype(float) / np.maximum(norms, 1e-300)[:, None]
        for i, ti in zip(live.tolist(), t.tolist()):
            e = q[i].astype(float) / max(lengths[i], 1e-300)
            reach = int(np.searchsorted(-norms, -(need[i] - slack), "right"))
            keep = np.ones(reach, bool)
            if ti > 0:
                for f in np.argsort(-np.abs(e))[:COORDINATES].tolist():
                    r = np.sqrt(max(0.0, (1 - ti * ti) * (1 - e[f] * e[f]))) + 1e-9
                    # cosines above t allow the whole cap, so the band's ends open where the cap holds the pole
                    high = 1.0 if e[f] >= ti else e[f] * ti + r
                    low = -1.0 if -e[f] >= ti else e[f] * ti - r
                    keep &= (unit[:reach, f] <= high) & (unit[:reach, f] >= low)
            at = np.flatnonzero(keep)
            yield from _best(i, v[at] @ q[i], v_ids[at], q_ids[i], least[i], last[i], k)
    else:  # by length
        reach = np.searchsorted(-norms, -(need[live] - slack), "right")
        for rows in np.array_split(np.argsort(reach, kind="stable"), max(1, len(live) // 64)):
            if not len(rows):
                continue
            scores = q[live[rows]] @ v[: int(reach[rows].max())].T
            for row, s in zip(rows.tolist(), scores):
                n = int(reach[row])
                yield from _best(int(live[row]), s[:n], v_ids[:n], q_ids[live[row]], least[live[row]], last[live[row]], k)


def _best(i: int, scores: np.ndarray, ids: np.ndarray, own: int, least: float, last: int, k: int):
    ok = np.flatnonzero(((scores > least) | (scores == least) & (ids < last)) & (ids != own))
    if len(ok):
        if len(ok) > 4 * k:
            cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
            ok = ok[scores[ok] >= cut]
        ok = ok[np.lexsort((ids[ok], -scores[ok]))[:k]]
        yield i, ids[ok], scores[ok].astype(np.int64)


class Asked:
    """The queries of a band with their best k so far."""

    def __init__(self, blocks: list[dict], k: int):
        join = lambda c, kind: np.concatenate([np.frombuffer(b[c], kind) for b in blocks])
        xs = [np.frombuffer(b["xs"], f"i{len(b['xs']) // b['dim'] // b['n']}").reshape(b["n"], b["dim"]).astype(np.int64) for b in blocks]
        self.q, self.ids, self.keys, self.least, self.last, self.k = np.concatenate(xs), join("ids", np.int64), join("keys", np.int64), join("least", float), join("last", np.int64), k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, v: np.ndarray, v_ids: np.ndarray) -> None:
        for i, ids, scores in list(answers(self.q, self.ids, self.least, self.last, v, v_ids, self.k)):
            if i in self.found:
                ids, scores = np.concatenate([self.found[i][0], ids]), np.concatenate([self.found[i][1], scores])
                by = np.lexsort((ids, -scores))[: self.k]
                ids, scores = ids[by], scores[by]
            self.found[i] = ids, scores
            if len(ids) == self.k:
                self.least[i], self.last[i] = scores[-1], ids[-1]

    def rows(self) -> pa.RecordBatch:
        n = [len(x[0]) for x in self.found.values()]
        at = np.repeat(np.fromiter(self.found, np.int64, len(n)), n)
        ids, scores = ([x[j] for x in self.found.values()] or [np.empty(0, np.int64)] for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(self.keys[at]), pa.array(self.ids[at]), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query", "query_id", "vec_id", "score"])


def _met(queries: DataFrame, buckets: DataFrame, parts: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): the best k of each query in each band of buckets that may hold an answer."""
    heads = lambda x, name, end: x.groupBy("dim", F.col("band").alias(name)).agg(end)
    pairs = heads(buckets, "v", F.max("top").alias("top")).join(heads(queries, "q", F.min("reach").alias("reach")), "dim").where("top >= reach").select("dim", "v", "q")
    pairs = written(pairs)  # a few numbers a pair of bands
    columns = ["v", "q", "asks", "dim", "top", "ids", "xs", "keys", "least", "last", "n"]
    ask = queries.withColumnRenamed("band", "q").join(pairs, ["dim", "q"]).withColumn("asks", F.lit(True)).select(columns)
    say = buckets.withColumnRenamed("band", "v").join(pairs, ["dim", "v"]).withColumn("asks", F.lit(False)).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, asked = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if at != (r["v"], r["q"], r["dim"]):
                    if asked and asked.found:
                        yield asked.rows()
                    at, held, asked = (r["v"], r["q"], r["dim"]), [], None
                if r["asks"]:
                    held.append(r)
                    continue
                asked = asked or Asked(held, k)
                v = np.frombuffer(r["xs"], f"i{len(r['xs']) // r['dim'] // r['n']}").reshape(r["n"], r["dim"])
                asked.meet(v, np.frombuffer(r["ids"], np.int64))
        if asked and asked.found:
            yield asked.rows()

    both = ask.union(say).repartition(parts, "v", "q", "dim").sortWithinPartitions("v", "q", "dim", F.desc("asks"), F.desc("top"))
    return both.select("v", "q", "asks", "dim", "ids", "xs", "keys", "least", "last", "n").mapInArrow(run, "query long, query_id long, vec_id long, score long")


@scoped
def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each row whose id is divisible by `every` with all other rows."""
    spark = vectors.sparkSession
    nothing = lambda x: x.withColumns({"least": F.lit(float("-inf")), "last": F.lit(-1).cast("long")})
    rows = written(_valid(vectors, id_col, vector_col))
    asked = written(rows.where(F.pmod("id", F.lit(every)) == 0).withColumn("key", F.monotonically_increasing_id()))
    n, n_asked = rows.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal lengths are told apart by the id's hash, so that a frequent vector fills several buckets.
    dealt = lambda x, count, room, by: _packed(x.repartitionByRange(max(1, -(-count // room)), F.col("dim"), by, F.xxhash64("id", "x")).sortWithinPartitions("dim", by), room)
    buckets = _banded(written(dealt(nothing(rows).withColumn("key", F.lit(0).cast("long")), n, BUCKET, F.col("norm").desc())), n)
    first = written(_met(_banded(written(dealt(nothing(asked), n_asked, QUERIES, F.col("norm"))), n_asked), buckets.where("band = 0"), parts, k))

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    known = best(first).where(F.col("rank") == k).select(F.col("query").alias("key"), F.col("score").cast("double").alias("least"), F.col("vec_id").alias("last"))
    told = asked.join(known, "key", "left").withColumns({"least": F.coalesce("least", F.lit(float("-inf"))), "last": F.coalesce("last", F.lit(-1))})
    need = F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).otherwise(F.lit(float("-inf")))
    rest = _met(_banded(written(dealt(told, n_asked, QUERIES, need)), n_asked), buckets.where("band > 0"), parts, k)
    return best(written(first.union(rest))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
