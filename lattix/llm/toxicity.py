"""Operator 8, toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their first four, five and six letters, hashed; a term counts once a text.
The machine adds a weight for each term present and an inner product for each pair of terms present, so it learns that
two harmless terms are toxic together.

Fitting: at most `rows` labelled documents, those with the smallest hashed ids, are looked at (a fixed bound, by which
the sample is broadcast). Executors count terms by label in tables of fixed size; the driver keeps the `terms` that tell
the labels apart best by themselves. If `pairs` is given, a first machine has these and, as neutral terms with damped factors and no weight,
all others in a share of `share` of the rows; the `pairs` neutral ones of strongest factors join the kept terms, as they
tell the labels apart in pairs, and the machine is fitted anew by mini-batches. Only ids whose crc32 (of the id as text) isn't divisible by `fold` teach.
Scoring reads every text in whole.

Nulls and edges: a null text is an empty one and gets the bias alone. Labels with a null id or label are left out; of
labels that differ for one id, the mean counts. Without any label every score is 0.0. A null id is scored, not held out
and never taught from. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged_sketch, sketch_rows, slices

SLOT_BITS = 20
WORD = re.compile(r"[^\W_]+")
HEADS = (4, 5, 6)


def slots_of(word: str) -> tuple[int, ...]:
    """The hashed terms of a word."""
    mask = (1 << SLOT_BITS) - 1
    return (xxhash.xxh3_64_intdigest("w" + word) & mask, *(xxhash.xxh3_64_intdigest(f"{n}{word[:n]}") & mask for n in HEADS if len(word) >= n))


class Terms(dict):
    """The kept terms of each word seen, as positions in the model."""

    def __init__(self, place: np.ndarray | None = None):
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 500_000:
            self.clear()
        out = slots_of(word)
        if self.place is not None:
            out = tuple(int(p) for p in self.place[list(out)] if p >= 0)
        self[word] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        found: set[int] = set().union(*map(self.__getitem__, set(WORD.findall((text or "").lower()))))
        return np.fromiter(found, np.int64, len(found))


@dataclass
class Model:
    place: np.ndarray  # by slot: position of a kept term, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    empty: bool = False

    def score(self, terms: np.ndarray) -> float:
        if self.empty:
            return 0.0
        v = self.factors[terms]
        z = self.bias + self.weights[terms].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit(lists: list[np.ndarray], y: np.ndarray, n: int, width: int, epochs: int, rate: float, shrink: float, seed: int, steps: int = 800, neutral: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam over mini-batches, for so many epochs and `steps` steps at least.

    Terms marked neutral have factors alone, which decay and move only as far as their gradients are steady and large.
    """
    rng = np.random.default_rng(seed)
    theta = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.01, (n, width))], 1)
    floor, decay = np.full((n, 1), 1e-8), np.ones((n, 1))
    if neutral is not None:
        floor[neutral], decay[neutral] = 1e-3, 1 - 0.1 * rate
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias, m, s, mb, sb, step = np.log(p / (1 - p)), np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(max(epochs, -(-steps // max(1, len(y) // 256)))):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            own = [lists[r] for r in rows]
            ends = np.cumsum([len(x) for x in own])
            sizes = np.diff(ends, prepend=0)
            at = np.repeat(np.arange(len(rows)), sizes)
            idx = np.concatenate(own)
            t = theta[idx]
            running = np.zeros((len(idx) + 1, width + 2))
            np.cumsum(np.concatenate([t, (t[:, 1:] ** 2).sum(1, keepdims=True)], 1), 0, out=running[1:])
            sums = running[ends] - running[ends - sizes]
            z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            each = e[at]
            slopes = [np.bincount(idx, each, n)] + [np.bincount(idx, each * (sums[at, k] - t[:, k]), n) for k in range(1, width + 1)]
            g = shrink * theta + np.stack(slopes, 1)
            if neutral is not None:
                g[neutral, 0] = 0
            step += 1
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + floor)
            theta[:, 1:] *= decay
            gb = e.sum()
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
    return float(bias), theta[:, 0].copy(), theta[:, 1:].copy()


def held_out(id_col, fold: int):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % fold == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5, rows: int = 20_000, terms: int = 8192, pairs: int = 0, share: float = 0.01, width: int = 4, epochs: int = 12, rate: float = 0.02, shrink: float = 1e-5, seed: int = 7) -> Model:
    """The machine learnt from at most `rows` labelled documents outside the held-out fold; docs (doc_id, text), labels (doc_id, toxic)."""
    spark = docs.sparkSession
    id_, toxic = F.col("doc_id").cast("long"), F.col("toxic").cast("double")
    known = labels.select(id_.alias("doc_id"), toxic.alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), fold))
    known = known.groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    taught = docs.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") >= 0.5).cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, table, some = Terms(), np.zeros((2, (1 << SLOT_BITS) + 1), np.uint32), False
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[label, cache.of(text)] += 1
                table[label, -1] += 1
                some = True
        if some:
            yield from sketch_rows(table.ravel())

    table = merged_sketch(taught.mapInArrow(count, "piece int, data binary"), np.uint32, np.add)
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    if not len(table):
        return Model(place, 0.0, np.zeros(0), np.zeros((0, width)), True)
    (no, none), (yes, all_) = ((x[:-1].astype(float), float(x[-1])) for x in table.reshape(2, -1))
    odds = lambda x, n: (x + 0.5) / (n - x + 0.5)
    z = np.abs(np.log(odds(yes, all_) / odds(no, none))) / np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5) + 1 / (all_ - yes + 0.5) + 1 / (none - no + 0.5))
    z[yes + no < min(5, 2 + (all_ + none) / 5000)] = 0
    kept = np.sort(np.argsort(-z, kind="stable")[:terms])
    kept = kept[z[kept] > 0]
    # Terms in a good share of the rows that tell nothing by themselves may do so in pairs.
    tried = np.union1d(kept, np.flatnonzero(yes + no >= max(5, share * (all_ + none))) if pairs else kept)
    place[tried] = np.arange(len(tried))
    given = spark.sparkContext.broadcast(place)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms(given.value)
        for batch in slices(batches):
            found = [np.sort(cache.of(t)).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), batch.column(1)], ["terms", "toxic"])

    got = sorted((bytes(r.terms), r.toxic) for r in taught.mapInArrow(lists, "terms binary, toxic int").collect())  # `rows` at most
    y = np.array([t for _, t in got], float)
    own = [np.frombuffer(x, np.int32) for x, _ in got]
    neutral = ~np.isin(tried, kept)
    if neutral.any():
        strength = (_fit(own, y, len(tried), width, epochs // 4, rate, shrink, seed, 400, neutral)[2] ** 2).sum(1)
        others = np.flatnonzero(neutral)
        kept = np.union1d(kept, tried[others[np.argsort(-strength[others], kind="stable")[:pairs]]])
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    to = place[tried]  # from the positions tried to those kept, or -1
    own = [(lambda x: x[x >= 0])(to[x]) for x in own]
    bias, weights, factors = _fit(own, y, len(kept), width, epochs, rate, shrink, seed)
    return Model(place, bias, weights, factors)


def _scored(docs: DataFrame, model: Model, fold: int) -> DataFrame:
    """(doc_id, held_out, score, predicted, kept) of every row, kept a struct of all its columns."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long"), fold).alias("held_out"), F.struct(*docs.columns).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        cache = Terms(m.place)
        for batch in slices(batches):
            scores = [m.score(cache.of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), batch.column(3)], ["doc_id", "held_out", "score", "predicted", "kept"])

    kind = own.schema["kept"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, kept {kind}")


def score(docs: DataFrame, model: Model, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return _scored(docs.select("doc_id", "text"), model, fold).select("doc_id", "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, fold: int = 5) -> DataFrame:
    """docs without the rows scored 0.5 or more; columns of any name stay as they are."""
    return _scored(docs, model, fold).where("predicted = 0").select("kept.*")
