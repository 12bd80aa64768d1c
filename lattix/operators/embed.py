"""Principal components, neighbours, label transfer, clusters and simulation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .summary import kept


def vectors(records: DataFrame, n_features: int, key: str = "bc_id", other: str = "ft_id") -> DataFrame:
    """(key, features) as MLlib vectors of a layer's records."""
    from pyspark.ml.functions import array_to_vector

    from .layout import dense

    return dense(records, n_features, key, other).select(key, array_to_vector("values").alias("features"))


def train_pca(rows: DataFrame, k: int, column: str = "features"):
    from pyspark.ml.feature import PCA

    return PCA(k=k, inputCol=column, outputCol="_pca").fit(rows)


def apply_pca(model, rows: DataFrame, out: str = "X_pca") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(out, vector_to_array("_pca")).drop("_pca")


def neighbours(queries: DataFrame, base: DataFrame, k: int, key: str, column: str) -> DataFrame:
    """(query, neighbour, distance): the k nearest rows of base for each stated query, squared Euclidean.

    Queries are a stated set; they are dealt in blocks of rows that meet blocks of the base as arrays, and each pair of
    blocks returns k rows a query at most.
    """
    import pyarrow as pa

    def packed(df, name, n):
        x = df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("v is not null")
        return x.withColumn(f"{name}_b", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy(f"{name}_b").agg(F.collect_list(F.struct("id", "v")).alias(name))

    n_q, n_b = (max(1, -(-df.count() // 1024)) for df in (queries, base))
    q, b = packed(queries, "q", n_q), packed(base, "b", n_b)
    pairs = b.withColumn("q_b", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("q_b", F.col("q_b").cast("long")).join(q, "q_b").select("q", "b")

    def run(batches):
        import numpy as np

        def arrays(x):  # one block: its ids, and its vectors as one array
            ids, v = x.field("id").to_numpy(), x.field("v")
            return ids, v.flatten().to_numpy().reshape(len(ids), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                (qi, qv), (bi, bv) = (arrays(batch.column(j)[i].values) for j in (0, 1))
                d = ((qv**2).sum(1)[:, None] + (bv**2).sum(1)[None, :] - 2 * qv @ bv.T).clip(0)
                d[qi[:, None] == bi[None, :]] = np.inf
                at = np.argsort(d, 1, kind="stable")[:, :k]
                r = np.repeat(np.arange(len(qi)), at.shape[1])
                c = at.ravel()
                ok = np.isfinite(d[r, c])
                yield pa.RecordBatch.from_arrays([pa.array(qi[r[ok]]), pa.array(bi[c[ok]]), pa.array(d[r[ok], c[ok]])], ["query", "neighbour", "distance"])

    found = pairs.mapInArrow(run, "query long, neighbour long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def transferred_labels(found: DataFrame, labels: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query, label, share): the most frequent label among each query's neighbours, ties to the smaller."""
    x = found.join(labels.select(F.col(key).alias("neighbour"), "label"), "neighbour").groupBy("query", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("query"))
    w = Window.partitionBy("query").orderBy(F.desc("n"), "label")
    return x.withColumns({"share": F.col("n") / total, "r": F.row_number().over(w)}).where("r = 1").select("query", "label", "share")


def spread_subsample(found: DataFrame, total: int, labels: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """(query, avg_dist) of a subsample that thins dense regions: the rows of the greatest mean distance to their neighbours; with labels (key, label) from each label in its share, one at least."""
    mean = found.groupBy("query").agg(F.avg("distance").alias("avg_dist"))
    if labels is None:
        return mean.orderBy(F.desc("avg_dist"), "query").limit(total)
    x = mean.join(labels.select(F.col(key).alias("query"), "label"), "query")
    sizes = x.groupBy("label").agg(F.count("*").alias("n"))  # a row a label
    every = sizes.agg(F.sum("n").alias("every"))
    quota = sizes.join(F.broadcast(every)).select("label", F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("n") / F.col("every"))).alias("quota"))
    w = Window.partitionBy("label").orderBy(F.desc("avg_dist"), "query")
    return x.join(F.broadcast(quota), "label").withColumn("r", F.row_number().over(w)).where("r <= quota").select("query", "avg_dist")


def thinned(rows: DataFrame, total: int, key: str, column: str, k: int = 10, iterations: int = 1, labels: DataFrame | None = None) -> DataFrame:
    """(query, avg_dist) after so many rounds, each of which takes the neighbours among what the last one left and comes nearer to the total by an equal factor."""
    n = rows.count()
    for i in range(iterations):
        goal = max(total, round(n * (total / n) ** ((i + 1) / iterations))) if n > total else total
        out = spread_subsample(neighbours(rows, rows, k, key, column), goal, labels, key)
        if i + 1 < iterations:
            rows = kept(rows.join(out.select(F.col("query").alias(key)), key, "left_semi"))
    return out


def communities(found: DataFrame, rounds: int = 20, resolution: int = 1) -> DataFrame:
    """(node, community) by label propagation over a neighbour table: every node starts with its own label and takes, round by round, the one that most of its neighbours have (either way round; ties, and a node's own vote, to the smaller).

    Each round is a join and an aggregate whose result is written, so no lineage grows; it stops when nothing changes.
    A node's own label has `resolution` votes, which keeps pairs from swapping for ever.
    """
    edges = kept(found.select(F.col("query").alias("a"), F.col("neighbour").alias("b")).union(found.select("neighbour", "query")).distinct())
    label = kept(edges.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    w = Window.partitionBy("node").orderBy(F.desc("votes"), "community")
    for _ in range(rounds):
        heard = edges.join(label.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "community", F.lit(1).alias("n"))
        own = label.select("node", "community", F.lit(resolution).alias("n"))
        votes = heard.union(own).groupBy("node", "community").agg(F.sum("n").alias("votes"))
        new = kept(votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "community"))
        changed = new.join(label.withColumnRenamed("community", "old"), "node").where("community <> old").limit(1).count()
        label = new
        if not changed:
            break
    return label


class Layout:
    """Places in the plane of a bounded sample of rows, to which others are added by their nearest neighbours."""

    def __init__(self, sample: DataFrame, places: dict[int, tuple[float, float]], key: str, column: str, k: int):
        self.sample, self.places, self.key, self.column, self.k = sample, places, key, column, k


def train_layout(rows: DataFrame, key: str, column: str, most: int = 5000, k: int = 15, epochs: int = 200, seed: int = 0) -> Layout:
    """A layout in which neighbours attract and random others repel each other, as in manifold embeddings.

    It is fitted on the driver to at most `most` rows, those of smallest drawn digits (a documented bound); neighbours are
    exact. The first two principal directions of the sample are where it starts.
    """
    import numpy as np

    from .clusters import drawn

    own = rows.select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias(column)).where(F.col(column).isNotNull())
    sample = kept(own.orderBy(drawn(seed, key), key).limit(most))
    got = sorted((r[0], r[1]) for r in sample.collect())
    ids, x = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    n = len(ids)
    if n < 3:
        return Layout(sample, {int(i): (float(j), 0.0) for j, i in enumerate(ids)}, key, column, k)
    squares = (x**2).sum(1)
    d = (squares[:, None] + squares[None, :] - 2 * x @ x.T).clip(0)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, : min(k, n - 1)]
    dist = np.sqrt(np.take_along_axis(d, near, 1))
    gap = dist - dist[:, :1]
    weight = np.exp(-gap / np.maximum(gap.mean(1, keepdims=True), 1e-9))
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    y = centred @ axes[: min(2, len(axes))].T
    y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
    y = 10 * y / max(np.abs(y).max(), 1e-9)
    rng = np.random.default_rng(seed)
    heads, tails, w = np.repeat(np.arange(n), near.shape[1]), near.ravel(), weight.ravel()
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        step = np.zeros_like(y)
        apart = y[heads] - y[tails]
        pull = (-2 * w / (1 + (apart**2).sum(1)))[:, None] * apart
        np.add.at(step, heads, pull)
        np.add.at(step, tails, -pull)
        others = rng.integers(0, n, (5, n))
        for o in others:
            apart = y - y[o]
            r = (apart**2).sum(1)
            step += (2 / ((0.01 + r) * (1 + r)))[:, None] * apart * (r > 0)[:, None]
        y += 0.1 * rate * step.clip(-4, 4)
    return Layout(sample, {int(i): (float(a), float(b)) for i, (a, b) in zip(ids, y)}, key, column, k)


def apply_layout(layout: Layout, rows: DataFrame) -> DataFrame:
    """(key, x, y) of every row: its place in the layout, or the mean of its nearest sampled rows' places, weighted by their nearness."""
    spark, key = rows.sparkSession, layout.key
    places = spark.createDataFrame([(i, a, b) for i, (a, b) in layout.places.items()], f"{key} long, x double, y double")  # the sample's bound
    own = rows.select(F.col(key).cast("long").alias(key), layout.column)
    others = own.join(places, key, "left_anti")
    found = neighbours(others, layout.sample, layout.k, key, layout.column).join(places.withColumnRenamed(key, "neighbour"), "neighbour")
    w = F.lit(1.0) / (F.col("distance") + F.lit(1e-9))
    placed = found.groupBy(F.col("query").alias(key)).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))
    return places.join(own.select(key), key, "left_semi").unionByName(placed)


def kmeans(rows: DataFrame, k: int, column: str = "features", seed: int = 0) -> DataFrame:
    """Clusters in place of community detection, which Spark lacks."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, featuresCol=column, predictionCol="cluster", seed=seed).fit(rows).transform(rows)


def simulated(records: DataFrame, barcodes: DataFrame, copies: int, blur: float = 0.5, spread: float = 0.3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, barcodes) of so many noisy copies: with probability blur a count v becomes max(int(v (1 + normal * spread)), 1)."""
    from .clusters import uniform

    n = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    # All chance comes from the ids, so a task that runs again gives the same rows.
    draw = lambda i: uniform(seed + i, "ft_id", "bc_id", "copy")
    normal = F.sqrt(F.lit(-2.0) * F.log(draw(1))) * F.cos(F.lit(2 * math.pi) * draw(2))
    noisy = F.greatest((F.col("value") * (F.lit(1.0) + normal * spread)).cast("long"), F.lit(1))
    x = records.withColumn("copy", n).withColumn("value", F.when(draw(0) < blur, noisy).otherwise(F.col("value").cast("long")))
    bc = barcodes.withColumn("copy", n).withColumn("barcode", F.concat_ws("|", "barcode", F.col("copy").cast("string")))
    return x, bc
