"""Summaries by cluster, marker features, tests between groups and contingency counts.

Labels are (bc_id, label). Cell counts come from the labels, so entries without records count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_summary(records: DataFrame, labels: DataFrame, features: DataFrame) -> DataFrame:
    """(label, ft_id, avg_expr, prop_expr, score) of every cluster and feature.

    avg_expr divides the sum of all values by the number of positive ones; features without expression are 0 throughout.
    The grid of labels and features is that of the result itself: both are small against the records.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    v = F.col("value").cast("double")
    stats = records.join(labels, "bc_id").groupBy("label", "ft_id").agg(F.sum(v).alias("s"), F.count_if(v > 0).alias("k"))
    per_label = features.select("ft_id").join(F.broadcast(sizes))  # a row for each label, joined to every feature
    grid = per_label.join(stats, ["label", "ft_id"], "left")
    avg = F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(F.lit(0.0))
    prop = F.coalesce(F.col("k"), F.lit(0)) / F.col("n").cast("double")
    return grid.select("label", "ft_id", avg.alias("avg_expr"), prop.alias("prop_expr"), (avg * prop).alias("score"))


def unique_markers(summary: DataFrame, max_score: float = 1000.0) -> DataFrame:
    """(ft_id, label_1st, score_1st, avg_expr_1st, prop_expr_1st, label_2nd, score_2nd, avg_expr_2nd, prop_expr_2nd, max_avg_expr, max_prop_expr, score_ratio).

    The ratio is max_score where both scores are 0, infinite where only the second is; ties go to the smaller label; a
    second cluster that isn't there is null.
    """
    w = Window.partitionBy("ft_id").orderBy(F.desc("score"), "label")
    x = summary.withColumn("r", F.row_number().over(w))
    at = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}_{'1st' if r == 1 else '2nd'}")
    top = x.groupBy("ft_id").agg(*[at(c, r) for r in (1, 2) for c in ("label", "score", "avg_expr", "prop_expr")], F.max("avg_expr").alias("max_avg_expr"), F.max("prop_expr").alias("max_prop_expr"))
    a, b = F.col("score_1st"), F.col("score_2nd")
    ratio = F.when(b.isNull(), F.lit(None).cast("double")).when(b != 0, a / b).when(a == 0, F.lit(float(max_score))).otherwise(F.lit(float("inf")))
    return top.withColumn("score_ratio", ratio)


def batch_features(records: DataFrame, batches: DataFrame, features: DataFrame, clusters: DataFrame | None = None, min_prop: float = 0.15, min_ratio: float = 3.0) -> DataFrame:
    """(ft_id) of features that single out one batch: in all cells, or, with clusters (bc_id, cluster), within every cluster."""
    ok = (F.col("prop_expr_1st") > min_prop) & (F.col("score_ratio") > min_ratio)
    if clusters is None:
        return unique_markers(cluster_summary(records, batches, features)).where(ok).select("ft_id")
    # A batch within a cluster is a label of its own; ranks are taken within the cluster.
    both = batches.join(clusters, "bc_id").select("bc_id", F.struct("cluster", "label").alias("label"))
    s = cluster_summary(records, both, features).select(F.col("label.cluster").alias("cluster"), F.col("label.label").alias("label"), "ft_id", "prop_expr", "score")
    w = Window.partitionBy("cluster", "ft_id").orderBy(F.desc("score"), "label")
    top = s.withColumn("r", F.row_number().over(w)).groupBy("cluster", "ft_id").agg(*[F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}_{r}") for r in (1, 2) for c in ("score", "prop_expr")])
    ratio = F.when(F.col("score_2") != 0, F.col("score_1") / F.col("score_2")).when(F.col("score_1") == 0, F.lit(1000.0)).otherwise(F.lit(float("inf")))
    hit = top.where((F.col("prop_expr_1") > min_prop) & (F.when(F.col("score_2").isNotNull(), ratio) > min_ratio))
    n = clusters.select("cluster").distinct().agg(F.count("*").alias("n"))
    return hit.groupBy("ft_id").agg(F.count_distinct("cluster").alias("k")).join(F.broadcast(n)).where("k = n").select("ft_id")


def group_tests(records: DataFrame, labels: DataFrame, pseudo: float = 1e-9) -> DataFrame:
    """(ft_id, label, n1, n, auroc, z, t, log2fc) of each feature, cluster against the rest, without filling in zeros.

    auroc and the rank test's z count absent records as one block of ties at 0 (values must not be negative); t is Welch's
    with zeros included; log2fc is the logarithm of the means' ratio. Clusters without a stored record of a feature have no row.
    """
    sizes = labels.groupBy("label").agg(F.count("*").cast("double").alias("n1"))
    total = sizes.agg(F.sum("n1").alias("n"))
    v = F.col("value").cast("double")
    x = records.where(v > 0).join(labels, "bc_id").select("ft_id", "label", v.alias("v"))
    # Ranks of each distinct value among a feature's stored records: equal values are counted first, so a window holds
    # a row a value.
    per = x.groupBy("ft_id", "v").agg(F.count("*").cast("double").alias("c"))
    w = Window.partitionBy("ft_id").orderBy("v")
    rank = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("c") - 1) / F.lit(2.0)
    ranks = per.select("ft_id", "v", rank.alias("r"), F.col("c"))
    by_ft = ranks.groupBy("ft_id").agg(F.sum("c").alias("kk"), F.sum(F.pow("c", F.lit(3.0)) - F.col("c")).alias("ties"), F.sum(F.col("v") * F.col("c")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("c")).alias("q"))
    cl = x.groupBy("ft_id", "label", "v").agg(F.count("*").cast("double").alias("c1")).join(ranks, ["ft_id", "v"])
    cl = cl.groupBy("ft_id", "label").agg(F.sum("c1").alias("k1"), F.sum(F.col("r") * F.col("c1")).alias("rk"), F.sum(F.col("v") * F.col("c1")).alias("s1"), F.sum(F.col("v") * F.col("v") * F.col("c1")).alias("q1"))
    y = cl.join(by_ft, "ft_id").join(F.broadcast(sizes), "label").join(F.broadcast(total))
    c = F.col
    n2 = c("n") - c("n1")
    zeros = c("n") - c("kk")
    r1 = c("rk") + c("k1") * zeros + (c("n1") - c("k1")) * (zeros + 1) / F.lit(2.0)
    u = r1 - c("n1") * (c("n1") + 1) / F.lit(2.0)
    auroc = F.when((c("n1") > 0) & (n2 > 0), u / (c("n1") * n2))
    spread = c("n1") * n2 / F.lit(12.0) * ((c("n") + 1) - (c("ties") + F.pow(zeros, F.lit(3.0)) - zeros) / (c("n") * (c("n") - 1)))
    z = F.when(spread > 0, (u - c("n1") * n2 / F.lit(2.0)) / F.sqrt(spread))
    m1, m2 = c("s1") / c("n1"), F.when(n2 > 0, (c("s") - c("s1")) / n2)
    v1 = F.when(c("n1") > 1, (c("q1") - c("n1") * m1 * m1) / (c("n1") - 1))
    v2 = F.when(n2 > 1, ((c("q") - c("q1")) - n2 * m2 * m2) / (n2 - 1))
    e = v1 / c("n1") + v2 / n2
    t = F.when(e > 0, (m1 - m2) / F.sqrt(e))
    fold = F.log2((m1 + F.lit(pseudo)) / (m2 + F.lit(pseudo)))
    return y.select("ft_id", "label", "n1", "n", auroc.alias("auroc"), z.alias("z"), t.alias("t"), fold.alias("log2fc"))


def p_value(z):
    """Two-sided p of a normal deviate, by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = k * (F.lit(0.254829592) + k * (F.lit(-0.284496736) + k * (F.lit(1.421413741) + k * (F.lit(-1.453152027) + k * F.lit(1.061405429)))))
    return poly * F.exp(-x * x)


def marker_table(tests: DataFrame, min_auroc: float = 0.5, min_log2fc: float = 0.0, max_p: float = 1.0, top: int | None = None) -> DataFrame:
    """Rows that pass; with top, the best so many of each cluster by auroc, ties to the smaller feature."""
    ok = tests.withColumn("p", p_value(F.col("z"))).where((F.col("auroc") >= min_auroc) & (F.col("log2fc") >= min_log2fc) & (F.col("p") <= max_p))
    if top is None:
        return ok
    w = Window.partitionBy("label").orderBy(F.desc("auroc"), "ft_id")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def contingency(pairs: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def value_counts(df: DataFrame, column: str, least: int = 2, ignore_float: bool = True) -> DataFrame:
    """Counts of values, null ones left out; a floating column has none unless asked for."""
    if ignore_float and dict(df.dtypes)[column] in ("float", "double"):
        df = df.limit(0)
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def keys_of_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """All keys that hold the greatest value."""
    top = df.agg(F.max(value).alias("_max"))
    return df.join(F.broadcast(top)).where(F.col(value) == F.col("_max")).select(key, value)


def unpacked_ranking(rankings: DataFrame) -> DataFrame:
    """A long table of rows (name_clus, names, scores, logfoldchanges, pvals, pvals_adj as arrays), index_clus their order."""
    cols = ["names", "scores", "logfoldchanges", "pvals", "pvals_adj"]
    x = rankings.select("name_clus", F.posexplode(F.arrays_zip(*cols)).alias("index_in_clus", "r"))
    return x.select("name_clus", "index_in_clus", *[F.col(f"r.{c}").alias(c) for c in cols])


def drawn(seed: int, *keys: str) -> Column:
    """Eight hex digits that the keys alone decide, evenly spread: the same wherever and however often a row is computed."""
    return F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 8)


def uniform(seed: int, *keys: str) -> Column:
    """Such a number strictly between 0 and 1."""
    return (F.conv(drawn(seed, *keys), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def subsampled(labels: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """A stratified sample of about `total` rows: each cluster gives the rows of smallest hash, in its share of all rows and one at least."""
    n = labels.agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy(drawn(seed, "bc_id"), "bc_id")
    k = F.count("*").over(Window.partitionBy("label"))
    x = labels.withColumns({"_r": F.row_number().over(w), "_k": k}).join(F.broadcast(n))
    return x.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("_k") / F.col("n")))).select("bc_id", "label")


def sampled(axis: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """A reproducible random mask: the digest of the id decides."""
    return axis.where(drawn(seed, key) < F.lit(f"{min((1 << 32) - 1, int(fraction * (1 << 32))):08x}") if fraction < 1 else F.lit(True))
