"""Totals of each axis, moments of four transforms, normal layers and feature variability.

Records are (ft_id, bc_id, value); an absent record is 0. N, the number of barcodes, is that of the axis, never of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

TARGET = 10_000
TRANSFORMS = ("raw", "log", "norm", "lognorm")


def log10p(x: Column) -> Column:
    return F.log10(x + F.lit(1.0))


def barcode_totals(records: DataFrame) -> DataFrame:
    """(bc_id, total, n_features) of every barcode with a record."""
    return records.groupBy("bc_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_features"))


def feature_totals(records: DataFrame) -> DataFrame:
    """(ft_id, total, n_cells, log_total) of every feature with a record."""
    return records.groupBy("ft_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_cells"), F.sum(log10p(F.col("value").cast("double"))).alias("log_total"))


def axis_totals(records: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """Total and number of records of every entry of the axis; 0 where it has none."""
    sums = records.groupBy(key).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return axis.select(key).join(sums, key, "left").select(key, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def feature_set_totals(records: DataFrame, sets: DataFrame) -> DataFrame:
    """(bc_id, set_name, total) from sets (set_name, ft_id); barcodes without a record in a set have no row."""
    return records.join(sets, "ft_id").groupBy("bc_id", "set_name").agg(F.sum("value").alias("total"))


def normalized(records: DataFrame, target: float = TARGET) -> DataFrame:
    """value / barcode total * target. Barcodes whose total is 0 have no normal value and are left out.

    One shuffle: a window over the barcode keeps records and their total together.
    """
    total = F.sum(F.col("value").cast("double")).over(Window.partitionBy("bc_id"))
    return records.withColumn("_total", total).where("_total <> 0").withColumn("value", F.col("value") / F.col("_total") * F.lit(float(target))).drop("_total")


def logged(records: DataFrame) -> DataFrame:
    return records.withColumn("value", log10p(F.col("value").cast("double")))


def capped(records: DataFrame, most: float) -> DataFrame:
    return records.withColumn("value", F.least(F.col("value").cast("double"), F.lit(float(most))))


def scaled(records: DataFrame, n_barcodes: int, most: float | None = None) -> DataFrame:
    """Values divided by the feature's standard deviation (zeros counted), capped; features without spread are 0. Not centred, so absent records stay absent."""
    x = F.col("value").cast("double")
    m = records.groupBy("ft_id").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / n_barcodes) / (n_barcodes - 1))
    out = records.join(m, "ft_id").withColumn("value", F.when(sd > 0, x / sd).otherwise(F.lit(0.0))).drop("s", "q")
    return capped(out, most) if most is not None else out


def moments(records: DataFrame, n: int, target: float = TARGET, include_zeros: bool = False) -> DataFrame:
    """(ft_id, n_cells, mean_<t>, var_<t>) for the transforms t raw, log, norm and lognorm.

    n is the denominator: the number of barcodes, or of features for parity with older results. Deviations are those of
    stored records, unless include_zeros. One window by barcode and one aggregate by feature serve all four transforms.
    """
    v = F.col("value").cast("double")
    total = F.sum(v).over(Window.partitionBy("bc_id"))
    norm = F.when(F.col("_total") != 0, v / F.col("_total") * F.lit(float(target)))
    x = records.withColumn("_total", total).select("ft_id", v.alias("raw"), log10p(v).alias("log"), norm.alias("norm"), log10p(norm).alias("lognorm"))
    sums = x.groupBy("ft_id").agg(F.count("*").alias("n_cells"), *[e for t in TRANSFORMS for e in (F.sum(t).alias(f"s_{t}"), F.sum(F.col(t) * F.col(t)).alias(f"q_{t}"), F.count(t).alias(f"k_{t}"))])
    out = ["ft_id", F.col("n_cells")]
    for t in TRANSFORMS:
        mean = F.col(f"s_{t}") / n
        seen = F.lit(n) if include_zeros else F.col(f"k_{t}")
        out += [mean.alias(f"mean_{t}"), ((F.col(f"q_{t}") - F.lit(2.0) * mean * F.col(f"s_{t}") + seen * mean * mean) / max(1, n - 1)).alias(f"var_{t}")]
    return sums.select(*out)


def kept(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read again, so that what follows can use it more than once."""
    path = f"{scratch(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit(moments_: DataFrame, t: str) -> DataFrame:
    """One row (lo, hi, b0, b1, b2): the least squares parabola of var_t over mean_t, means mapped to [-1, 1]."""
    ends = moments_.agg(F.min(f"mean_{t}").alias("lo"), F.max(f"mean_{t}").alias("hi"))
    u = F.when(F.col("hi") > F.col("lo"), (F.lit(2.0) * F.col(f"mean_{t}") - F.col("lo") - F.col("hi")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    x = moments_.select(F.col(f"mean_{t}"), F.col(f"var_{t}").alias("v")).join(F.broadcast(ends)).withColumn("u", u)  # one row
    power = lambda k: F.pow("u", F.lit(float(k))) if k else F.lit(1.0)
    s = x.agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), *[F.sum(power(k)).alias(f"s{k}") for k in range(5)], *[F.sum(F.col("v") * power(k)).alias(f"r{k}") for k in range(3)])
    det = lambda a, b, c: f"({a[0]}*({b[1]}*{c[2]}-{c[1]}*{b[2]}) - {b[0]}*({a[1]}*{c[2]}-{c[1]}*{a[2]}) + {c[0]}*({a[1]}*{b[2]}-{b[1]}*{a[2]}))"
    cols = [("s0", "s1", "s2"), ("s1", "s2", "s3"), ("s2", "s3", "s4")]
    r = ("r0", "r1", "r2")
    whole = det(*cols)
    betas = [det(*[r if i == k else cols[i] for i in range(3)]) for k in range(3)]
    # Fewer than three distinct means leave the system singular: the mean variance is then expected everywhere.
    return s.select("lo", "hi", *[F.expr(f"CASE WHEN abs({whole}) > 1e-12 THEN {b} / {whole} ELSE {'r0 / s0' if k == 0 else '0D'} END").alias(f"b{k}") for k, b in enumerate(betas)])


def variability(moments_: DataFrame) -> DataFrame:
    """(ft_id, score_lognorm, score_log, score): ratio times difference of variance and expected variance for both log transforms; their product, 0 if either is negative."""
    x = own = kept(moments_)  # a row a feature, read five times
    for t in ("lognorm", "log"):
        f = fit(own, t)
        u = F.when(F.col("hi") > F.col("lo"), (F.lit(2.0) * F.col(f"mean_{t}") - F.col("lo") - F.col("hi")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
        e = F.col("b0") + F.col("b1") * u + F.col("b2") * u * u
        ratio = F.when(e != 0, F.col(f"var_{t}") / e).otherwise(F.lit(1.0))
        diff = F.when(e != 0, F.col(f"var_{t}") - e).otherwise(F.lit(0.0))
        x = x.join(F.broadcast(f)).withColumn(f"score_{t}", ratio * diff).drop("lo", "hi", "b0", "b1", "b2")
    both = F.when((F.col("score_lognorm") < 0) | (F.col("score_log") < 0), F.lit(0.0)).otherwise(F.col("score_lognorm") * F.col("score_log"))
    return x.withColumn("score", both)


def most_variable(moments_: DataFrame, n: int, min_mean: float = 0.01, min_var: float = 0.01) -> DataFrame:
    """The n features of highest score with at least so much mean and variance of the log-normal layer; ties to the smaller id."""
    ok = variability(moments_).where((F.col("mean_lognorm") >= min_mean) & (F.col("var_lognorm") >= min_var))
    return ok.orderBy(F.desc("score"), "ft_id").limit(n)
