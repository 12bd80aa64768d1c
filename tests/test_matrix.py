"""The golden micro-matrix: four features, five barcodes of which the last is empty."""

import pytest
from pyspark.sql import functions as F

from lattix.model import CountMatrix
from lattix.operators import clusters, filtering, identity, layout, summary

RECORDS = [(1, 1, 3), (2, 1, 1), (1, 2, 5), (3, 2, 2), (4, 2, 1), (2, 3, 4), (3, 3, 4), (1, 4, 1), (4, 4, 9)]


@pytest.fixture(scope="module")
def m(spark):
    bc = spark.createDataFrame([(i, f"b{i}", "x" if i < 3 else "y") for i in range(5)], "bc_id long, barcode string, label string")
    ft = spark.createDataFrame([(i, f"f{i}", f"F{i}", "Gene Expression") for i in range(4)], "ft_id long, id_feature string, feature string, feature_type string")
    records = spark.createDataFrame([(f - 1, b - 1, v) for f, b, v in RECORDS], "ft_id long, bc_id long, value long")
    return CountMatrix(bc, ft, {"raw": records})


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_totals(m):
    assert rows(summary.barcode_totals(m.layers["raw"])) == [(0, 4, 2), (1, 8, 3), (2, 8, 2), (3, 10, 2)]
    assert rows(summary.axis_totals(m.layers["raw"], m.barcodes, "bc_id"))[4] == (4, 0, 0)
    got = {r.ft_id: r for r in summary.feature_totals(m.layers["raw"]).collect()}
    want = {0: (9, 3, 1.681241), 1: (5, 2, 1.0), 2: (6, 2, 1.176091), 3: (10, 2, 1.301030)}
    for f, (total, n, log) in want.items():
        assert (got[f].total, got[f].n_cells) == (total, n) and got[f].log_total == pytest.approx(log, abs=1e-6)


MOMENTS = {
    5: {0: (1.8, 3.08, 0.336248, 0.066794, 2950, 8848750, 2.134301, 1.635428), 1: (1.0, 2.25, 0.2, 0.064795, 1500, 3312500, 1.419434, 2.277963), 2: (1.2, 2.12, 0.235218, 0.068396, 1500, 3312500, 1.419434, 2.277963), 3: (2.0, 12.5, 0.260206, 0.13724, 2050, 12235625, 1.41031, 2.329408)},
    4: {0: (2.25, 3.229167, 0.42031, 0.058437, 3687.5, 9441406.25, 2.667876, 0.946861), 3: (2.5, 14.833333, 0.325257, 0.151955, 2562.5, 14388020.833333, 1.762887, 2.194265)},
}


@pytest.mark.parametrize("n", [5, 4])
def test_moments(m, n):
    got = {r.ft_id: r for r in summary.moments(m.layers["raw"], n).collect()}
    for f, want in MOMENTS[n].items():
        have = [got[f][f"{k}_{t}"] for t in summary.TRANSFORMS for k in ("mean", "var")]
        assert have == pytest.approx(list(want), rel=2e-5)


def test_fit(m):
    mo = summary.moments(m.layers["raw"], 5)
    f = summary.fit(mo, "log").first()
    u = lambda x: (2 * x - f.lo - f.hi) / (f.hi - f.lo)
    means = [MOMENTS[5][i][2] for i in range(4)]
    assert [f.b0 + f.b1 * u(x) + f.b2 * u(x) ** 2 for x in means] == pytest.approx([0.069409, 0.055317, 0.09919, 0.113308], abs=2e-5)
    score = {r.ft_id: r.score_log for r in summary.variability(mo).collect()}
    assert [score[i] for i in range(4)] == pytest.approx([-0.00251706, 0.01110066, -0.02123383, 0.02898756], abs=2e-5)


def test_filters(m):
    x = m.layers["raw"]
    a = filtering.filtered(x, renumber=True, min_counts=8)
    assert a.count() == 7 and {r.bc_id for r in a.collect()} == {0, 1, 2} and {r.ft_id for r in a.collect()} == {0, 1, 2, 3}
    b = filtering.filtered(x, min_features=3)
    assert b.count() == 3 and {r.bc_id for r in b.collect()} == {1}
    assert len(rows(filtering.surviving(x, min_features=3)[1])) == 4
    c = filtering.filtered(x, min_cells=3)
    assert c.count() == 3 and {r.ft_id for r in c.collect()} == {0}
    assert rows(filtering.surviving(x, min_cells=3)[0]) == [(0,), (1,), (2,), (3,)]


def test_indexes(m):
    x = m.layers["raw"]
    assert rows(layout.sparse_index(x, m.barcodes, "bc_id")) == [(0, 0, 2), (1, 2, 5), (2, 5, 7), (3, 7, 9), (4, 0, 0)]
    assert [r[1] for r in rows(layout.indptr(x, m.barcodes, "bc_id"))] == [0, 2, 5, 7, 9, 9]
    assert rows(layout.sparse_index(x, m.features, "ft_id")) == [(0, 0, 3), (1, 3, 5), (2, 5, 7), (3, 7, 9)]
    assert [r[0] for r in sorted(layout.expanded(layout.indptr(x, m.barcodes, "bc_id")).collect(), key=lambda r: r.position)] == [0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert rows(layout.from_text(layout.as_text(x), "long")) == rows(x)
    assert rows(layout.dense(x, 4))[0] == (0, [3.0, 1.0, 0.0, 0.0])


def test_selection(m):
    records, bc, ft = m["raw", ["b0", "b1"], :, F.col("ft_id") < 2, ["feature"]]
    assert rows(records) == [(0, 0, 3), (0, 1, 5), (1, 0, 1)] and bc.count() == 2 and ft.columns == ["ft_id", "id_feature", "feature"]
    assert rows(m.expression(["f0", "f3"])) == [(0, 3), (1, 6), (2, 0), (3, 10), (4, 0)]
    saved = m.bc.filtered(F.col("label") == "x").save_filter("mine", {"why": "test"})
    assert saved.change_filter("mine").count() == 3 and m.bc.count() == 5 and saved.all().count() == 5
    assert m.bc.set_categories("label", {"x": "z"}).table.where("label = 'z'").count() == 3


def test_layers(m):
    s = m.summarized("raw", "barcode").bc.meta("raw_sum", "raw_num_nonzero_values")
    assert rows(s)[3:] == [(3, 10, 2), (4, 0, 0)]
    n = m.applied("raw", "double", lambda v: v * 2).layers["double"]
    assert n.agg(F.sum("value")).first()[0] == 60
    assert m.prepared(min_counts=1, n_variable=3).layers["normalized_log1p_capped"].count() > 0


def test_masks(spark, m):
    axis = spark.createDataFrame(list(enumerate([False, True, True, False, True])), "bc_id long, mask boolean")
    assert rows(filtering.segments(axis, "bc_id")) == [(1, 3), (4, 5)]
    by = axis.withColumn("g", F.lit(1))
    assert rows(filtering.segments(by, "bc_id", by=["g"]), "start", "stop") == [(1, 3), (4, 5)]
    assert rows(filtering.positions(axis, "bc_id")) == [(1,), (2,), (4,)]
    assert rows(filtering.renumbered(axis.where("mask"), "bc_id")) == [(1, 0), (2, 1), (4, 2)]


def test_thresholds_and_counts(spark):
    x = spark.createDataFrame([(1, 1), (2, 1), (2, 5)], "v int, w int")
    assert rows(x.where(filtering.thresholds(va=1, wb=5))) == [(2, 1)]
    assert rows(x.where(filtering.thresholds(False, va=1, wb=5))) == [(1, 1), (2, 1), (2, 5)]
    r = spark.createDataFrame([(0.4,), (0.5,), (1.5,), (2.5,)], "value double")
    assert [v.value for v in layout.whole_counts(r).collect()] == [1, 1, 2, 2]
    t = spark.createDataFrame([(float(i),) for i in range(100)], "total double")
    assert filtering.raised_threshold(t, 10, 30, 1000).first()[0] == 80
    assert filtering.raised_threshold(t, 10, 0, 1000, stop=40).first()[0] == 40


def test_chunks(spark):
    x = spark.createDataFrame([(i, w) for i, w in enumerate([1, 1, 9, 1, 1, 1])], "i long, w long")

    def plain(weights, n):
        w, c, opened, out = -(-sum(weights) // n), 0, 0, []
        for v in weights:
            c += v
            opened += w * (opened + 1) < c
            out.append(opened)
        return out

    for n in (2, 3, 5):
        assert [r[2] for r in rows(layout.weighted_chunks(x, n, "i", "w"))] == plain([1, 1, 9, 1, 1, 1], n)
    even = x.withColumn("w", F.lit(2).cast("long"))
    assert [r[2] for r in rows(layout.weighted_chunks(even, 3, "i", "w"))] == plain([2] * 6, 3)
    assert [r[2] for r in rows(layout.strided(x.select("i"), 2, "i"))] == [0, 1, 0, 1, 0, 1]


def test_markers(spark, m):
    labels = m.barcodes.select("bc_id", "label")
    s = clusters.cluster_summary(m.layers["raw"], labels, m.features)
    got = {(r.label, r.ft_id): (r.avg_expr, r.prop_expr) for r in s.collect()}
    assert got["x", 0] == (4.0, pytest.approx(2 / 3)) and got["y", 1] == (0.0, 0.0) and len(got) == 8
    top = {r.ft_id: r for r in clusters.unique_markers(s).collect()}
    assert top[3].label_1st == "y" and top[1].score_ratio == float("inf")
    a = {(r.ft_id, r.label): r.auroc for r in clusters.group_tests(m.layers["raw"], labels).collect()}
    assert a[0, "x"] == pytest.approx((2 + 2 + 0.5 + 0) / 6, abs=0.2) and a[0, "x"] + a[0, "y"] == pytest.approx(1)
    one = clusters.unique_markers(s.where("label = 'x'")).first()
    assert one.label_2nd is None and one.score_ratio is None


def test_identity(spark):
    ids = ["sampA-AACCGGTTAACCGGTT-1", "sampA-aaccggttAACCGGTTA-1", "AACCGGTTAACCGGTT", "x-ACGTACGT-1", "ACGTACGTACGTACG-CCCCGGGGTTTTAAAA"]
    got = [tuple(r)[1:] for r in identity.parsed(spark.createDataFrame([(i,) for i in ids], "id_cell string")).collect()]
    assert got == [("AACCGGTTAACCGGTT", "sampA-|-1"), ("aaccggttAACCGGTTA", "sampA-|-1"), ("AACCGGTTAACCGGTT", "|"), (None, None), ("CCCCGGGGTTTTAAAA", "ACGTACGTACGTACG-|")]
