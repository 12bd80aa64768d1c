"""What the findings of round 2 asked for: rows far wider than their records, and files, groups and searches of size."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import fuzzy
from lattix.model import CountMatrix
from lattix.operators import extras, identity, layout
from lattix.sources import mex, tables


def test_dense_rows_wider_than_their_records(spark):
    x = spark.createDataFrame([(0, 7, 1.0), (0, 7, 2.0), (16, 7, 3.0), (34, 7, 4.0), (99, 8, 5.0), (-1, 8, 5.0)], "ft_id long, bc_id long, value double")
    got = {r.bc_id: r for r in layout.dense_blocks(x, 35).collect()}
    assert {k: r.n_values for k, r in got.items()} == {7: 35, 8: 35} and got[8].blocks == []
    assert [(b.start, len(b["values"])) for b in got[7].blocks] == [(0, 16), (16, 16), (32, 3)]
    want = [0.0] * 35
    want[0], want[16], want[34] = 3.0, 3.0, 4.0
    assert sum((b["values"] for b in got[7].blocks), []) == want
    assert {r.bc_id: r["values"] for r in layout.dense(x, 35).collect()} == {7: want, 8: [0.0] * 35}
    assert [r["values"] for r in layout.dense(x, 0).collect()] == [[], []]


def test_dense_rows_take_time_by_records(spark):
    wide = 300_000
    x = spark.range(40 * 500).select((F.col("id") % 500 * 600).alias("ft_id"), F.floor(F.col("id") / 500).alias("bc_id"), F.lit(1.0).alias("value"))
    began = time.time()
    got = layout.dense(x, wide).select("bc_id", F.size("values").alias("n"), F.element_at("values", 601).alias("v")).collect()
    assert sorted(map(tuple, got)) == [(i, wide, 1.0) for i in range(40)]
    assert time.time() - began < 40  # entries times records: minutes


@pytest.mark.parametrize("matrix", [tables.orders_by_parts, tables.suppliers_by_parts])
def test_more_items_make_more_tasks(spark, monkeypatch, matrix):
    monkeypatch.setattr(tables, "PART", 1 << 12)
    x = matrix(spark, "/root/testdata/sf0.001").layers["raw"]
    assert x.rdd.getNumPartitions() > 8  # not what a session's settings and compressed bytes make of it
    assert x.count() == x.select("ft_id", "bc_id").distinct().count()


def test_recipe_without_variable_features(spark):
    ft = spark.createDataFrame([(i, f"f{i}", f"G{i}", "x") for i in range(4)], "ft_id long, id_feature string, feature string, feature_type string")
    bc = spark.createDataFrame([(i, f"b{i}") for i in range(5)], "bc_id long, barcode string")
    flat = spark.createDataFrame([(f, c, 1.0) for f in range(4) for c in range(5)], "ft_id long, bc_id long, value double")
    got = extras.recipe(CountMatrix(bc, ft, {"raw": flat}), min_genes=2, min_cells=2, components=3)
    assert sorted((r.bc_id, r.X_pca) for r in got["pca"].collect()) == [(i, []) for i in range(5)] and got["layer"].count() == 0
    # One feature varies, and half of the cells don't have it.
    some = spark.createDataFrame([(f, c, 1.0) for f in range(2) for c in range(40)] + [(2, c, 50.0 * (1 + c)) for c in range(20)], "ft_id long, bc_id long, value double")
    got = extras.recipe(CountMatrix(bc, ft, {"raw": some}), min_genes=2, min_cells=2, n_variable=1, components=3)
    assert got["pca"].count() == 40 and {len(r.X_pca) for r in got["pca"].collect()} == {1}


@pytest.mark.parametrize("whole", [True, False])
def test_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch, whole):
    import gzip

    monkeypatch.setattr(mex, "LINES", 50)
    n = 700
    records = spark.range(n).select((F.col("id") * 7 % 50).alias("ft_id"), F.floor(F.col("id") / 50).alias("bc_id"), (F.col("id") + (0 if whole else 0.5)).alias("value"))
    bc = spark.range(14).select(F.col("id").alias("bc_id"), F.concat(F.lit("b,"), "id").alias("barcode"))
    ft = spark.range(120).select(F.col("id").alias("ft_id"), F.concat(F.lit("f"), "id").alias("id_feature"), F.concat(F.lit("n "), "id").alias("feature"))
    m = CountMatrix(bc, ft, {"raw": records})
    want = sorted(map(tuple, records.collect()))
    mex.write(m, str(tmp_path / "m"))
    mex.write_split_seq(m, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.name[0] != ".") == ["barcodes.tsv.gz", "features.tsv.gz", "matrix.mtx.gz"]
    lines = gzip.open(tmp_path / "m/matrix.mtx.gz", "rt").read().split("\n")
    assert lines[:3] == [f"%%MatrixMarket matrix coordinate {'integer' if whole else 'real'} general", "%", f"120 14 {n}"] and lines[-1] == ""
    at = [tuple(map(int, x.split()[1::-1])) for x in lines[3:-1]]
    assert len(at) == n and at == sorted(at)
    assert (tmp_path / "m/matrix.mtx.gz").read_bytes().count(b"\x1f\x8b\x08") > 8  # a member a task: no task has all lines
    for x in (mex.read(spark, str(tmp_path / "m")), mex.read_split_seq(spark, str(tmp_path / "s"))):
        assert sorted(map(tuple, x.layers["raw"].collect())) == want
        assert sorted(map(tuple, x.barcodes.collect())) == [(i, f"b,{i}") for i in range(14)]
        assert [tuple(r)[:2] for r in x.features.orderBy("ft_id").collect()] == [(i, f"f{i}") for i in range(120)]


def test_functions_of_entries(spark):
    x = spark.range(60_000).select((F.col("id") % 20_000).alias("ft_id"), F.floor(F.col("id") / 20_000).alias("bc_id"), (F.col("id") % 7).cast("double").alias("value"))
    m = CountMatrix(spark.range(3).select(F.col("id").alias("bc_id")), spark.range(20_001).select(F.col("id").alias("ft_id")), {"raw": x})

    def func(entry, others, values):
        values[:] = np.sort(values)  # its own copy
        return {"n": len(others), "mid": values[len(values) // 2], "all": sorted(others.tolist()), "none": float("nan")}

    got = m.summarized_by("raw", "feature", func, "n int, mid double, all array<long>, none double").ft.table
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # a frame an entry takes most of the time
    rows = {r.ft_id: r for r in got.collect()}
    assert len(rows) == 20_001 and rows[20_000].raw_n is None
    for i in (0, 1, 9_999, 19_999):
        assert rows[i].raw_n == 3 and rows[i].raw_all == [0, 1, 2] and rows[i].raw_none is None
        assert rows[i].raw_mid == sorted((i + 20_000 * j) % 7 for j in range(3))[1]
    # Entries longer than a batch, and ones of which nothing stays.
    out = m.applied("raw", "top", by="barcode", entry=lambda entry, others, values: ([], []) if entry == 1 else (others[values > 5], values[values > 5] / len(values)))
    got = sorted(map(tuple, out.layers["top"].collect()))
    assert got == sorted((i % 20_000, i // 20_000, 6 / 20_000) for i in range(60_000) if i % 7 == 6 and i // 20_000 != 1)


def test_barcodes_are_sought_once(spark):
    """What is joined reads barcodes that were found before, and the pattern is in none of its steps."""
    cells = spark.createDataFrame([(f"s{i % 2}-{'ACGT' * 4}{'ACGT'[i % 4]}{'ACGT'[i // 4]}-1",) for i in range(8)] + [("none",)], "id_cell string")
    meta = cells.withColumn("n", F.length("id_cell")).where("id_cell <> 'none'")
    got = identity.with_metadata(cells, meta)
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id_cell: r.n for r in got.collect()} == {r.id_cell: (len(r.id_cell) if r.id_cell != "none" else None) for r in cells.collect()}


def test_fuzzy_search_looks_where_a_piece_is():
    import random

    import regex

    rng, query = random.Random(3), "the and attion to"
    for _ in range(300):
        text = "".join(rng.choice(["the ", "and", " att", "ion", " to", "x", "e"]) for _ in range(rng.randint(0, 40)))
        want = (-1, -1, None, -1) if query not in text else (text.find(query), text.find(query) + len(query), query, 0)
        for e in (1, 2):
            m = regex.search(f"(?:{query}){{e<={e}}}", text)
            if want[0] < 0 and m:
                want = (m.start(), m.end(), m[0], sum(m.fuzzy_counts))
        assert fuzzy.first_match(text, query, 0.15) == want
    long = "Ein Satz ohne das Gesuchte, von Haus zu Haus. " * 400_000
    began = time.time()
    assert fuzzy.first_match(long, query, 0.15)[0] == -1 and fuzzy.all_matches(long, query, 0.15) == []
    assert time.time() - began < 3  # edits counted at every place: tens of seconds


def test_split_files_are_moved_by_their_tasks(spark, tmp_path, monkeypatch):
    """The driver isn't left to move files one after another."""
    from pyspark.sql import DataFrameWriter

    path, said, option = str(tmp_path / "split"), {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: (said.update({k: v}), option(self, k, v))[1])
    extras.split_records(spark.range(2_000, numPartitions=2), path, 10)
    assert said["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
    names = sorted(p.name for p in (tmp_path / "split").iterdir() if not p.name.startswith("."))
    assert names[0] == "_SUCCESS" and len(names) == 201 and spark.read.parquet(path).count() == 2_000
