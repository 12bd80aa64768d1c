import gzip
import os

from pyspark.sql import functions as F

from lattix import model
from lattix.sources import mex
from lattix.streaming import running

from .test_matrix import RECORDS, m, rows  # noqa: F401


def folder(path, kind="integer", records=RECORDS):
    os.makedirs(path, exist_ok=True)
    put = lambda name, text: gzip.open(f"{path}/{name}", "wt").write(text)
    put("matrix.mtx.gz", f"%%MatrixMarket matrix coordinate {kind} general\n%\n4 5 {len(records)}\n" + "".join(f"{a} {b} {v}\n" for a, b, v in records))
    put("barcodes.tsv.gz", "".join(f"b{i}\n" for i in range(5)))
    put("features.tsv.gz", "".join(f"f{i}\tF{i}\tGene Expression\n" for i in range(4)))
    return str(path)


def test_read(spark, tmp_path):
    p = folder(tmp_path / "a")
    x = mex.read(spark, p)
    assert rows(x.layers["raw"]) == sorted((a - 1, b - 1, v) for a, b, v in RECORDS)
    assert mex.shape(spark, p) == (4, 5, 9) and x.barcodes.count() == 5 and rows(x.features)[1] == (1, "f1", "F1", "Gene Expression")
    assert mex.shape(spark, str(tmp_path / "none")) is None
    assert mex.long_table(x).where("barcode is null").count() == 0
    real = mex.read(spark, folder(tmp_path / "r", "real", [(1, 1, "2.7")]))
    assert rows(real.layers["raw"]) == [(0, 0, 2.7)]
    cut = mex.read(spark, folder(tmp_path / "i", "integer", [(1, 1, "2.7")]))
    assert rows(cut.layers["raw"]) == [(0, 0, 2)]


def test_round_trip(spark, tmp_path, m):  # noqa: F811
    out = str(tmp_path / "out")
    mex.write(m, out)
    back = mex.read(spark, out)
    assert rows(back.layers["raw"]) == rows(m.layers["raw"]) and mex.shape(spark, out) == (4, 5, 9)
    assert mex.kind(spark, f"{out}/matrix.mtx.gz") == "integer"
    again = mex.from_long_table(mex.long_table(m).withColumn("feature", F.col("id_feature")))
    assert again.layers["raw"].agg(F.sum("value")).first()[0] == 30 and again.barcodes.count() == 4


def test_split_seq(spark, tmp_path):
    d = tmp_path
    (d / "cell_metadata.csv").write_text("cell_barcode,x\nb0,1\nb1,2\n")
    (d / "genes.csv").write_text(",gene_id,gene_name,genome\n0,f0,F0,h\n1,f1,F1,h\n2,f2,F2,h\n")
    (d / "DGE.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 2\n1 3 7\n2 1 5\n")
    x = mex.read_split_seq(spark, str(d))
    assert rows(x.layers["raw"]) == [(0, 1, 5), (2, 0, 7)] and rows(x.features)[2] == (2, "f2", "F2", "h")


def test_dataset_and_overlay(spark, tmp_path, m):  # noqa: F811
    base, mine = str(tmp_path / "base"), str(tmp_path / "mine")
    m.write(base, ("bc_id", "ft_id"))
    m.layers["raw"].where("bc_id = 3").withColumn("value", F.lit(100).cast("long")).write.parquet(f"{mine}/layers/raw/bc_id")
    x = model.opened(spark, base, ["raw"], over=mine)
    assert rows(x.layers["raw"].where("bc_id = 3"), "value") == [(100,), (100,)] and x.layers["raw"].count() == 9
    c = model.Catalog(spark, str(tmp_path / "catalog"))
    c.update("one", m)
    assert c.load("one", ["raw"]).layers["raw"].count() == 9
    c.delete("one")
    assert not mex.exists(spark, str(tmp_path / "catalog/one"))


def test_glob_and_printed(spark, tmp_path):
    for n in ("a_1.txt", "b_2.txt"):
        (tmp_path / n).write_text("x")
    got = mex.globbed(spark, f"{tmp_path}/*_*.txt")
    assert rows(got, "wildcard_0", "wildcard_1", "size_in_bytes") == [("a", "1", 1), ("b", "2", 1)]
    t = mex.printed_table(spark, "name   size\nab c   12\nd      3\n")
    assert t.columns == ["name", "size"] and rows(t)[0] == ("ab c", "12")


def test_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    df = spark.createDataFrame([(f"2024-01-01 0{i % 3}:10:00", "a", float(i)) for i in range(9)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(src)
    stream = running.windowed_totals(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("totals"), "n", "total") == rows(running.windowed_totals(df), "n", "total")


def test_extras(spark, tmp_path):
    from lattix.operators import extras

    kv = extras.KeyValues(spark, str(tmp_path / "kv"))
    kv["a"] = {"x": 1}
    kv["b"] = 2
    del kv["b"]
    assert kv["a"] == {"x": 1} and kv["b"] is None and kv["c"] is None and kv.keys() == {"a"}
    over = extras.KeyValues(spark, str(tmp_path / "kv"), str(tmp_path / "mine"))
    over["a"] = 5
    assert over["a"] == 5 and kv["a"] == {"x": 1}
    assert extras.is_mask([True, False, True]) and not extras.is_mask([0, 1]) and not extras.is_mask([0, 1, 2])
    assert rows(extras.as_mask(spark, [0, 1])) == [(0, False), (1, True)]
    extras.split_records(spark.range(25), str(tmp_path / "split"), 10)
    assert spark.read.parquet(str(tmp_path / "split")).count() == 25
    assert extras.as_json(spark.range(1)).first().json == '{"id":0}'
