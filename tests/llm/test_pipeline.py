import random

import corpus_pipeline as cp


def test_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0 and i < 300
        docs.append([i, text() + (" blockhead" if toxic else ""), "en", f"src{i % 3}", 0])
        if i < 200:
            labels.append((i, 1, int(toxic)))
    item = text(30)
    docs[301][1] += ". " + item
    docs[302][1] = docs[303][1]
    docs[304][1] = docs[306][1] + " end"
    docs[307][1] += " password = hunter2hunter2"
    docs += [[500, None, None, None, None], [501, "", "en", "src0", 0], [None, text(), "en", "src0", 0]]
    d = str(tmp_path)
    spark.createDataFrame([tuple(x) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    seen, df = {}, spark.read.parquet(f"{d}/documents.parquet")
    columns = df.columns
    for name, stage in cp.STAGES:
        out = str(tmp_path / name)
        stage(spark, df, d).write.parquet(out)
        df = spark.read.parquet(out)
        seen[name] = df
        assert df.columns == columns or name == "packing"
    ids = lambda name: sorted(r.doc_id if r.doc_id is not None else -1 for r in seen[name].select("doc_id").distinct().collect())
    clean = sorted([-1, 500, 501] + [i for i in range(400) if not (i % 5 == 0 and i < 300)])
    assert ids("toxicity") == clean
    assert ids("near_duplicates") == [i for i in clean if i not in (303, 306)]
    assert ids("decontamination") == ids("secrets") == ids("packing") == [i for i in clean if i not in (301, 303, 306)]
    assert "[assign]" in seen["secrets"].where("doc_id = 307").first().text
    assert cp.run(spark, d).count() == seen["packing"].count()


NAMES = ("predicted", "score", "held_out", "kept", "node", "component_id", "n_shingles", "low", "row", "n", "item_id", "windows", "matched", "hash", "values", "_gone", "_contaminated", "base", "spans", "piece", "size", "shard", "bin", "cluster")


def tables(spark, d, rows, extra=()):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("kept as it is") for c in extra}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some more words than eight in all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_clashing_columns_and_long_texts(spark, tmp_path):
    long = "some long text " * 40000
    rows = [(1, "plain words here", "en", "s", 0), (2, "other words", "en", "s", 0), (3, long, "en", "s", 0), (4, long + "end", "en", "t", 0), (5, None, None, None, None)]
    tables(spark, tmp_path, rows, NAMES)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns
            assert all(r[c] == "kept as it is" for r in out.select(*[f"`{c}`" for c in NAMES]).collect() for c in NAMES)
        assert out.count()
    assert cp.run(spark, str(tmp_path)).count()


def test_empty_tables_and_what_a_failure_leaves(spark, tmp_path, monkeypatch):
    import glob

    import pytest
    from lattix.llm import common

    folder = common.shared_dir(spark).removeprefix("file://")
    tables(spark, tmp_path, [])
    before = set(glob.glob(f"{folder}/lattix-*"))
    with common.scope():
        assert cp.run(spark, str(tmp_path)).count() == 0
    assert set(glob.glob(f"{folder}/lattix-*")) == before

    def failing(spark, docs, sf_dir):
        common.written(docs)
        raise RuntimeError("stop")

    monkeypatch.setattr(cp, "STAGES", [cp.STAGES[0], ("failing", failing)])
    with pytest.raises(RuntimeError), common.scope():
        cp.run(spark, str(tmp_path))
    assert set(glob.glob(f"{folder}/lattix-*")) == before
