import random

import pytest

from lattix.llm import common, ngram_join

from . import brute


def check(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.similar(df, **k).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute.similar(rows, **k), key=key)


def edited(rng, words, share):
    return [w if rng.random() > share else rng.choice("abcdefghij") + str(rng.randrange(99)) for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_comparing_all_pairs(spark, seed):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    passage = "one passage that many of these documents have in common word for word to the end".split()
    rows = []
    for i in range(160):
        words = edited(rng, rng.choice(bases), rng.choice([0, 0, 0.01, 0.02, 0.05]))
        if rng.random() < 0.4:
            words = passage + words
        rows.append((i, " ".join(words)))
    check(spark, rows)


def test_blocks_and_stars(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(common, "ONE_TASK_LINKS", 0)
    rng = random.Random(3)
    base = [str(rng.randrange(999)) for _ in range(60)]
    check(spark, [(i, " ".join(edited(rng, base, 0.02))) for i in range(120)])


def test_blocks_of_unlike_rows(spark, monkeypatch):
    """Groups of several blocks that share a passage but aren't alike, of many sizes; crowded numbers from the first level on."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 6)
    monkeypatch.setattr(ngram_join, "CROWDED", 1)
    rng = random.Random(4)
    passage = [str(rng.randrange(999)) for _ in range(30)]
    rows = [(i, " ".join(passage + [str(rng.randrange(9999)) for _ in range(rng.randrange(2, 14))])) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(0, 90, 3)] + [(200 + i, rows[i][1]) for i in range(0, 90, 7)]
    check(spark, rows)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "low", "n_shingles", "component_id", "set_id", "number", "block")})
    assert sorted(tuple(r) for r in ngram_join.similar(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]


def test_tables_are_gone(spark):
    import glob

    before = set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/lattix-*"))
    df = spark.createDataFrame([(i, f"a b c d e f {i % 5}") for i in range(50)], "doc_id long, text string")
    with common.scope():
        ngram_join.similar(df).collect()
    assert set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/lattix-*")) == before
    with pytest.raises(Exception), common.scope():
        common.written(df)
        common.written(df.select(failing()))
    assert set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/lattix-*")) == before


def failing():
    from pyspark.sql import functions as F

    return F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("x")


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Two words"), (5, "two  WORDS"), (6, "É bé"), (7, "é bé"), (None, "two words"), (8, "one"), (8, "two words"), (9, "a b c d e " * 5000)]
    check(spark, rows)
    check(spark, [])
