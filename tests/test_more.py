"""Operators that SQL can't say, against plain versions; errors; HDF5 with a stand-in for its library."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import blocks, fuzzy, strings
from lattix.operators import clusters, embed, extras, layout
from lattix.sources import files, mex, store

from .test_matrix import m, rows  # noqa: F401


@pytest.mark.parametrize("seed", range(4))
def test_weighted_chunks_as_walked(spark, seed):
    rng = random.Random(seed)
    weights = [rng.choice([0, 1, 2, 5, 300 if seed % 2 else 9]) for _ in range(150)]
    ids = sorted(rng.sample(range(0, 500_000, 7), 150))
    df = spark.createDataFrame(list(zip(ids, weights)), "id long, w long")
    total, n = sum(weights), 7
    w, opened, upto, want = -(-total // n), 0, 0, []
    for i, x in zip(ids, weights):
        upto += x
        opened += w * (opened + 1) < upto
        want.append((i, x, opened))
    assert rows(layout.weighted_chunks(df, n, "id", "w"), "id", "w", "chunk") == want


def plain_communities(edges, rounds=20):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {a: a for a in near}
    for _ in range(rounds):
        new = {}
        for a, bs in near.items():
            votes = {label[a]: 1}
            for b in bs:
                votes[label[b]] = votes.get(label[b], 0) + 1
            new[a] = min(votes, key=lambda v: (-votes[v], v))
        if new == label:
            break
        label = new
    return label


def test_communities(spark):
    rng = random.Random(5)
    edges = [(a, rng.choice([b for b in range(60) if b // 12 == a // 12 and b != a])) for a in range(60) for _ in range(4)] + [(0, 13), (25, 40)]
    got = dict(rows(embed.communities(spark.createDataFrame(edges, "query long, neighbour long"))))
    assert got == plain_communities(edges) and len(set(got.values())) >= 4


def test_layout_keeps_groups_apart(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (3, 8))
    vectors = [(i, [float(x) for x in centres[i % 3] + rng.normal(0, 0.3, 8)]) for i in range(240)] + [(900, None)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    trained = embed.train_layout(df, "vec_id", "v", most=150, epochs=60)
    assert len(trained.places) == 150
    got = {r.vec_id: np.array([r.x, r.y]) for r in embed.apply_layout(trained, df).collect()}
    assert set(got) == set(range(240))
    mids = [np.mean([got[i] for i in range(240) if i % 3 == g], 0) for g in range(3)]
    assert sum(np.argmin([np.linalg.norm(got[i] - c) for c in mids]) == i % 3 for i in got) > 230
    again = embed.train_layout(df, "vec_id", "v", most=150, epochs=60)
    assert again.places == trained.places


def test_thinned(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.01 if i < 80 else 3.0, 4)], i % 2) for i in range(120)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>, label int")
    got = [r[0] for r in embed.thinned(df, 40, "vec_id", "v", iterations=3).collect()]
    assert len(got) == 40 and sum(i >= 80 for i in got) >= 36
    by = embed.thinned(df, 40, "vec_id", "v", labels=df).join(df.withColumnRenamed("vec_id", "query"), "query").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in by} == {0: 20, 1: 20}


def test_pca_as_by_decomposition(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 5)) @ np.diag([9, 4, 2, 1, 0.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").select("id", array_to_vector("v").alias("features"))
    got = np.array([r.X_pca for r in embed.apply_pca(embed.train_pca(df, 2), df).orderBy("id").collect()])
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(x @ axes.T), atol=1e-6)


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_fuzzy_hits_are_within_their_errors():
    rng = random.Random(6)
    query, found = "the answer is forty two", 0
    for _ in range(200):
        text = "".join(rng.choice("abcdef ") for _ in range(60))
        put = list(query)
        for _ in range(rng.choice([0, 1, 2, 5])):
            put[rng.randrange(len(put))] = rng.choice("xyz")
        at = rng.randrange(60)
        text = text[:at] + "".join(put) + text[at:]
        start, stop, matched, n = fuzzy.first_match(text, query, 0.1)
        best = min(edits(query, text[i:j]) for i in range(len(text) + 1) for j in range(max(i, i + len(query) - 2), min(len(text), i + len(query) + 2) + 1))
        assert (start >= 0) == (best <= 2)
        if start >= 0:
            found += 1
            assert text[start:stop] == matched and edits(query, matched) <= n <= 2
        hits = fuzzy.all_matches(text, query, 0.1)
        assert all(a[1] <= b[0] for a, b in zip(hits, hits[1:])) and bool(hits) == (best <= 2)
    assert found > 50


def test_recipe_on_plain_numbers(spark):
    from lattix.model import CountMatrix

    rng = np.random.default_rng(7)
    counts = rng.poisson(2, (40, 30))
    records = [(f, c, int(counts[c, f])) for c in range(40) for f in range(30) if counts[c, f]]
    bc = spark.createDataFrame([(i, f"b{i}") for i in range(40)], "bc_id long, barcode string")
    ft = spark.createDataFrame([(i, f"f{i}", ("MT-" if i < 3 else "G") + str(i), "x") for i in range(30)], "ft_id long, id_feature string, feature string, feature_type string")
    got = extras.recipe(CountMatrix(bc, ft, {"raw": spark.createDataFrame(records, "ft_id long, bc_id long, value long")}), min_genes=5, n_variable=10, components=3)
    want = {c: (int((counts[c] > 0).sum()), int(counts[c].sum()), 100 * counts[c, :3].sum() / counts[c].sum()) for c in range(40)}
    for r in got["quality"].collect():
        assert (r.n_genes, r.total) == want[r.bc_id][:2] and r.percent_marked == pytest.approx(want[r.bc_id][2])
    log = np.log1p(counts / counts.sum(1, keepdims=True) * 10_000)
    sd = log.std(0, ddof=1)
    layer = got["layer"].collect()
    assert len({r.ft_id for r in layer}) == 10 and all(r.value == pytest.approx(min(10, log[r.bc_id, r.ft_id] / sd[r.ft_id])) for r in layer)
    assert got["pca"].count() == 40


def test_samples(spark):
    df = spark.range(20_000).withColumnRenamed("id", "bc_id")
    n = clusters.sampled(df, "bc_id", 0.25).count()
    assert abs(n - 5000) < 250 and clusters.sampled(df, "bc_id", 1.0).count() == 20_000 and clusters.sampled(df.repartition(7), "bc_id", 0.25).count() == n
    u = [r[0] for r in df.select(clusters.uniform(3, "bc_id")).collect()]
    assert abs(np.mean(u) - 0.5) < 0.01 and 0 < min(u) and max(u) < 1


def test_errors(spark, tmp_path):
    with pytest.raises(Exception, match="more than 255 bytes"):
        spark.range(1).select(strings.escaped_path(F.repeat(F.lit("x"), 300))).collect()
    for f in (blocks.encoder, blocks.decoder):
        with pytest.raises(ValueError):
            f("none")
    with pytest.raises(FileNotFoundError):
        store.Store(spark, str(tmp_path / "none"))
    s = store.Store(spark, str(tmp_path / "one"), "w", (3, 3))
    with pytest.raises(KeyError):
        s.get_attr("none")
    assert s.records().count() == 0
    s.lock.acquire()
    other = store.Store(spark, s.path, "a")
    other.lock.fail = True
    with pytest.raises(TimeoutError):
        other.write(spark.createDataFrame([(0, 0, 1.0)], "ft_id long, bc_id long, value double"))
    s.lock.release()
    other.write(spark.createDataFrame([(0, 0, 1.0), (5, 5, 1.0)], "ft_id long, bc_id long, value double"))
    assert rows(s.at_points(spark.createDataFrame([(0, 0), (1, 1)], "ft_id long, bc_id long"))) == [(0, 0, 1.0), (1, 1, 0.0)]
    assert rows(s.orthogonal(barcodes=spark.createDataFrame([(0,)], "bc_id long"))) == [(0, 0, 1.0)]
    with pytest.raises(Exception):
        files.command(["false"])


STAND_IN = '''
import numpy as np, pickle

class Data:
    def __init__(self, a): self.a = a
    shape = property(lambda self: self.a.shape)
    def __getitem__(self, i): return self.a if i == () else self.a[i]
    def __setitem__(self, i, v): self.a[i] = v

class Group(dict):
    def __getitem__(self, k):
        x = self
        for part in k.split("/"): x = dict.__getitem__(x, part)
        return x
    def create_group(self, k):
        dict.__setitem__(self, k, Group()); return self[k]
    def create_dataset(self, k, shape=None, dtype=None, data=None):
        dict.__setitem__(self, k, Data(np.zeros(shape, dtype) if data is None else np.asarray(data))); return self[k]

class File(Group):
    def __init__(self, path, mode):
        self.path, self.mode = path, mode
        if mode == "r":
            with open(path, "rb") as f: self.update(pickle.load(f))
    def __enter__(self): return self
    def __exit__(self, *_):
        if self.mode == "w":
            with open(self.path, "wb") as f: pickle.dump(dict(self), f)
'''


def test_hdf5_round_trip(spark, tmp_path, m, monkeypatch):  # noqa: F811
    (tmp_path / "h5py.py").write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    sys.modules.pop("h5py", None)
    path = str(tmp_path / "x.h5")
    mex.write_hdf5(m, path, batch=4)
    back = mex.read_hdf5(spark, path, batch=2)
    assert rows(back.layers["raw"]) == [(a, b, float(v)) for a, b, v in rows(m.layers["raw"])]
    assert rows(back.barcodes) == rows(m.barcodes, "bc_id", "barcode") and rows(back.features) == rows(m.features)
    sys.modules.pop("h5py", None)
