import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lattix.llm import sharding


def least_capacity(sizes, k):
    fits = lambda c: _greedy(sizes, c) <= k
    low, high = max([*sizes, -(-sum(sizes) // k)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def _greedy(sizes, c):
    n, room = 1, c
    for s in sizes:
        if s > room:
            n, room = n + 1, c
        room -= s
    return n


def check(spark, rows, k=16):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit("x"), "shard": F.lit(1)})
    got = sharding.shard(df, k).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()
    groups = {}
    for _, t in rows:
        groups[key(t or "")] = groups.get(key(t or ""), 0) + len((t or "").encode()) + 1
    load, slots = {}, {}
    for r in got:
        t = next(t for t in texts[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32)
        assert (r.size, r.law, r.grown_shard) == (len(t.encode()) + 1, "bytes", None) and 0 <= r.shard < k
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    place = {}
    for r in got:
        place.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in place.values())
    if rows:
        assert max(load.values()) == least_capacity([groups[g] for g in sorted(groups)], k)


def test_least_capacity(spark):
    rng = random.Random(1)
    check(spark, [(i, "é" * rng.randrange(60) + str(rng.randrange(900))) for i in range(3000)])


def test_hot_group_and_edges(spark):
    check(spark, [(i, "the same text" if i % 3 else str(i)) for i in range(300)])
    check(spark, [(1, None), (1, None), (2, ""), (None, "a"), (3, "x" * 20000)])
    check(spark, [])


def test_ranges_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 1)
    rng = random.Random(2)
    check(spark, [(i, str(i) * rng.randrange(9)) for i in range(800)], 5)
