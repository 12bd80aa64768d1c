import pytest
from pyspark.sql import functions as F

from lattix.functions import codecs, fuzzy, strings
from lattix.operators import filtering

S = strings
CASES = [
    (lambda x: S.all_positions(x, "aa", False), "aaaa", [0, 2]),
    (lambda x: S.all_positions(x, "aa"), "aaaa", [0, 1, 2]),
    (lambda x: S.all_positions(x, "aa"), "a", []),
    (lambda x: S.last_position(x, "aa"), "aaaa", 2),
    (lambda x: S.last_position(x, "b"), "aaaa", -1),
    (lambda x: S.insert_every(x, 3, "-"), "abcdefg", "abc-def-g"),
    (lambda x: S.insert_every(x, 3, "$1\\"), "abcd", "abc$1\\d"),
    (lambda x: S.replace_every(x, 3, "_"), "abcdefg", "ab_de_g"),
    (lambda x: S.replace_every(x, 3, "_"), "abcdef", "ab_de"),
    (S.path_safe, "a/b c;d", "a_b_c_d"),
    (S.window_path_safe, "a/b c;d", "a_b c;d"),
    (S.python_safe, "50%+x", "50_Percent__Plus_x"),
    (S.escaped_path, "a/b", "a((47))b"),
    (lambda x: F.transform(S.stretches(x, "A", 2), lambda s: F.array(s.start, s.stop, s.n)), "AABAAAC", [[0, 2, 2], [3, 6, 3]]),
    (lambda x: S.stretches(x, "A"), "", []),
    (lambda x: F.transform(S.fields(x), lambda s: F.array(s.start, s.stop)), "--- -- -", [[0, 3], [4, 6], [7, 8]]),
    (lambda x: S.replace_at(x, 1, "X"), "abc", "aXc"),
]


def test_cases(spark):
    df = spark.createDataFrame([tuple(t for _, t, _ in CASES)], [f"c{i}" for i in range(len(CASES))])
    got = df.select(*[f(F.col(f"c{i}")).alias(f"c{i}") for i, (f, _, _) in enumerate(CASES)]).first()
    for i, (_, text, want) in enumerate(CASES):
        assert got[i] == want, (i, text)


def test_long_name_is_an_error(spark):
    with pytest.raises(Exception, match="255 bytes"):
        spark.createDataFrame([("x" * 300,)], "a string").select(S.escaped_path(F.col("a"))).collect()


def test_multiple_queries(spark):
    df = spark.createDataFrame([("xAB",), ("abzz",), ("c",)], "s string")
    assert [r.s for r in df.where(filtering.matches(F.col("s"), "ab", "-zz")).collect()] == ["xAB"]


def test_fuzzy(spark):
    assert fuzzy.first_match("xxACGTACGTACxx", "ACGTACGTAC") == (2, 12, "ACGTACGTAC", 0)
    assert fuzzy.first_match("xxACGTTCGTACxx", "ACGTACGTAC", 0.1)[3] == 1
    assert fuzzy.first_match("nothing", "ACGTACGTAC") == (-1, -1, None, -1)
    assert fuzzy.first_match("abcabc", "abc", start=-3) == (3, 6, "abc", 0)
    assert [m[:2] for m in fuzzy.all_matches("ACGTACGTAC..ACGTTCGTAC", "ACGTACGTAC", 0.1)] == [(0, 10), (12, 22)]
    got = spark.createDataFrame([("xabcx",), (None,)], "s string").select(fuzzy.search("abc")(F.col("s")).alias("h"), fuzzy.search_all("abc")(F.col("s")).alias("a")).collect()
    assert got[0].h.start == 1 and got[1].h.start == -1 and got[0].a[0].stop == 4


def test_codecs(spark):
    x = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary")
    got = [r[0] for r in x.select(codecs.gunzipped(codecs.gzipped(F.col("b")))).collect()]
    assert bytes(got[0]) == b"abc" and got[1] is None
