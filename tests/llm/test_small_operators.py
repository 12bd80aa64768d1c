"""Each operator against a plain version, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.llm import bestfit_packing, chat_format, decontaminate, secret_scan, token_counts, topk_search, toxicity


def frame(spark, rows, schema="doc_id long, text string"):
    clash = {"size": F.lit("x"), "spans": F.lit(1), "bin": F.lit(2), "number": F.lit(3)}
    return spark.createDataFrame(rows, schema).withColumns(clash)


EDGES = [(1, None), (2, ""), (3, " \n"), (None, "some text"), (4, "twice"), (4, "twice"), (5, "word " * 30000)]

# Secrets


def base_spans(text):
    out = []
    for i, (pattern, flags, least) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8), ("AKIA[A-Z0-9]+", 0, 16), ("[0-9a-f]+", 0, 32)]):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[2] if i == 0 else m[0]) >= least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def secrets(rng):
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([20, 31, 32, 40])))
    b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48))
    return rng.choice([f"password = {hexes}", f'API_KEY:"{b64}"', "AKIA" + b64.upper()[:rng.randrange(5, 20)].replace("+", "A").replace("/", "B"), hexes, "tokens: abc", "secret=short", f"é{hexes}ü", "Secret=12345678", b64])


def test_secret_scan(spark):
    rng = random.Random(1)
    prose = ["plain words here", "überlänge", "internationalizationalistically", "snake_case_name_of_a_function"]
    rows = EDGES + [(10 + i, " ".join(rng.choice([rng.choice(prose), secrets(rng)]) for _ in range(6))) for i in range(150)]
    got = secret_scan.scan(frame(spark, rows)).collect()
    texts = sorted((d is None, d or 0, tuple(base_spans(t))) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(map(tuple, r.base))) for r in got) == texts
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)
    by_id = dict(rows)
    found = [by_id[r.doc_id][s.start : s.end] for r in got for s in r.spans if s.kind == 3]
    assert found and not any(f in prose for f in found)
    assert secret_scan.scan(frame(spark, [])).count() == 0


def test_secret_after_equals_sign(spark):
    rng = random.Random(11)
    value = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(i, f"plain {name}={value}{pad} words") for i, (name, pad) in enumerate([("AWS_SECRET_ACCESS_KEY", ""), ("private_key", "=="), ("http://x.example.org/?sig", ""), ("pwd", ""), ("a=b", "&c=d")])]
    got = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.spans if s.kind == 3] for r in secret_scan.scan(frame(spark, rows)).collect()}
    assert got == {i: [value + ("==" if i == 1 else "")] for i in range(len(rows))}
    assert all(value not in r.text for r in secret_scan.redacted(frame(spark, rows)).collect())


def test_random_letters_of_one_case():
    rng = random.Random(12)
    words = "internationalization counterrevolutionary disproportionately notwithstanding responsibilities understanding electroencephalogram representative heretofore information commissioners".split()
    for change in (str.lower, str.upper):
        drawn = [secret_scan.battery(change("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(128)))) for _ in range(100)]
        natural = [secret_scan.battery(change("".join(rng.choice(words) for _ in range(10))[:128])) for _ in range(100)]
        assert sum(p < 1e-3 for p in drawn) > 95 and min(natural) > 1e-3
        assert all(secret_scan.battery(change(w)) > 0.01 for w in words if len(w) >= secret_scan.SHORTEST)


ALPHABETS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "letters": "abcdefghijklmnopqrstuvwxyz", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
WORDS = "internationalization of the responsibilities shall be considered by every commissioner whose understanding is not yet perfect while notwithstanding all those disproportionately large figures from the counterrevolutionary movement there will be some more information about that question".split()


def planted(rng, n):
    """Rows of prose with natural long strings, and random strings of every encoding and length with their places."""
    rows, places = [], {}
    glued = lambda: rng.choice(["_", "-", "/", ""]).join(rng.choice(WORDS) for _ in range(6)) + rng.choice(["", "-2024-05-12", "_v2", "20240512T102233"])
    for i in range(n):
        name = rng.choice(sorted(ALPHABETS))
        value = "q" + "".join(rng.choice(ALPHABETS[name]) for _ in range(rng.choice([24, 32, 40, 64, 128]))) + "q" if name == "letters" else "".join(rng.choice(ALPHABETS[name]) for _ in range(rng.choice([24, 32, 40, 64, 128])))
        before = " ".join([*(rng.choice(WORDS) for _ in range(20)), *(glued() for _ in range(3)), "é ü"]) + " "
        rows.append((i, before + value + " " + " ".join(rng.choice(WORDS) for _ in range(10))))
        places[i] = (name, len(value), len(before), len(before) + len(value))
    return rows, places


def test_recall_and_false_discoveries(spark):
    rows, places = planted(random.Random(21), 400)
    got = {r.doc_id: [tuple(x) for x in r.spans if x.kind == 3] for r in secret_scan.scan(frame(spark, rows)).collect()}
    hit = {i: any(a < places[i][3] and b > places[i][2] for a, _, b in got[i]) for i in places}
    for name in ALPHABETS:
        own = [hit[i] for i in places if places[i][0] == name]
        assert sum(own) >= 0.9 * len(own), name
    wrong = sum(b <= places[i][2] or a >= places[i][3] for i in places for a, _, b in got[i])
    assert wrong <= 0.02 * sum(map(len, got.values()))


def test_binned_rule_is_the_plain_one(spark):
    """The bins report no piece that Benjamini and Hochberg's rule on the p values themselves doesn't, and lose few."""
    rows, _ = planted(random.Random(22), 200)
    raws = [t.encode() for _, t in rows]
    natural = secret_scan.natural_model(secret_scan.natural_pairs(raws))
    tested = []
    for i, raw in enumerate(raws):
        text = raw.decode()
        tested += [(i, a, b, c, secret_scan.battery(text[a:b], natural)) for a, b, c, _ in secret_scan.scan_text(raw, natural)[1]]
    plain = set()
    for c in range(len(secret_scan.CLASSES)):
        own = sorted((t for t in tested if t[3] == c), key=lambda t: t[4])
        last = max((n for n, t in enumerate(own, 1) if t[4] <= 0.01 * n / len(own)), default=0)
        plain |= {t[:3] for t in own[:last]}
    got = {(r.doc_id, x.start, x.end) for r in secret_scan.scan(frame(spark, rows)).collect() for x in r.spans if x.kind == 3}
    assert got <= plain and len(got) >= 0.97 * len(plain)


def test_pieces_beside_base_spans_and_odd_bytes(spark):
    rng = random.Random(23)
    value = "".join(rng.choice(ALPHABETS["base64"][:62]) for _ in range(40))
    text = f"é AKIA{'A' * 16}/{value} tail"
    natural = secret_scan.natural_model()
    spans, tested = secret_scan.scan_text(text.encode(), natural)
    assert spans == [(2, 1, 22)] and [text[a:b] for a, b, _, _ in tested] == [f"/{value}"]
    broken = b"\xff\xfe " + value.encode() + b" \xc3"
    about = secret_scan.Learnt(natural, [1] * 4)
    assert secret_scan.reported(broken, about)[1] == [(3, 3, 43)]
    assert secret_scan.redact_text(broken, about) == "\ufffd\ufffd [random] \ufffd".encode()
    df = spark.createDataFrame([(1, bytearray(broken))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    assert secret_scan.scan(df).count() == 1 and secret_scan.redacted(df).count() == 1


def test_long_texts_are_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        raw = ("überlänge " + "x" * 25 + " ") * n
        began = time.process_time()
        secret_scan.scan_text(raw.encode()[: 36 * n])
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_redacted_keeps_rows(spark):
    rows = [(1, "x password=abcdefgh12 y"), (2, None), (3, "clean")]
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in secret_scan.redacted(df).collect()}
    assert got[1].text == "x [assign] y" and got[1].n_chars == 12 and got[2].text is None and got[3].text == "clean"


# Benchmark decontamination


def test_decontaminate(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{i}x".replace(str(i), "abcdefghij"[i % 10] * (1 + i // 10)) for i in range(60)]
    item = "A farmer called Alice has 12 apples and walks 3 km to sell 4 of them in Paris before Alice buys 2 pears"
    other = "A farmer called Bob has 90 apples and walks 7 miles to sell 5 of them in Rome before Bob buys 6 pears"
    broken = "A farmer called Bob has 90 apples and walks 7 miles to sell 5 of them in Rome before Tom buys 6 pears"
    clean = lambda: " ".join(rng.choice(words) for _ in range(80))
    rows = [(1, clean() + ". " + item + ". " + clean()), (2, clean() + ". " + other), (3, clean()), (4, None), (5, ""), (None, item), (6, item), (6, item), (7, "A farmer called Alice has 12 apples")]
    bench = [(1, item), (2, None), (3, "too short"), (None, item), (4, "")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, rows), frame(spark, bench, "item_id long, text string")).collect()}
    assert {k[0] for k in got if k[1] == 1} == {1, 2, 6}
    assert got[2, 1].reparameterised and not got[1, 1].reparameterised
    assert decontaminate.consistent([("a", 0, ["0:2:alice", "1:2:alice"], ["0:2:bob", "1:2:tom"])])[0] == -1
    # Two values may not become one, and what contradicts counts against.
    assert decontaminate.consistent([("a", 0, ["0:2:alice"], ["0:2:carl"]), ("b", 0, ["0:2:bob"], ["0:2:carl"])])[0] == 0
    assert decontaminate.consistent([("a", 0, ["0:1:12"], ["0:1:90"]), ("b", 0, ["0:1:12"], ["0:1:90"]), ("c", 0, ["0:1:12"], ["0:1:91"])]) == (1, True)
    # Two versions in one document are told apart by place.
    assert decontaminate.consistent([(w, shift, ["0:1:12"], [f"0:1:{v}"]) for w in "abc" for shift, v in ((0, 90), (40, 91))]) == (3, True)
    assert broken != other
    kept = decontaminate.without_benchmark(frame(spark, rows), frame(spark, bench, "item_id long, text string"))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 7]
    assert decontaminate.contaminated(frame(spark, []), frame(spark, [], "item_id long, text string")).count() == 0


def plain_windows(text, width):
    """(template words, [(place, kind, value)]) at each place, of texts of lower-case words, numbers and names in mid-sentence."""
    words = text.split()
    kinds = [1 if w.isdigit() else 2 if w[0].isupper() else 0 for w in words]
    template = [w if k == 0 else f"<{k}>" for w, k in zip(words, kinds)]
    wide = min(width, len(words))
    return [(at, tuple(template[at : at + wide]), [(kinds[j], words[j].lower()) for j in range(at, at + wide) if kinds[j]]) for at in range(len(words) - wide + 1)]


def plain_contaminated(docs, bench, width=8, share=0.5):
    out = set()
    for item, text in bench:
        theirs = plain_windows(text, width)
        ids = {(t, tuple(s)) for _, t, s in theirs}
        for doc, body in docs:
            matches = []
            for at, t, values in plain_windows(body, len(theirs[0][1])):
                matches += [((t, tuple(s)), at - place, s, values) for place, u, s in theirs if u == t]
            groups = []
            for shift in sorted({m[1] for m in matches}):
                near = [m for m in matches if m[1] == shift]
                groups.append(near)
                chain, last = [], None
                for other in sorted({m[1] for m in matches}):
                    if last is not None and other - last > 3:
                        chain = []
                    chain, last = chain + [other], other
                    if shift in chain:
                        groups.append([m for m in matches if m[1] in chain])
            best = 0
            for g in groups:
                votes = {}
                for _, _, a, b in g:
                    for (k, x), (_, y) in zip(a, b):
                        votes[k, x, y] = votes.get((k, x, y), 0) + 1
                meant, taken = {}, set()
                for k, x, y in sorted(votes, key=lambda v: (-votes[v], v[1] != v[2], (str(v[0]), v[1], v[2]))):
                    if (k, x) not in meant and (k, y) not in taken:
                        meant[k, x] = y
                        taken.add((k, y))
                good = {w for w, _, a, b in g if all(meant.get((k, x)) == y for (k, x), (_, y) in zip(a, b))}
                best = max(best, 2 * len(good) - len({w for w, *_ in g}))
            if best >= share * len(ids):
                out.add((doc, item))
    return out


@pytest.mark.parametrize("common", [64, 1])
def test_decontaminate_same_as_comparing_all(spark, monkeypatch, common):
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(31)
    word = lambda: rng.choice("farm river apple basket market wagon bridge winter table garden sells walks brings counts".split())
    name, number = lambda: rng.choice(["Alva", "Boris", "Cleo", "Dimas", "Enid"]), lambda: str(rng.randrange(2, 9))
    one = lambda: rng.choice([word, word, word, name, number])()
    stem = [word() for _ in range(9)]
    bench = [(i, " ".join([word(), *[one() for _ in range(rng.randrange(8, 20))]] + (stem if i % 3 == 0 else []))) for i in range(30)]
    docs = []
    for i in range(120):
        words = rng.choice(bench)[1].split()
        if i % 2:
            names = dict(zip(["Alva", "Boris", "Cleo", "Dimas", "Enid"], rng.sample(["Alva", "Boris", "Cleo", "Dimas", "Enid"], 5)))
            words = [names.get(w, str(int(w) + 1) if w.isdigit() else w) for w in words]
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(1, len(words))] = one()
        docs.append((i, " ".join(["intro", *[word() for _ in range(rng.randrange(6))], *words, *[one() for _ in range(5)]] * rng.choice([1, 1, 2]))))
    df, items = frame(spark, docs), frame(spark, bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items).collect()}
    want = plain_contaminated(docs, bench)
    assert got == want and len(want) > 40


def test_decontaminate_names_that_begin_sentences(spark):
    text = "{} has 3 apples. {} has 5 pears. {} has 2 plums. How many fruits do they have in all?"
    item = text.format("Alice", "Bob", "Carol")
    plain = "Boxes stand in the hall near a wide door. Nobody knows why the old men came here. Chairs are not in the room at all."
    rows = [(1, text.format("Dora", "Emil", "Fred")), (2, "so they read " + text.format("Dora", "Emil", "Fred")), (3, item), (4, item.lower()), (5, plain.lower()), (6, text.format("Dora", "Dora", "Dora").replace("fruits", "men"))]
    bench = spark.createDataFrame([(1, item), (2, plain)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert {1, 2, 3, 4} <= {d for d, i in got if i == 1} and (5, 2) in got and len({d for d, i in got if i == 2}) == 1
    assert all(r.matched == r.windows == 13 for (d, i), r in got.items() if d in (1, 3)) and got[1, 1].reparameterised and not got[3, 1].reparameterised


# Token counts


def test_token_counts(spark):
    rng = random.Random(3)
    letters = "ab 'sltde\n\t .,é1 2   "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 9, 400, 6000])), [(rng.randrange(-2, 500), rng.choice([0, 1, 60]), text(rng.choice([0, 3, 20]))) for _ in range(5)]) for i in range(60)]
    rows += [(None, None, None), (7, "twice", []), (7, "twice", [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:int,removed:int,inserted:string>>").withColumn("n_tokens", F.lit("x"))
    got = sorted(tuple(-1 if x is None else x for x in r) for r in token_counts.counts(df).select("doc_id", "n_tokens", "n_tokens_after").collect())
    count = token_counts.Counter(token_counts.VOCABULARY).encode
    want = []
    for d, t, edits in rows:
        before = t = t or ""
        for at, removed, inserted in edits or ():
            at = min(max(at, 0), len(t))
            t = t[:at] + inserted + t[at + removed :]
        want.append((-1 if d is None else d, len(count(before)), len(count(t))))
    assert got == sorted(want)


def test_kept_trees_take_edits_without_a_recount(spark, monkeypatch):
    rng = random.Random(33)
    rows = [(i, " ".join(rng.choice(["some", "words", "x" * 300, "éé", "1234", "\n\n"]) for _ in range(400))) for i in range(40)] + [(900, None), (901, "")]
    trees = token_counts.written(token_counts.kept(frame(spark, rows)))
    edits = spark.createDataFrame([(i, [(50 * i, 7, " put in")]) for i in range(0, 40, 5)] + [(900, [(0, 0, "new")])], "doc_id long, edits array<struct<at:int,removed:int,inserted:string>>")
    got = {r.doc_id: r for r in token_counts.edited(trees.join(edits, "doc_id")).collect()}
    count = token_counts.Counter(token_counts.VOCABULARY)
    assert set(got) == {*range(0, 40, 5), 900}
    texts = dict(rows)
    for i, r in got.items():
        at, removed, put = (0, 0, "new") if i == 900 else (50 * i, 7, " put in")
        t = texts[i] or ""
        want = t[:at] + put + t[at + removed :]
        whole = token_counts.Document(want, count)
        assert r.text == want and r.n_tokens == len(count.encode(want)) == whole.count and r.n_tokens_before == len(count.encode(t))
        assert np.array_equal(token_counts.read_leaves(bytes(r.leaves)), whole.leaves()) and r.n_pretokens == whole.pre_tokens() and r.n_reencoded < 12
    again = {r.doc_id: r.n_tokens for r in token_counts.edited(spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "leaves")) for r in got.values()], "doc_id long, text string, leaves binary").join(edits, "doc_id")).collect()}
    assert set(again) == set(got)
    assert token_counts.counts(frame(spark, [])).count() == 0


def test_edits_at_random_as_recounted():
    rng = random.Random(34)
    counter = token_counts.Counter(token_counts.VOCABULARY)
    letters = "ab 'sltde\n\t .,é1 2   "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(60):
        d = token_counts.Document(text(rng.choice([0, 3, 300, 3000])), counter)
        for _ in range(12):
            d.edit(rng.randrange(-2, 3200), rng.choice([0, 1, 40, 2000]), text(rng.choice([0, 2, 50])))
            whole = token_counts.Document(d.text, counter)
            assert d.count == whole.count == len(counter.encode(d.text)) and np.array_equal(d.leaves(), whole.leaves()) and d.pre_tokens() == whole.pre_tokens()
            assert np.array_equal(token_counts.read_leaves(token_counts.leaf_bytes(d.leaves())), whole.leaves())


def test_long_edits_rebuild():
    counter = token_counts.Counter(token_counts.VOCABULARY)
    d = token_counts.Document("a b c " * 3000, counter)
    for i in range(40):
        d.edit(17 * i, 3, " new words here" * 60)
    assert d.count == len(counter.encode(d.text)) and d.encoded < 60 * 4 * 40 + 400


# Exact top-k search


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 0.05)])
def test_top_k(spark, monkeypatch, seed, scale):
    monkeypatch.setattr(topk_search, "BUCKET", 32)
    monkeypatch.setattr(topk_search, "BAND", 48)
    monkeypatch.setattr(topk_search, "QUERIES", 8)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, 8))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 4] + rng.normal(0, scale, 8)) * rng.choice([0.2, 1, 3])]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]
    bad = [(900, None), (920, [1.0, None] * 4), (940, [float("nan")] * 8), (960, [float("inf")] + [0.0] * 7), (None, rows[1][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in topk_search.top_k(df, k=5, every=10).collect())
    x = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    want = []
    for q in (i for i in x if i % 10 == 0):
        best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk_search.top_k(df([])).count() == 0
    assert [tuple(r) for r in topk_search.top_k(df([(0, [0.0, 0.0]), (1, [1.0, -1.0]), (2, [1.0])])).collect()] == [(0, 1, 1, 0)]


# Best-fit packing


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 99, 100, 101, 350]), rng.choice(["hot", "hot", None, "a", "b", "c"])) for i in range(400)] + [(1, None, None)]
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = bestfit_packing.pack(df, capacity=100).collect()
    sizes = {}
    for d, t, _ in rows:
        sizes.setdefault(d, []).append(len((t or "").split()))
    placed, bins = {}, {}
    for r in got:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.size
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert placed == {d: sum(s) for d, s in sizes.items()}
    source, text = {d: s for d, _, s in rows}, {d: t or "" for d, t, _ in rows}
    for b in bins.values():
        assert sum(r.size for r in b) <= 100
        whole = [r for r in b if r.doc_id != 1]
        assert len({source[r.doc_id] for r in whole}) == len(whole) and len({text[r.doc_id] for r in whole}) == len(whole)
    assert bestfit_packing.pack(frame(spark, [], "doc_id long, text string, source string")).count() == 0


def test_best_fit_is_tightest():
    rng = random.Random(5)
    rows = sorted(((rng.randrange(1, 60), rng.choice("abcd"), rng.randrange(40)) for _ in range(300)), reverse=True)
    bins, want = [], []
    for size, source, cluster in rows:
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= size and source not in b["s"] and cluster not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": 100, "s": set(), "c": set()})
        bins[i]["room"] -= size
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
        want.append(i)
    assert [b for *_, b in bestfit_packing.packed(rows, 100)] == want


# Chat formatting


def test_chat_round_trip(spark):
    nasty = ["<|end|>", "\\", "\\<|turn|>", "<\\|says|>", "<|image:0|>", "\\### Assistant: </turn> ok", "", None, "a\n\nb", "<", "|>"]
    rows = [(i % 7, i, r, t) for i, (t, r) in enumerate((t, r) for t in nasty for r in ("user", "assistant", "<|end|>", None))]
    rows += [(None, None, "user", "x"), (3, 5, "user", "tie"), (3, 5, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", chat_format.escape(r[3] or "") + chat_format.END))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.formatted(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "look: ", None, None, None), ("image", None, "a.png", 600, 500), ("text", " <|image:9|>", None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,width:int,height:int>>")
    r = chat_format.formatted(df).first()
    assert chat_format.parse(r.formatted) == [("assistant", [("text", "look: "), ("image", "1"), ("text", " <|image:9|>")])]
    a = r.attachments[0]
    assert (a.kind, a.ref, a.tokens, r.formatted[a.at :][:11]) == ("image", "a.png", 2 * chat_format.TILE_TOKENS, "<|image:1|>")
    assert [chat_format.unescape(r.formatted[s.start : s.end]) for s in r.loss] == ["look: ", " <|image:9|>"]


def test_chat_texts_split_anywhere():
    """Texts cut into parts at random, some with attachments between, give back what went in."""
    rng = random.Random(41)
    pieces = ["<", "|", "<|", "|>", "\\", "<|turn|>", "<|end|>", "<|says|>", "<|image:0|>", "<\\|", "x", "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        parts, want, at = [], [], 0
        while at < len(text) or not parts:
            n = rng.randrange(0, 4)
            parts.append({"kind": "text", "text": text[at : at + n]})
            want.append(text[at : at + n])
            at += n
            if rng.random() < 0.2:
                parts.append({"kind": rng.choice(["image", "audio", "document", "other"]), "ref": "r"})
        out, v = chat_format.format_turn(rng.choice(["user", "assistant", "a<", "<|end|>"]), parts)
        (role, got), = chat_format.parse(out)
        assert "".join(t for kind, t in got if kind == "text") == "".join(want)
        assert [(kind, int(i)) for kind, i in got if kind != "text"] == [(a["kind"], a["part"]) for a in v.attachments]
        if role == "assistant":
            assert "".join(chat_format.unescape(out[a:b]) for a, b in v.loss) == "".join(want)


# Toxicity


def test_toxicity_as_summed_over_pairs(spark):
    """The score is the logistic of the weights of a text's terms and the products of all their pairs."""
    rng = random.Random(42)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta insult group".split()) for _ in range(8))) for i in range(300)]
    d = frame(spark, docs)
    model = toxicity.fit(d, spark.createDataFrame([(i, int("insult" in t and "group" in t)) for i, t in docs], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    for i, text in docs[:40]:
        terms = sorted({int(model.place[s]) for w in text.split() for s in toxicity.slots_of(w) if model.place[s] >= 0})
        z = model.bias + sum(model.weights[a] for a in terms) + sum(float(model.factors[a] @ model.factors[b]) for a in terms for b in terms if a < b)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "alpha insult"), (1, "beta"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("predicted", "score", "held_out", "kept", "toxic")})
    model = toxicity.fit(d, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert toxicity.score(d, model).columns == ["doc_id", "held_out", "score", "predicted"] and toxicity.score(d, model).count() == 3
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns and kept.where("predicted = 'x' and score = 'x'").count() == kept.count()


def test_toxicity_learns_pairs(spark):
    """Insults without a group and groups without an insult are clean; both together are toxic."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(20)] + ["blockhead"] * insult + ["villagers"] * group
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    docs += [(9000, None), (9001, ""), (None, "blockhead villagers")]
    d, lab = frame(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, lab, epochs=40)).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert len(held) > 200 and sum(p == t for p, t in held) / len(held) > 0.97
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out


def test_toxicity_learns_pairs_of_terms_that_are_neutral_alone(spark):
    """Each of four words is as frequent in clean texts as in toxic ones; two of their pairs are toxic, among far more terms than are kept."""
    rng = np.random.default_rng(3)
    words = [f"{w:x}q" for w in rng.integers(1 << 40, size=20_000)]
    often = 1 / np.arange(1, len(words) + 1) ** 0.8
    docs, labels = [], []
    for i in range(3000):
        a, b = i % 2, i // 2 % 2
        docs.append((i, " ".join([*(words[w] for w in rng.choice(len(words), 40, p=often / often.sum())), ("alpha", "gamma")[a], ("beta", "delta")[b]])))
        labels.append((i, int(a == b)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    of = lambda model: np.mean([r.predicted == labels[r.doc_id][1] for r in toxicity.score(d, model).where("held_out").collect()])
    assert of(toxicity.fit(d, lab, pairs=256)) > 0.95
    assert of(toxicity.fit(d, lab)) < 0.7


def test_toxicity_without_labels(spark):
    d = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.fit(d, none)).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {0.0}
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), none)).count() == 0
