"""Queries over what is written and read back: folders, data sets, stores, blocks, files; and over axes, layouts of ids and samples.

Each writes to the shared folder, reads what it wrote, and stands beside SQL over the tables it came from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import blocks, strings
from ..operators import clusters, embed, extras, filtering, layout, summary
from ..session import scratch
from ..sources import files, mex, store, tables
from .matrix_queries import CB, LETTERS, OP, SP, query, r

# Matrix-Market folders

SUPPLIED = f"{SP}, k AS (SELECT DISTINCT bc_id FROM m)"


def _supplied(spark, d):
    m = tables.suppliers_by_parts(spark, d)
    return model.CountMatrix(m.barcodes.select("bc_id", "barcode"), m.features, {"raw": m.layers["raw"].withColumn("value", F.col("value").cast("long"))})


def _folder(spark, d):
    path = scratch(spark)
    mex.write(_supplied(spark, d), path)
    return path


@query(f"WITH {SP} SELECT s_name AS barcode, 'part' || ft_id AS id_feature, CAST(value AS BIGINT) AS value FROM m JOIN supplier ON bc_id = s_suppkey")
def q_mex_read(spark, d):
    return mex.long_table(mex.read(spark, _folder(spark, d))).select("barcode", "id_feature", F.col("read_count").alias("value"))


@query(f"WITH {SP} SELECT (SELECT count(*) FROM part) AS features, (SELECT count(*) FROM supplier) AS barcodes, count(*) AS records, 'integer' AS kind, true AS whole FROM m")
def q_mex_shape(spark, d):
    """The description line, the header's kind, and what they say of a file that isn't there."""
    path = _folder(spark, d)
    n, m, k = mex.shape(spark, path)
    kind = mex.kind(spark, mex.essential_files(spark, path)["matrix"])
    return spark.createDataFrame([(n, m, k, kind, mex.shape(spark, f"{path}/none") is None and mex.header_kind("%%other") is None)], "features long, barcodes long, records long, kind string, whole boolean")


@query("SELECT * FROM (VALUES ('a', 'barcodes', true), ('a', 'features', true), ('a', 'matrix', true), ('b', 'barcodes', true), ('b', 'features', true), ('b', 'matrix', true)) t(sample, file, essential)")
def q_mex_files(spark, d):
    """Folders found by wildcards, and which of their files are the essential ones."""
    root = scratch(spark)
    small = _supplied(spark, d)
    small = model.CountMatrix(small.barcodes.where("bc_id < 5"), small.features.where("ft_id < 5"), {"raw": small.layers["raw"].where("bc_id < 5 and ft_id < 5")})
    for sample in "ab":
        mex.write(small, f"{root}/{sample}_mtx")
    found = mex.globbed(spark, f"{root}/*_mtx/*.*.gz")
    known = {files.place(spark, p)[0].toUri().getPath() for s in "ab" for p in mex.essential_files(spark, f"{root}/{s}_mtx").values()}
    return found.where("size_in_bytes > 0 and time_last_modified is not null").select(F.col("wildcard_0").alias("sample"), F.col("wildcard_1").alias("file"), F.col("path").isin(list(known)).alias("essential"))


@query(f"WITH {SP} SELECT s_name AS barcode, 'part' || ft_id AS id_feature, p_brand AS genome, CAST(value AS BIGINT) AS value FROM m JOIN supplier ON bc_id = s_suppkey JOIN part ON ft_id = p_partkey")
def q_split_seq(spark, d):
    m, path = _supplied(spark, d), scratch(spark)
    mex.write_split_seq(m, path)
    x = mex.read_split_seq(spark, path)
    return mex.long_table(x).join(x.features.select("id_feature", "genome"), "id_feature").select("barcode", "id_feature", "genome", F.col("read_count").alias("value"))


@query(f"WITH {SP}, b AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS bc FROM (SELECT DISTINCT s_name FROM m JOIN supplier ON bc_id = s_suppkey)), f AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ft FROM (SELECT DISTINCT 'part' || ft_id AS id FROM m)) SELECT ft AS ft_id, bc AS bc_id, CAST(value AS BIGINT) AS value FROM m JOIN supplier ON bc_id = s_suppkey JOIN b USING (s_name) JOIN f ON f.id = 'part' || m.ft_id")
def q_from_long_table(spark, d):
    return mex.from_long_table(mex.long_table(_supplied(spark, d)).withColumn("feature", F.col("id_feature"))).layers["raw"].select("ft_id", "bc_id", "value")


@query(f"WITH {SP}, c AS (SELECT s_name, count(*) AS n FROM m JOIN supplier ON bc_id = s_suppkey GROUP BY 1) SELECT row_number() OVER (ORDER BY n DESC, s_name) - 1 AS bc_id, s_name AS barcode FROM c")
def q_barcodes_by_records(spark, d):
    return mex.from_long_table(mex.long_table(_supplied(spark, d)).withColumn("feature", F.col("id_feature")), True).barcodes.select("bc_id", "barcode")


@query(f"WITH {SP} SELECT CAST(ft_id AS BIGINT) AS ft_id, CAST(bc_id AS BIGINT) AS bc_id, CAST(value AS BIGINT) AS value, true AS small FROM m")
def q_records_split(spark, d):
    """Files of a thousand records at most, read back with the size of the file that each record is in."""
    path = scratch(spark)
    extras.split_records(_supplied(spark, d).layers["raw"], f"{path}/split", 1000)
    x = spark.read.parquet(f"{path}/split").withColumn("file", F.input_file_name())
    n = x.groupBy("file").agg(F.count("*").alias("n"))
    return x.join(n, "file").select("ft_id", "bc_id", "value", (F.col("n") <= 1000).alias("small"))


@query("SELECT 's' || n_nationkey AS name, n_name AS nation, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def q_printed_table(spark, d):
    """A table as it would be printed, and read from the print."""
    rows = [("name", "nation", "region")] + [(f"s{x.n_nationkey}", x.n_name, str(x.n_regionkey)) for x in tables.table(spark, d, "nation").collect()]
    wide = [max(len(x[i]) for x in rows) + 2 for i in range(3)]
    return mex.printed_table(spark, "\n".join("".join(c.ljust(w) for c, w in zip(x, wide)) for x in rows))


@query("SELECT s_suppkey, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS stop FROM (SELECT s_suppkey, 0 AS a, 1 + s_suppkey % 4 AS b FROM supplier UNION ALL SELECT s_suppkey, 2 + s_suppkey % 4, 5 + s_suppkey % 4 FROM supplier)")
def q_field_locations(spark, d):
    """Rulers of two fields, the first of one to four characters, the second of three."""
    ruler = F.concat(F.repeat(F.lit("-"), (1 + F.col("s_suppkey") % 4).cast("int")), F.lit(" ---"))
    return tables.table(spark, d, "supplier").select("s_suppkey", F.explode(strings.fields(ruler)).alias("f")).select("s_suppkey", "f.start", "f.stop")


@query("SELECT page_id, replace(replace(replace(replace(url, ':', '_'), '/', '_'), '?', '_'), '*', '_') AS name FROM pages")
def q_window_path(spark, d):
    return tables.table(spark, d, "pages").select("page_id", strings.window_path_safe(F.col("url")).alias("name"))


@query("SELECT s_suppkey, CAST(json_extract_string(j, '$.s_nationkey') AS INTEGER) AS s_nationkey FROM (SELECT s_suppkey, to_json({'s_suppkey': s_suppkey, 's_nationkey': s_nationkey}) AS j FROM supplier)")
def q_json(spark, d):
    x = extras.as_json(tables.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"))
    return x.select(F.from_json("json", "s_suppkey long, s_nationkey int").alias("j")).select("j.s_suppkey", "j.s_nationkey")


@query("SELECT count(*) AS n, count(DISTINCT s_suppkey) AS ids, true AS well_formed FROM supplier")
def q_new_ids(spark, d):
    """A random id for each row: as many as rows, each of 32 hex digits; and the time now, in its form."""
    x = tables.table(spark, d, "supplier").select("s_suppkey", strings.new_id().alias("id"), strings.timestamp().alias("t"))
    good = F.bool_and(F.col("id").rlike("^[0-9a-f]{32}$") & F.col("t").rlike(r"^\d{8}_\d{4}$"))
    return x.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), good.alias("well_formed"))


# Masks and positions


@query("SELECT s_suppkey AS bc_id FROM supplier WHERE s_nationkey % 3 = 1")
def q_positions(spark, d):
    """Where a mask is set."""
    x = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("bc_id"), (F.col("s_nationkey") % 3 == 1).alias("mask"))
    return filtering.positions(x, "bc_id")


@query("SELECT s_suppkey AS bc_id, s_nationkey % 2 = 0 AS mask, true AS is_mask FROM supplier WHERE s_suppkey < 100")
def q_mask_of_bits(spark, d):
    bits = [x[0] % 2 == 0 for x in tables.table(spark, d, "supplier").where("s_suppkey < 100").orderBy("s_suppkey").select("s_nationkey").collect()]
    return extras.as_mask(spark, bits).withColumn("is_mask", F.lit(extras.is_mask(bits) and not extras.is_mask([0, 1, 2, 3])))


# Data sets, stores, catalogs


def _dataset(spark, d, modes=("bc_id", "ft_id")):
    path = scratch(spark)
    tables.suppliers_by_parts(spark, d).write(path, modes)
    return path


@query(f"WITH {SP} SELECT m.ft_id, m.bc_id, value, s_name AS barcode FROM m JOIN supplier ON bc_id = s_suppkey WHERE m.ft_id % 10 = 3")
def q_dataset(spark, d):
    """Written with a copy by each axis, opened by features, and selected from."""
    m = model.opened(spark, _dataset(spark, d), ["raw"], by="ft_id")
    records, bc, _ = m["raw", :, ["barcode"], F.col("ft_id") % 10 == 3, []]
    return records.join(bc, "bc_id").select("ft_id", "bc_id", "value", "barcode")


@query(f"WITH {SP} SELECT ft_id, bc_id, CASE WHEN bc_id % 5 = 0 THEN value * 2 ELSE value END AS value FROM m UNION ALL SELECT -1, -1, 7.0")
def q_dataset_overlay(spark, d):
    """A writable layer over one that is only read, in which rows are changed and one is added."""
    base, mine = _dataset(spark, d, ("bc_id",)), scratch(spark)
    raw = tables.suppliers_by_parts(spark, d).layers["raw"]
    added = spark.createDataFrame([(-1, -1, 7.0)], "ft_id long, bc_id long, value double")
    raw.where("bc_id % 5 = 0").withColumn("value", F.col("value") * 2.0).unionByName(added).write.parquet(f"{mine}/layers/raw/bc_id")
    return model.opened(spark, base, ["raw"], over=mine).layers["raw"].select("ft_id", "bc_id", "value")


@query(f"WITH {SP} SELECT 'barcodes' AS part, count(*) AS n FROM supplier UNION ALL SELECT 'features', count(*) FROM part UNION ALL SELECT 'layers/raw/bc_id', count(*) FROM m")
def q_dataset_copy(spark, d):
    base, to = _dataset(spark, d, ("bc_id",)), scratch(spark)
    files.copy_dataset(spark, base, to)
    parts = ["barcodes", "features", "layers/raw/bc_id"]
    n = [spark.read.parquet(f"{to}/{p}").select(F.lit(p).alias("part")) for p in parts]
    return n[0].union(n[1]).union(n[2]).groupBy("part").agg(F.count("*").alias("n"))


@query(f"WITH {SP} SELECT ft_id, bc_id, CASE WHEN ft_id % 7 = 0 THEN 1.0 ELSE value END AS value FROM m WHERE ft_id < 500 AND ft_id % 2 = 0 AND bc_id >= 3")
def q_store(spark, d):
    """Written, changed at some positions, cut, and selected from by a slice."""
    raw = tables.suppliers_by_parts(spark, d).layers["raw"]
    s = store.Store(spark, f"{scratch(spark)}/one", "w", (1_000_000, 1_000_000))
    s.write(raw)
    s.write(raw.where("ft_id % 7 = 0").withColumn("value", F.lit(1.0)))
    s.resize(500, 1_000_000)
    return store.Store(spark, s.path).basic(slice(None, None, 2), slice(3, None)).select("ft_id", "bc_id", "value")


@query("SELECT * FROM (VALUES ('kept', '[1,2]', true), ('set later', '\"x\"', true), ('got or set', '5', true)) t(name, value, again)")
def q_store_attributes(spark, d):
    path = f"{scratch(spark)}/one"
    s = store.Store(spark, path, "w", (1, 2))
    s.set_attrs(kept=[1, 2], changed=1)
    s.set_attrs(later="x")
    first = s.get_or_set("more", 5), s.get_or_set("more", 6)
    again = store.Store(spark, path)
    try:
        again.set_attrs(x=1)
        refused = False
    except PermissionError:
        refused = True
    got = again.get_attrs("kept", "later", "none")
    ok = refused and again.shape == (1, 2) and first == (5, 5) and again.open(path) is again and set(got) == {"kept", "later"}
    return spark.createDataFrame([("kept", "[1,2]" if got["kept"] == [1, 2] else "", ok), ("set later", f'"{got["later"]}"', ok), ("got or set", str(again.get_attr("more")), ok)], "name string, value string, again boolean")


@query("SELECT * FROM (VALUES ('first', true), ('second while held', false), ('first again', true), ('second when free', true), ('free at the end', true)) t(step, done)")
def q_lock(spark, d):
    path = f"{scratch(spark)}/thing"
    a, b = files.Lock(spark, path, 0.01), files.Lock(spark, path, 0.01, fail=True)

    def gets(lock):
        try:
            lock.acquire()
            return True
        except TimeoutError:
            return False

    steps = [("first", gets(a)), ("second while held", gets(b)), ("first again", gets(a))]
    a.release()
    a.release()
    steps.append(("second when free", gets(b)))
    b.release()
    return spark.createDataFrame([*steps, ("free at the end", not a.taken())], "step string, done boolean")


@query(f"WITH {SP} SELECT ft_id, bc_id, value, 1 AS loaded FROM m UNION ALL SELECT ft_id, bc_id, value, 2 FROM m WHERE bc_id < 50")
def q_catalog(spark, d):
    """Two matrices put into a catalog, one emptied, replaced and loaded again, a third deleted."""
    m = tables.suppliers_by_parts(spark, d)
    c = model.Catalog(spark, scratch(spark))
    few = model.CountMatrix(m.barcodes, m.features, {"raw": m.layers["raw"].where("bc_id < 50")})
    c.update("all", m)
    c.update("few", c.empty(few))
    c.update("gone", few)
    c.load("few", ["raw"])
    c.update("few", few)
    c.delete("gone")
    c.unload("all")
    assert not files.exists(spark, f"{c.root}/gone")
    x, y = c.load("all", ["raw"]), c.transferred(c.load("few", ["raw"]), m)
    assert y.barcodes.columns == m.barcodes.columns
    return x.layers["raw"].withColumn("loaded", F.lit(1)).unionByName(y.layers["raw"].withColumn("loaded", F.lit(2))).select("ft_id", "bc_id", "value", "loaded")


@query("SELECT * FROM (VALUES ('a', '2'), ('c', '[3]')) t(key, value)")
def q_key_values(spark, d):
    path, over = scratch(spark), scratch(spark)
    base = extras.KeyValues(spark, f"{path}/kv")
    base["a"], base["b"], base["c"] = 1, 2, [3]
    mine = extras.KeyValues(spark, f"{path}/kv", f"{over}/kv")
    mine["a"] = 2
    del mine["b"]
    assert base["a"] == 1 and mine["none"] is None and "b" not in mine
    return spark.createDataFrame(sorted((k, str(v)) for k, v in mine.all().items()), "key string, value string")


@query("SELECT s_suppkey AS bc_id, s_name AS barcode, true AS thirds, (SELECT count(*) FROM supplier WHERE s_nationkey % 3 = 1) AS n, (SELECT count(*) FROM supplier) AS n_rows FROM supplier WHERE s_nationkey % 3 = 1")
def q_axis_filters(spark, d):
    """A filter set, counted, saved as a column, lifted, and taken up again by its name."""
    axis = tables.suppliers_by_parts(spark, d).bc.filtered(F.col("s_nationkey") % 3 == 1).save_filter("thirds", {"of": "a third of the nations"})
    n, whole = axis.count(), axis.all()
    again = whole.change_filter("thirds")
    names = again.names().withColumnRenamed("barcode", "listed")
    x = again.meta("barcode", "thirds").join(names, F.col("barcode") == F.col("listed"))
    return x.select("bc_id", "barcode", "thirds", F.lit(n).cast("long").alias("n"), F.lit(again.n_rows).cast("long").alias("n_rows"))


@query("SELECT s_suppkey AS bc_id, s_nationkey AS nation FROM supplier WHERE s_suppkey < 50")
def q_axis_dict(spark, d):
    got = tables.suppliers_by_parts(spark, d).bc.filtered(F.col("bc_id") < 50).as_dict("s_nationkey")
    return spark.createDataFrame(list(got.items()), "bc_id long, nation int")


@query(f"WITH {SP} SELECT s_name AS barcode, p_brand AS feature, sum(value) AS value FROM m JOIN supplier ON bc_id = s_suppkey JOIN part ON ft_id = p_partkey WHERE s_suppkey < 20 AND p_partkey < 200 GROUP BY 1, 2")
def q_annotated(spark, d):
    """An object in memory made of a matrix, and a matrix made of the object."""
    from ..sources import annotated

    m = tables.suppliers_by_parts(spark, d)
    m.bc, m.ft = m.bc.filtered(F.col("bc_id") < 20), m.ft.filtered(F.col("ft_id") < 200)
    path = scratch(spark)
    annotated.write_dataset(spark, annotated.to_annotated(m), path)
    back = model.opened(spark, path, ["raw"], by="ft_id")
    x = back.layers["raw"].join(back.barcodes, "bc_id").join(back.features.select("ft_id", "feature"), "ft_id")
    return x.groupBy("barcode", "feature").agg(F.sum("value").alias("value"))


# Blocks, files


@query(f"WITH {SP} SELECT f.form, ft_id, bc_id, value FROM m, (SELECT unnest(['mtx_gzipped', 'pickle', 'pickle_gzipped', 'feather', 'feather_lz4']) AS form) f WHERE bc_id % 4 = 1")
def q_block_formats(spark, d):
    """Every format there and back."""
    records = tables.suppliers_by_parts(spark, d).layers["raw"].where("bc_id % 4 = 1")
    out = None
    for form in blocks.FORMATS:
        x = blocks.unpacked(blocks.packed(records, form), form).withColumn("form", F.lit(form))
        out = x if out is None else out.unionByName(x)
    return out.select("form", "ft_id", "bc_id", "value")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def q_parsed_lines(spark, d):
    """Lines of gzip files, of which a function makes records or nothing."""
    path = scratch(spark)
    lines = tables.table(spark, d, "supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name").alias("line"))
    lines.write.option("compression", "gzip").text(f"{path}/lines")

    def record(line):
        key, name = line.split("\t")
        return (int(key), name) if int(key) % 3 == 0 else None

    return blocks.parsed_lines(spark, f"{path}/lines", record, "s_suppkey long, s_name string")


@query("SELECT * FROM (VALUES ('made', true), ('is a folder', true), ('copied', true), ('moved', true), ('source is gone', true), ('found', true), ('bytes', true), ('not overwritten', true), ('removed', true), ('gone', true), ('no web address', true), ('s3 as Hadoop has it', true)) t(step, done)")
def q_file_operations(spark, d):
    root = scratch(spark)
    steps = [("made", files.make_folder(spark, f"{root}/a/b"))]
    files.write_bytes(spark, f"{root}/a/b/x.bin", b"\x00\x01text")
    steps.append(("is a folder", files.is_folder(spark, f"{root}/a") and not files.is_folder(spark, f"{root}/a/b/x.bin")))
    steps.append(("copied", files.copy(spark, f"{root}/a", f"{root}/c") and files.exists(spark, f"{root}/a/b/x.bin")))
    steps.append(("moved", files.move(spark, f"{root}/c", f"{root}/e")))
    steps.append(("source is gone", not files.exists(spark, f"{root}/c")))
    steps.append(("found", len(files.matching(spark, f"{root}/*/b/*.bin")) == 2 and files.files_below(spark, f"{root}/e") == [("b/x.bin", 6)]))
    steps.append(("bytes", files.read_bytes(spark, f"{root}/e/b/x.bin") == b"\x00\x01text" and files.download(spark, f"{root}/e/b/x.bin", f"{root}/y.bin") == 6))
    try:
        files.write_bytes(spark, f"{root}/y.bin", b"", overwrite=False)
        steps.append(("not overwritten", False))
    except Exception:
        steps.append(("not overwritten", True))
    steps += [("removed", files.remove(spark, f"{root}/e")), ("gone", not files.remove(spark, f"{root}/e")), ("no web address", files.http_status("http://127.0.0.1:9/") is None and not files.exists(spark, "http://127.0.0.1:9/")), ("s3 as Hadoop has it", files.hadoop("s3://b/k") == "s3a://b/k")]
    return spark.createDataFrame(steps, "step string, done boolean")


@query("SELECT * FROM (VALUES ('folder/a.txt', 'one', true), ('folder/b/c.txt', 'two', true)) t(name, content, refused)")
def q_archive(spark, d):
    root = scratch(spark)
    files.write_bytes(spark, f"{root}/folder/a.txt", b"one")
    files.write_bytes(spark, f"{root}/folder/b/c.txt", b"two")
    files.archive(spark, f"{root}/folder", f"{root}/x.tar.gz")
    names = files.unpack(spark, f"{root}/x.tar.gz", f"{root}/out")
    import io
    import tarfile

    bad = io.BytesIO()
    with tarfile.open(fileobj=bad, mode="w:gz") as tar:
        tar.addfile(tarfile.TarInfo("../evil"), io.BytesIO())
    files.write_bytes(spark, f"{root}/bad.tar.gz", bad.getvalue())
    try:
        files.unpack(spark, f"{root}/bad.tar.gz", f"{root}/out")
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(n, files.read_bytes(spark, f"{root}/out/{n}").decode(), refused) for n in names], "name string, content string, refused boolean")


@query("SELECT * FROM (VALUES ('object', true), ('table', true), ('number', true), ('stream', true), ('command', true), ('package', true)) t(what, same)")
def q_objects(spark, d):
    """Objects, Arrow tables and numbers there and back; what a stream gives; what a command prints; what is installed."""
    import io

    import numpy as np
    import pyarrow as pa

    path, value = f"{scratch(spark)}/o", {"a": [1, (2, "x")], "b": None}
    files.write_object(spark, path, value)
    table = pa.table({"a": [1, None], "b": ["x", "y"]})
    rows = [
        ("object", files.read_object(spark, path) == value),
        ("table", all(blocks.bytes_table(blocks.table_bytes(table, c)).equals(table) for c in (None, "lz4"))),
        ("number", type(files.plain_number(np.float32(2))) is float and files.plain_number(3) == 3),
        ("stream", files.is_binary(io.BytesIO()) and not files.is_binary(io.StringIO())),
        ("command", files.command(["echo", "x y"]) == "x y\n" and files.command(["echo"], binary=True) == b"\n"),
        ("package", files.packages(spark, ["pyspark"]).count() == 1),
    ]
    return spark.createDataFrame(rows, "what string, same boolean")


# Samples, neighbours, simulation

NEAR = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), nn AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label, list_distance(a.v, b.v) ** 2 AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10)"


def _near(spark, d):
    e = tables.table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return e, embed.neighbours(e.where("vec_id % 50 = 0"), e, 10, "vec_id", "embedding")


@query(f"WITH {NEAR}, c AS (SELECT query, label, count(*) AS n FROM nn GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY query) AS t FROM c) SELECT query, label, round(n / t, 6) AS share FROM o WHERE r = 1")
def q_label_transfer(spark, d):
    e, found = _near(spark, d)
    return embed.transferred_labels(found, e).select("query", "label", r("share"))


@query(f"WITH {NEAR}, a AS (SELECT query, avg(distance) AS d FROM nn GROUP BY 1), x AS (SELECT a.*, e.label FROM a JOIN e ON a.query = e.vec_id), q AS (SELECT label, greatest(1, floor((SELECT count(*) FROM x) // 2 * count(*) / (SELECT count(*) FROM x))) AS quota FROM x GROUP BY 1), o AS (SELECT x.*, row_number() OVER (PARTITION BY label ORDER BY d DESC, query) AS r FROM x) SELECT query, round(d, 5) AS avg_dist FROM o JOIN q USING (label) WHERE r <= quota")
def q_spread_subsample(spark, d):
    """Half of the queries, from each label its share, those of the thinnest regions."""
    e, found = _near(spark, d)
    total = e.where("vec_id % 50 = 0 and embedding is not null").count() // 2
    return embed.spread_subsample(found, total, e).select("query", r("avg_dist", 5))


@query("WITH x AS (SELECT c_custkey AS bc_id, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(md5(c_custkey || ':0'), 1, 8), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS k, count(*) OVER () AS n FROM customer) SELECT bc_id, label FROM x WHERE r <= greatest(1, floor(300 * k / n))")
def q_subsample_for_each_cluster(spark, d):
    m = tables.customers_by_brands(spark, d)
    return clusters.subsampled(m.barcodes.select("bc_id", F.col("c_mktsegment").alias("label")), 300)


@query("SELECT o_orderkey AS bc_id FROM orders WHERE substr(md5(o_orderkey || ':0'), 1, 8) < '33333333'")
def q_sample_mask(spark, d):
    m = tables.orders_by_parts(spark, d)
    assert m.bc.sample(1.0).filter is None
    return m.bc.sample(0.2).active.select("bc_id")


DRAWS = ", ".join(f"(('0x' || substr(md5(ft_id || ':' || bc_id || ':' || copy || ':{i}'), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE AS u{i}" for i in range(3))


@query(f"WITH {SP}, x AS (SELECT m.*, copy, {DRAWS} FROM m, (SELECT unnest([0, 1, 2]) AS copy)) SELECT ft_id, bc_id, copy, CASE WHEN u0 < 0.5 THEN greatest(CAST(trunc(value * (1.0::DOUBLE + sqrt(-2.0::DOUBLE * ln(u1)) * cos(2 * pi() * u2) * 0.3::DOUBLE)) AS BIGINT), 1) ELSE CAST(trunc(value) AS BIGINT) END AS value FROM x")
def q_simulate(spark, d):
    m = tables.suppliers_by_parts(spark, d)
    return embed.simulated(m.layers["raw"], m.barcodes, 3)[0].select("ft_id", "bc_id", "copy", "value")


PREPARED = f"""{OP}, g AS (SELECT bc_id, sum(value) AS total FROM m GROUP BY 1 HAVING sum(value) > 50 AND count(*) > 1), n AS (SELECT count(*)::DOUBLE AS n FROM g),
x AS (SELECT ft_id, bc_id, log10(value + 1) AS log, log10(value / total * 10000 + 1) AS lognorm FROM m JOIN g USING (bc_id)),
mo AS (SELECT ft_id, {', '.join(f'sum({t}) / any_value(n) AS mean_{t}, (sum({t} * {t}) - 2 * sum({t}) / any_value(n) * sum({t}) + count(*) * (sum({t}) / any_value(n)) ** 2) / (any_value(n) - 1) AS var_{t}' for t in ('log', 'lognorm'))} FROM x, n GROUP BY 1)"""


def _prepared_sql() -> str:
    from .matrix_queries import _fit_sql, _score_sql

    return f"""WITH {PREPARED}, {_fit_sql('log')}, {_fit_sql('lognorm')}, {_score_sql('log')}, {_score_sql('lognorm')}, top AS (SELECT ft_id FROM z_log JOIN z_lognorm USING (ft_id) JOIN mo USING (ft_id) WHERE mean_lognorm >= 0.01 AND var_lognorm >= 0.01 ORDER BY CASE WHEN score_lognorm < 0 OR score_log < 0 THEN 0.0 ELSE score_lognorm * score_log END DESC, ft_id LIMIT 200)
SELECT ft_id, bc_id, round(least(lognorm, 10.0::DOUBLE), 6) AS value FROM x SEMI JOIN top USING (ft_id)"""


@query(_prepared_sql())
def q_prepared_layer(spark, d):
    m = tables.orders_by_parts(spark, d).prepared(min_counts=50, min_features=1, n_variable=200)
    return m.layers["normalized_log1p_capped"].select("ft_id", "bc_id", r("value"))


@query()
def q_communities(spark, d):
    e, found = _near(spark, d)
    return embed.communities(found)


@query()
def q_layout(spark, d):
    e = tables.table(spark, d, "embeddings").select("vec_id", "embedding").where("embedding is not null")
    x = embed.apply_layout(embed.train_layout(e, "vec_id", "embedding", most=1000, epochs=60), e)
    return x.select("vec_id", r("x", 4), r("y", 4))


# Charts


@query("SELECT CAST(floor(embedding[1]::DOUBLE / 0.1::DOUBLE) AS BIGINT) AS x, CAST(floor(embedding[2]::DOUBLE / 0.1::DOUBLE) AS BIGINT) AS y, label AS color, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2, 3")
def q_chart_bins(spark, d):
    """What a scatter chart draws: counts of points by bin and colour."""
    from ..functions import charts

    e = tables.table(spark, d, "embeddings").where("embedding is not null")
    return charts.binned(e, F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double"), F.col("label"), 0.1)


@query("SELECT * FROM (VALUES ('chart', true), ('sankey', true), ('notebook', true)) t(what, written)")
def q_charts(spark, d):
    """Charts as pages of their own, and a matrix as a notebook shows it."""
    from ..functions import charts

    root = scratch(spark)
    bins = q_chart_bins(spark, d)
    charts.save(spark, charts.scatter(bins, "Vectors", 0.1, font_size=14, wide=90), f"{root}/a.html")
    pairs = clusters.contingency(tables.table(spark, d, "customer"), "c_mktsegment", "c_nationkey", 1)
    charts.save(spark, charts.sankey(pairs, "c_mktsegment", "c_nationkey", "Segments"), f"{root}/b.html")
    a, b = (files.read_bytes(spark, f"{root}/{n}.html").decode() for n in "ab")
    shown = tables.suppliers_by_parts(spark, d)._repr_html_()
    n, k = bins.count(), pairs.count()
    return spark.createDataFrame([("chart", a.count("<circle") == n and "Vectors" in a), ("sankey", b.count("<path") == k), ("notebook", "s_nationkey" in shown and "raw" in shown)], "what string, written boolean")
