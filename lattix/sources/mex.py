"""Matrix-Market folders: matrix.mtx, features.tsv and barcodes.tsv, gzipped or not; and their relatives.

Axis files are numbered by line. Lines of one gzip file are one task's stream, so a file is numbered within its partition;
files of several parts are numbered over parts by their counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CountMatrix
from ..operators import layout
from ..operators.filtering import renumbered
from ..operators.summary import kept
from .files import exists, remove  # noqa: F401  of folders and their files
from .files import place as _fs

FEATURE = ["id_feature", "feature", "feature_type"]


def essential_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """The paths of the three files; an error where one is missing."""
    out = {}
    for name in ("matrix.mtx", "features.tsv", "barcodes.tsv"):
        found = next((x for x in (f"{folder.rstrip('/')}/{name}.gz", f"{folder.rstrip('/')}/{name}") if exists(spark, x)), None)
        if found is None:
            raise FileNotFoundError(f"{folder} has no {name}")
        out[name.split(".")[0]] = found
    return out


def header_kind(line: str | None) -> str | None:
    """integer or real, from the first line; None where it says neither."""
    m = re.match(r"%%MatrixMarket\s+matrix\s+coordinate\s+(integer|real)\b", line or "", re.I)
    return m[1].lower() if m else None


def kind(spark: SparkSession, path: str) -> str | None:
    first = spark.read.text(path).limit(1).collect()
    return header_kind(first[0][0]) if first else None


def shape(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """(features, barcodes, records) of a folder's or file's description line; None where there is no file."""
    if not path.endswith((".gz", ".mtx")):
        path = next((x for x in (f"{path.rstrip('/')}/matrix.mtx.gz", f"{path.rstrip('/')}/matrix.mtx") if exists(spark, x)), "")
    if not path or not exists(spark, path):
        return None
    first = spark.read.text(path).where(~F.col("value").startswith("%")).limit(1).collect()
    return tuple(int(x) for x in first[0][0].split()[:3]) if first else None


def _numbered(x: DataFrame, key: str) -> DataFrame:
    """Rows numbered from 0 in file order: within a file part, and over parts by their counts."""
    x = x.withColumn("_at", F.monotonically_increasing_id())
    x = x.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
    sizes = x.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a file part
    return x.join(F.broadcast(before), "_part").withColumn(key, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def _lines(spark: SparkSession, path: str, key: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """A table of separated lines, numbered from 0 in file order."""
    parts = F.split("value", re.escape(sep))
    return _numbered(spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)]), key).select(key, *columns)


def coordinates(spark: SparkSession, path: str, transpose: bool = False, whole: bool | None = None) -> DataFrame:
    """0-based (ft_id, bc_id, value) of a coordinate file, with or without header; integer headers give whole numbers, cut towards zero."""
    whole = kind(spark, path) != "real" if whole is None else whole
    lines = spark.read.text(path).where(~F.col("value").startswith("%")).withColumnRenamed("value", "line")
    if kind(spark, path):
        # The description is the first line left; a record may look the same, so that one is left out by its place.
        lines = lines.withColumn("_at", F.monotonically_increasing_id())
        first = lines.limit(1).collect()
        lines = lines.where(F.col("_at") != first[0]["_at"]).select("line") if first else lines.select("line")
    return layout.from_text(lines.where(F.trim("line") != ""), "long" if whole else "double", transpose)


def read(spark: SparkSession, folder: str) -> CountMatrix:
    files = essential_files(spark, folder)
    return CountMatrix(_lines(spark, files["barcodes"], "bc_id", ["barcode"]), _lines(spark, files["features"], "ft_id", FEATURE), {"raw": coordinates(spark, files["matrix"])})


def read_split_seq(spark: SparkSession, folder: str) -> CountMatrix:
    """cell_metadata.csv, genes.csv and DGE.mtx, whose rows are barcodes."""
    folder = folder.rstrip("/")
    numbered = lambda name, key: _numbered(spark.read.csv(f"{folder}/{name}", header=True), key)
    bc = numbered("cell_metadata.csv", "bc_id").select("bc_id", F.col("cell_barcode").alias("barcode"))
    genes = numbered("genes.csv", "ft_id")
    names = [c for c in genes.columns if c != "ft_id"][1:4]
    ft = genes.select("ft_id", *[F.col(f"`{c}`").alias(n) for c, n in zip(names, ["id_feature", "feature", "genome"])])
    return CountMatrix(bc, ft, {"raw": coordinates(spark, f"{folder}/DGE.mtx", transpose=True)})


def long_table(matrix: CountMatrix, layer: str = "raw") -> DataFrame:
    """(barcode, id_feature, read_count); names that the axes don't have are null."""
    x = matrix.layers[layer].join(matrix.barcodes, "bc_id", "left").join(matrix.features.select("ft_id", "id_feature"), "ft_id", "left")
    return x.select("barcode", "id_feature", F.col("value").alias("read_count"))


#: Lines that one task sorts and writes.
LINES = 500_000


def _write_lines(lines: DataFrame, n: int, folder: str, name: str) -> None:
    """One file of n lines by (_a, _b), gzipped if its name says so: tasks sort and write ranges of them, and what they wrote is put together in order; gzip files in a row are one gzip file."""
    spark = lines.sparkSession
    temp = f"{folder}/.{name}.parts"
    ranged = lines.repartitionByRange(1 + n // LINES, "_a", "_b").sortWithinPartitions("_a", "_b").select("line")
    ranged.write.mode("overwrite").option("compression", "gzip" if name.endswith(".gz") else "none").text(temp)
    p, fs = _fs(spark, temp)
    parts = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
    to = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    try:
        for part in sorted(parts, key=lambda x: int(x.getName().split("-")[1])):
            source = fs.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, to, 1 << 20, False)
            finally:
                source.close()
    finally:
        to.close()
    fs.delete(p, True)


def _write_records(matrix: CountMatrix, layer: str, whole: bool | None, folder: str, name: str, transpose: bool = False) -> None:
    """A coordinate file: header, description and the records by barcode and feature."""
    records = matrix.layers[layer]
    is_whole = dict(records.dtypes)["value"] in ("int", "bigint", "smallint") if whole is None else whole
    records = kept(records.select("ft_id", "bc_id", F.col("value").cast("long") if is_whole else F.col("value")))  # counted, ranged and written
    n = records.count()
    row, col, axes = ("bc_id", "ft_id", (matrix.barcodes, matrix.features)) if transpose else ("ft_id", "bc_id", (matrix.features, matrix.barcodes))
    head = f"%%MatrixMarket matrix coordinate {'integer' if is_whole else 'real'} general\n%\n{axes[0].count()} {axes[1].count()} {n}"
    line = F.concat_ws(" ", (F.col(row) + 1).cast("string"), (F.col(col) + 1).cast("string"), F.col("value").cast("string"))
    body = records.select(F.col("bc_id").alias("_a"), F.col("ft_id").alias("_b"), line.alias("line"))
    top = records.sparkSession.createDataFrame([(-1, i, x) for i, x in enumerate(head.split("\n"))], "_a long, _b long, line string")
    _write_lines(top.union(body), n, folder, name)


def _write_axis(axis: DataFrame, key: str, line: Column, folder: str, name: str, head: str | None = None) -> None:
    """A line an entry by id, after a line of names where there is one."""
    lines = axis.select(F.col(key).cast("long").alias("_a"), F.lit(0).alias("_b"), line.alias("line"))
    top = axis.sparkSession.createDataFrame([(-1, 0, head)] if head else [], "_a long, _b int, line string")
    _write_lines(top.union(lines), axis.count(), folder, name)


def write(matrix: CountMatrix, folder: str, layer: str = "raw", whole: bool | None = None) -> None:
    """A folder of three gzip files, the format's own; for data of size keep Parquet (CountMatrix.write)."""
    folder = folder.rstrip("/")
    _write_records(matrix, layer, whole, folder, "matrix.mtx.gz")
    _write_axis(matrix.barcodes, "bc_id", F.col("barcode"), folder, "barcodes.tsv.gz")
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in matrix.features.columns else F.lit("Gene Expression") for c in FEATURE]
    _write_axis(matrix.features, "ft_id", F.concat_ws("\t", *cols), folder, "features.tsv.gz")


def write_split_seq(matrix: CountMatrix, folder: str, layer: str = "raw", whole: bool | None = None) -> None:
    """cell_metadata.csv, genes.csv and DGE.mtx, whose rows are barcodes; the genome is the features' own column, or their name."""
    folder = folder.rstrip("/")
    _write_records(matrix, layer, whole, folder, "DGE.mtx", transpose=True)
    _write_axis(matrix.barcodes, "bc_id", F.to_csv(F.struct("barcode", F.lit(1))), folder, "cell_metadata.csv", "cell_barcode,n")
    genome = "genome" if "genome" in matrix.features.columns else "feature"
    line = F.to_csv(F.struct(F.col("ft_id").alias("nth"), "id_feature", F.col("feature").alias("gene_name"), F.col(genome).alias("genome")))
    _write_axis(matrix.features, "ft_id", line, folder, "genes.csv", "nth,id_feature,gene_name,genome")


def from_long_table(counts: DataFrame, by_records: bool = False) -> CountMatrix:
    """A matrix of rows (barcode, id_feature, feature, read_count): a feature for each id, a barcode for each name; barcodes by name, or by falling number of records."""
    bc = counts.groupBy("barcode").agg(F.count("*").alias("n"))
    bc = renumbered(bc, "barcode", "bc_id", [F.desc("n"), F.col("barcode")] if by_records else None).select("bc_id", "barcode")
    ft = counts.groupBy("id_feature").agg(F.min("feature").alias("feature"))
    ft = ft.join(renumbered(ft, "id_feature", "ft_id"), "id_feature").select("ft_id", "id_feature", "feature", F.lit("Gene Expression").alias("feature_type"))
    records = counts.join(bc, "barcode").join(ft.select("ft_id", "id_feature"), "id_feature").select("ft_id", "bc_id", F.col("read_count").alias("value"))
    return CountMatrix(bc, ft, {"raw": layout.summed(records)})


def globbed(spark: SparkSession, pattern: str) -> DataFrame:
    """(wildcard_0.., path, size_in_bytes, time_last_modified) of the paths that match, each * a column."""
    _, fs = _fs(spark, pattern)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or []
    stars = pattern.count("*")
    match: re.Pattern = re.compile(".*?" + "([^/]*?)".join(map(re.escape, pattern.split("*"))) + "$")
    rows = []
    for s in found:
        p = s.getPath().toUri().getPath()
        m = match.match(p)
        rows.append((*(m.groups() if m else [None] * stars), p, s.getLen(), s.getModificationTime() / 1000))
    fields = [T.StructField(f"wildcard_{i}", T.StringType()) for i in range(stars)]
    schema = T.StructType([*fields, T.StructField("path", T.StringType()), T.StructField("size_in_bytes", T.LongType()), T.StructField("modified", T.DoubleType())])
    return spark.createDataFrame(rows, schema).withColumn("time_last_modified", F.timestamp_seconds("modified")).drop("modified")


def printed_table(spark: SparkSession, text: str) -> DataFrame:
    """A fixed-width printed table: columns part where the most lines have a space; values stay strings."""
    lines = [x for x in text.split("\n") if x.strip()]
    wide = max(map(len, lines))
    spaces = [sum(len(x) <= i or x[i] == " " for x in lines) for i in range(wide)]
    gap = [n == len(lines) for n in spaces]
    spans, start = [], None
    for i in range(wide + 1):
        if i < wide and not gap[i]:
            start = i if start is None else start
        elif start is not None:
            spans.append((start, i))
            start = None
    cells = [[x[a:b].strip() for a, b in spans] for x in lines]
    return spark.createDataFrame(cells[1:], T.StructType([T.StructField(c, T.StringType()) for c in cells[0]]))


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 needs h5py, which isn't installed") from e
    return h5py


def read_hdf5(spark: SparkSession, path: str, batch: int = 1_000_000) -> CountMatrix:
    """A compressed-column HDF5 file that driver and executors reach, where h5py is installed. The driver reads its sizes alone; ranges of its arrays are read by the executors, and columns expanded by Spark."""
    import pyarrow as pa

    with _h5py().File(path, "r") as f:
        m = f["matrix"]
        sizes = {k: m[k].shape[0] for k in ("indptr", "barcodes", "features/id", "data")}

    def ranged(size: str, names: list[str], schema: str):
        n = sizes[size]

        def run(batches):
            for batch_ in batches:
                for start in batch_.column(0).to_pylist():
                    with _h5py().File(path, "r") as f:
                        cols = [f["matrix"][k][start * batch : min(n, (start + 1) * batch)] for k in names]
                    at = pa.array(range(start * batch, start * batch + len(cols[0])), pa.int64())
                    cols = [pa.array([v.decode() for v in c.tolist()]) if c.dtype.kind in "SO" else pa.array(c).cast(pa.float64() if k == "data" else pa.int64()) for k, c in zip(names, cols)]
                    yield pa.RecordBatch.from_arrays([at, *cols], [x.split(" ")[0] for x in schema.split(", ")])

        parts = max(1, -(-n // batch))
        return spark.range(0, -(-n // batch), numPartitions=parts).mapInArrow(run, schema)

    pointers = ranged("indptr", ["indptr"], "position long, pointer long")
    bc = ranged("barcodes", ["barcodes"], "bc_id long, barcode string")
    ft = ranged("features/id", ["features/id", "features/name", "features/feature_type"], "ft_id long, id_feature string, feature string, feature_type string")
    data = ranged("data", ["indices", "data"], "position long, ft_id long, value double")
    records = data.join(layout.expanded(pointers), "position").select("ft_id", F.col("entry").alias("bc_id"), "value")
    return CountMatrix(bc, ft, {"raw": records})


def write_hdf5(matrix: CountMatrix, path: str, layer: str = "raw", genome: str = "unknown", batch: int = 1_000_000) -> None:
    """A compressed-column HDF5 file, where h5py is installed; Spark sorts and counts, the driver writes the one file slab by slab."""
    h5py = _h5py()
    import numpy as np

    records = layout.whole_counts(matrix.layers[layer])

    def slabs(df, kinds: dict):
        held: list[tuple] = []
        for row in df.select(*kinds).toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == batch:
                yield [np.array(c, k) for c, k in zip(zip(*held), kinds.values())]
                held = []
        if held:
            yield [np.array(c, k) for c, k in zip(zip(*held), kinds.values())]

    with h5py.File(path, "w") as f:
        g = f.create_group("matrix")
        fts = g.create_group("features")
        text = lambda df, c, key: np.array([(r[0] or "").encode("ascii", "ignore") for r in df.orderBy(key).select(c).toLocalIterator()], dtype="S")
        g.create_dataset("barcodes", data=text(matrix.barcodes, "barcode", "bc_id"))
        for name, c in (("id", "id_feature"), ("name", "feature"), ("feature_type", "feature_type")):
            fts.create_dataset(name, data=text(matrix.features, c, "ft_id"))
        n_ft, n_bc = matrix.features.count(), matrix.barcodes.count()
        fts.create_dataset("genome", data=np.array([genome.encode()] * n_ft, dtype="S"))
        g.create_dataset("shape", data=np.array([n_ft, n_bc], "i8"))
        pointers = [x[0] for x in slabs(layout.indptr(records, matrix.barcodes, "bc_id").orderBy("position"), {"pointer": "i8"})]
        g.create_dataset("indptr", data=np.concatenate(pointers))
        n, at = int(pointers[-1][-1]), 0
        data, indices = g.create_dataset("data", (n,), "i8"), g.create_dataset("indices", (n,), "i8")
        for values, ids in slabs(layout.ordered(records, by_feature=False), {"value": "i8", "ft_id": "i8"}):
            data[at : at + len(ids)], indices[at : at + len(ids)] = values, ids
            at += len(ids)


def remote(path: Column) -> Column:
    from ..functions.strings import is_remote_url

    return is_remote_url(path)
