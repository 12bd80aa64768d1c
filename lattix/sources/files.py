"""Files and folders wherever Hadoop reaches (local, hdfs, s3a and others): operations, archives, objects, locks, web addresses.

Spark's own readers and writers move the data; these are for the few files around it, and run on the driver.
"""

from __future__ import annotations

import importlib.metadata
import io
import pickle
import subprocess
import tarfile
import time
import urllib.error
import urllib.request
import uuid

from pyspark.sql import DataFrame, SparkSession


def hadoop(url: str) -> str:
    """The address as Hadoop knows it."""
    return "s3a://" + url[5:] if url.startswith("s3://") else url


def place(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(hadoop(path))
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Of a web address, whether it answers."""
    if path.startswith(("http://", "https://")):
        return http_status(path) == 200
    p, fs = place(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = place(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str, recursive: bool = True) -> bool:
    """Whether there was something to remove."""
    p, fs = place(spark, path)
    return fs.delete(p, recursive)


def make_folder(spark: SparkSession, path: str) -> bool:
    p, fs = place(spark, path)
    return fs.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str, move: bool = False) -> bool:
    """A file, or a folder with all that is in it, to another place, of another file system too."""
    (a, from_), (b, to) = place(spark, source), place(spark, target)
    if move and from_.getUri().equals(to.getUri()):
        return from_.rename(a, b)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_, a, to, b, move, spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, source: str, target: str) -> bool:
    return copy(spark, source, target, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    p, fs = place(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of every file."""
    p, fs = place(spark, path)
    root, out, it = fs.getFileStatus(p).getPath().toString(), [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        out.append((s.getPath().toString().removeprefix(root).lstrip("/"), s.getLen()))
    return sorted(out)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(hadoop(path)).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row[0])


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    p, fs = place(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_object(spark: SparkSession, path: str, value) -> None:
    write_bytes(spark, path, pickle.dumps(value))


def read_object(spark: SparkSession, path: str):
    """What write_object() wrote. Pickles run code: read only your own."""
    return pickle.loads(read_bytes(spark, path))


def archive(spark: SparkSession, folder: str, target: str) -> None:
    """A folder as one tar.gz, the folder's own name leading; for folders that the driver can hold."""
    name = folder.rstrip("/").rpartition("/")[2]
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        for path, size in files_below(spark, folder):
            info = tarfile.TarInfo(f"{name}/{path}")
            info.size = size
            tar.addfile(info, io.BytesIO(read_bytes(spark, f"{folder.rstrip('/')}/{path}")))
    write_bytes(spark, target, data.getvalue())


def unpack(spark: SparkSession, source: str, folder: str) -> list[str]:
    """A tar.gz's files below a folder; names that lead out of it are refused."""
    out = []
    with tarfile.open(fileobj=io.BytesIO(read_bytes(spark, source)), mode="r:gz") as tar:
        for info in tar:
            if not info.isfile():
                continue
            if info.name.startswith("/") or ".." in info.name.split("/"):
                raise ValueError(f"{info.name} leads out of the folder")
            write_bytes(spark, f"{folder.rstrip('/')}/{info.name}", tar.extractfile(info).read())
            out.append(info.name)
    return sorted(out)


def copy_dataset(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """A written data set's tables, copied by the executors, and the rows of each; an error where a copy has other counts."""
    out = {}
    folders = {path.rpartition("/")[0] for path, _ in files_below(spark, source) if path.endswith(".parquet")}
    for folder in sorted(folders):
        spark.read.parquet(hadoop(f"{source}/{folder}")).write.mode("overwrite").parquet(hadoop(f"{target}/{folder}"))
        n, m = (spark.read.parquet(hadoop(f"{x}/{folder}")).count() for x in (source, target))
        if n != m:
            raise RuntimeError(f"{folder}: {m} rows of {n} copied")
        out[folder] = n
    return out


def http_status(url: str, timeout: float = 10.0) -> int | None:
    """The status that the address answers with; None where nothing answers."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code
    except (urllib.error.URLError, OSError, ValueError):
        return None


def download(spark: SparkSession, url: str, target: str, timeout: float = 60.0) -> int:
    """The bytes of a web address, or of any file that Hadoop reads, at a path; their number."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(url, timeout=timeout) as r:
            data = r.read()
        write_bytes(spark, target, data)
        return len(data)
    copy(spark, url, target)
    p, fs = place(spark, target)
    return fs.getFileStatus(p).getLen()


def is_binary(stream) -> bool:
    """Whether an open stream gives bytes."""
    return "b" in stream.mode if isinstance(getattr(stream, "mode", None), str) else not isinstance(stream, io.TextIOBase)


def command(args: list[str], stdout: str | None = None, binary: bool = False) -> str | bytes:
    """What a command on the driver prints, also kept in a file where one is named; an error where it fails."""
    data = subprocess.run(args, check=True, capture_output=True).stdout
    if stdout:
        with open(stdout, "wb") as f:
            f.write(data)
    return data if binary else data.decode()


def packages(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(package, version) of what is installed, or of the packages named."""
    found = sorted({(d.metadata["Name"] or "", d.version or "") for d in importlib.metadata.distributions()})
    wanted = {n.lower() for n in names} if names is not None else None
    return spark.createDataFrame([f for f in found if wanted is None or f[0].lower() in wanted], "package string, version string")


def plain_number(x):
    """An array library's number as Python's own."""
    return x.item() if hasattr(x, "item") else x


class Lock:
    """A lock that is a file, held by one owner: made only where it isn't there, read again after a moment, re-entrant."""

    def __init__(self, spark: SparkSession, path: str, wait: float = 0.1, fail: bool = False):
        self.spark, self.path, self.wait, self.fail = spark, f"{path.rstrip('/')}.lock", wait, fail
        self.owner, self.held = uuid.uuid4().hex, 0

    def taken(self) -> bool:
        return exists(self.spark, self.path)

    def _mine(self) -> bool:
        try:
            return read_bytes(self.spark, self.path) == self.owner.encode()
        except Exception:  # gone meanwhile
            return False

    def acquire(self, timeout: float = 60.0) -> None:
        if self.held:
            self.held += 1
            return
        until = time.monotonic() + timeout
        while True:
            if not self.taken():
                try:
                    write_bytes(self.spark, self.path, self.owner.encode(), overwrite=False)
                except Exception as e:  # made by another owner between both calls
                    if not self.taken():
                        raise e
                time.sleep(self.wait)
                if self._mine():
                    self.held = 1
                    return
            if self.fail or time.monotonic() > until:
                raise TimeoutError(f"{self.path} is held")
            time.sleep(self.wait)

    def release(self) -> None:
        self.held = max(0, self.held - 1)
        if not self.held and self._mine():
            remove(self.spark, self.path)

    def __enter__(self) -> Lock:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
