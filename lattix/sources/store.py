"""A written layer with a shape, attributes and a lock: opened to read or to write, selected from and written into by positions.

The records are Parquet; what is written later is a table of changes, of which the last stands (see filtering.overlaid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filtering
from ..operators.extras import KeyValues
from . import files


class Store:
    """Records (ft_id, bc_id, value) at a path; absent ones are the fill value. Mode r reads, a writes too, w begins anew."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "r", shape: tuple[int, int] | None = None, fill=0, lock: bool = True):
        self.spark, self.lock_wanted, self.at = spark, lock, None
        self.open(path, mode, shape, fill)

    def open(self, path: str, mode: str = "r", shape: tuple[int, int] | None = None, fill=0, reload: bool = False) -> Store:
        """Nothing happens where the same path is open in the same mode."""
        if self.at == (path, mode) and not reload:
            return self
        self.path, self.mode, self.at = path.rstrip("/"), mode, (path, mode)
        self.lock = files.Lock(self.spark, self.path) if self.lock_wanted else None
        self.attributes = KeyValues(self.spark, f"{self.path}/attributes")
        if mode == "w":
            files.remove(self.spark, self.path)
            self.set_attrs(shape=list(shape or (0, 0)), fill=fill, version=0)
        elif not files.exists(self.spark, f"{self.path}/attributes"):
            raise FileNotFoundError(path)
        return self

    @property
    def shape(self) -> tuple[int, int]:
        return tuple(self.get_attr("shape"))

    def get_attrs(self, *keys: str) -> dict:
        """Of the attributes asked for, or all, those that there are."""
        return self.attributes.all(list(keys) or None)

    def get_attr(self, key: str):
        got = self.attributes.all([key])
        if key not in got:
            raise KeyError(key)
        return got[key]

    def set_attrs(self, **values) -> None:
        self._writable()
        for k, v in values.items():
            self.attributes[k] = v

    def get_or_set(self, key: str, value):
        got = self.attributes.all([key])
        if key not in got:
            self.set_attrs(**{key: value})
        return got.get(key, value)

    def _writable(self) -> None:
        if self.mode == "r":
            raise PermissionError(f"{self.path} is open to be read")

    def records(self) -> DataFrame:
        version = self.get_attr("version")
        if not version:
            return self.spark.createDataFrame([], "ft_id long, bc_id long, value double")
        n, m = self.shape
        return filtering.resized(self.spark.read.parquet(f"{self.path}/records/{version}"), n, m)

    def write(self, records: DataFrame) -> None:
        """Records in place of those at the same positions. A new version is written whole, and named when it is done, so a reader or a failed writer never meets half of one."""
        self._writable()
        if self.lock:
            self.lock.acquire()
        try:
            version = self.get_attr("version")
            new = records.select("ft_id", "bc_id", F.col("value").cast("double").alias("value"))
            out = filtering.overlaid(self.records(), new) if version else new
            out.repartitionByRange("bc_id").sortWithinPartitions("bc_id", "ft_id").write.mode("overwrite").parquet(f"{self.path}/records/{version + 1}")
            self.set_attrs(version=version + 1)
            if version:
                files.remove(self.spark, f"{self.path}/records/{version}")
        finally:
            if self.lock:
                self.lock.release()

    def basic(self, features: slice = slice(None), barcodes: slice = slice(None)) -> DataFrame:
        n, m = self.shape
        cond = lambda c, s, length: filtering.sliced(F.col(c), s.start, s.stop, s.step or 1, length)
        return self.records().where(cond("ft_id", features, n) & cond("bc_id", barcodes, m))

    def orthogonal(self, features: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
        return filtering.orthogonal(self.records(), barcodes, features)

    def at_points(self, points: DataFrame) -> DataFrame:
        return filtering.at_points(self.records(), points, self.get_attr("fill"))

    def resize(self, features: int, barcodes: int) -> None:
        self.set_attrs(shape=[features, barcodes])
