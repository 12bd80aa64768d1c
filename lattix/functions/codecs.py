"""Byte codecs. base64 is built in; gzip is not, and runs in Arrow batches."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_base64(x: Column) -> Column:
    return F.base64(x)


def from_base64(x: Column) -> Column:
    return F.unbase64(x)


@F.pandas_udf(T.BinaryType())
def gzipped(x: pd.Series) -> pd.Series:
    return x.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))


@F.pandas_udf(T.BinaryType())
def gunzipped(x: pd.Series) -> pd.Series:
    return x.map(lambda b: None if b is None else gzip.decompress(bytes(b)))
