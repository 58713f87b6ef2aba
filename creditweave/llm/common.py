"""Shared helpers: durable intermediates, Arrow text batches, bounded sampling."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Text bytes that one vectorised step looks at; bounds a Python worker's memory.
SLICE_BYTES = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # nothing reads this job's shuffle files once its result is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(df: DataFrame) -> None:
    """Removes what durable() wrote, once nothing reads it any more."""
    path = getattr(df, "_folder", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod; a null column gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def bounded(df: DataFrame, key: str, rows: int, salt: int = 7) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of key, so the same rows at any partitioning."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 20)) < int((1 << 20) * rows / total))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `limit` bytes, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list column from flat int64 values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def add_columns(df: DataFrame, make, added: list[tuple[str, str]], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """df's columns (only `keep`, if given) and the `added` (name, type) ones, computed a batch at a time.

    make() gives, once a task, a function of (bytes, row offsets) that returns a list of arrays. A column of df
    with the name of an added one is replaced. Nulls in `text` reach the function as empty rows."""
    names = [c for c in (df.columns if keep is None else keep) if c not in {n for n, _ in added}]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *(f"`{n}` {t}" for n, t in added)])
    place = names.index(text) if text in names else len(names)

    def run(batches):
        of = make()
        for batch in batches:
            buf, off = utf8(batch.column(place))
            for a, b in slices(off):
                got = of(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), *map(pa.array, got)], names=[*names, *(n for n, _ in added)])

    return df.select(*(F.col(f"`{c}`") for c in names), *([] if text in names else [F.col(text)])).mapInArrow(run, schema)
