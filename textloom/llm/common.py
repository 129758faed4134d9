"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on a local master that names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def size_in_bytes(df: DataFrame) -> int:
    """The plan's estimate, or where Spark has none (behind a join or an RDD) the columns' bytes, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= 1 << 50:
        return size
    wide = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)).cast("long") for n, t in df.dtypes if t in ("string", "binary")]
    return int(df.agg(F.sum(sum(wide, F.lit(8 * len(df.columns)).cast("long")))).first()[0] or 0)


def partitions(df: DataFrame, bytes_each: int = 32 << 20, size: int | None = None) -> int:
    """Shuffle partitions for ``df``: the session's number, more if its size asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(size_in_bytes(df) if size is None else size) // bytes_each))


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidy() -> None:
    """Gives memory that is free back to the system: a worker is used again, by tasks of other stages too."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string or binary Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    wide = column.cast(pa.large_binary())
    n = len(wide)
    null = np.asarray(wide.is_null().to_numpy(zero_copy_only=False), bool)
    if null.any():
        wide = pa.compute.fill_null(wide, b"")
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, off, data = wide.buffers()
    offsets = np.frombuffer(off, np.int64)[wide.offset : wide.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], null


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least, so that temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def codepoints(raw: bytes) -> np.ndarray:
    """UTF-8 as code points; a byte that is not UTF-8 becomes U+DC80 to U+DCFF, of one byte."""
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: uniform bits from any integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def documents_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that further columns, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
