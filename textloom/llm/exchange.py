"""Rounds between chunks of documents and buckets of hashes, with packed columns as rows.

A corpus-wide question about many small items (is this hash in another document?) is asked in rounds:
every chunk of documents sends each bucket one packed row of its items, buckets answer every chunk that
asked with one packed row. A chunk sends an item once, however often it has it, so an item that a third
of all documents hold comes to its bucket once a chunk, never once a document; and there is no JVM row
for each item. A message has at least one item, so there are never more of them than items, and far fewer
while a chunk has more items than there are buckets. Rows go by Spark's shuffle and are cut by
checkpoints, so lost executors cost a rerun.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint_dir, partitions, size_in_bytes, slices, tidy, utf8_column


def pack(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays of numbers as compressed bytes, byte by byte of all values: bytes that are alike meet.

    Sorted unsigned integers are stored as differences.
    """
    out = io.BytesIO()
    for a in arrays:
        kind = a.dtype.str.encode()
        if a.dtype == np.uint64 and len(a) > 1 and (a[1:] >= a[:-1]).all():
            kind, a = b"+" + kind, np.diff(a, prepend=np.uint64(0))
        out.write(bytes([len(kind)]) + kind + len(a).to_bytes(8, "little"))
        out.write(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for _ in range(n):
        name = raw[at + 1 : at + 1 + raw[at]].decode()
        kind = np.dtype(name.lstrip("+"))
        at += 1 + raw[at]
        size = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at + 8).reshape(kind.itemsize, size)
        value = np.ascontiguousarray(planes.T).view(kind).reshape(size)
        out.append(np.cumsum(value, dtype=kind) if name[0] == "+" else value)
        at += 8 + size * kind.itemsize
    return out


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=3)
    for b in batches:
        raw, offsets, null = utf8_column(b.column(b.num_columns - 1))
        for i, j in slices(offsets, 4 << 20):
            at = offsets[i : j + 1].tolist()
            packed = [None if z else c.compress(raw[x:y].tobytes()) for x, y, z in zip(at[:-1], at[1:], null[i:j].tolist(), strict=True)]
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(packed, pa.binary())], names=part.schema.names)


def unsqueeze(column: pa.Array) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [b"" if x is None else d.decompress(x) for x in column.to_pylist()]


#: Bytes of a chunk in the table's files, about.
CHUNK_BYTES = 3 << 20
#: Tables made by this process: name -> folder.
_MADE: dict[str, str] = {}


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(chunks, buckets) for a table: buckets are as many as shuffle partitions, chunks are small enough for a worker."""
    size = size_in_bytes(docs)
    return partitions(docs, CHUNK_BYTES, size), partitions(docs, size=size)


def stored(rows: DataFrame, n: int) -> DataFrame:
    """The rows, with a column ``chunk``, written once to the shared folder as a table of n buckets by chunk.

    Rounds read it in place, without dealing the rows out again. release() drops it.
    """
    spark, name = rows.sparkSession, f"textloom_{uuid.uuid4().hex}"
    _MADE[name] = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    rows.repartition(n, "chunk").write.format("parquet").option("compression", "none").option("path", _MADE[name]).bucketBy(n, "chunk").saveAsTable(name)
    table = spark.table(name)
    table.__dict__["textloom_width"] = n
    return table


def width(table: DataFrame) -> int:
    """The number of buckets of a table that stored() made."""
    return table.__dict__["textloom_width"]


def made() -> set[str]:
    """The tables that stored() has made and release() has not dropped."""
    return set(_MADE)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, but: set[str] = frozenset()) -> None:
    """Drops the tables that operators have stored, and their folders, when all results that read them have been
    written; tables named in ``but`` stay."""
    for name in made() - but:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(spark, _MADE.pop(name))


def chunked(docs: DataFrame, chunks: int, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """(doc_id, row_id, rest, chunk, body): documents dealt to chunks by a hash of id and text, texts compressed.

    ``row_id`` tells rows of one document id apart. ``rest`` has all columns but the text if they are to be
    carried along. Ids are integers; one that is none counts as null.
    """
    n = partitions(docs)
    other = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text] if carry else []
    rest = F.struct(*other) if other else F.lit(None).cast("int")
    number = F.col(f"`{key}`").try_cast("long")
    own = docs.select(number.alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), rest.alias("rest"), F.col(f"`{text}`").cast("string").alias("body"))
    own = own.select("doc_id", "row_id", "rest", F.pmod(F.xxhash64("doc_id", "body"), F.lit(chunks)).cast("int").alias("chunk"), "body")
    packed = own.mapInArrow(_squeeze, f"doc_id long, row_id long, rest {dict(own.dtypes)['rest']}, chunk int, body binary")
    return stored(packed, n)


def restored(rows: DataFrame, docs: DataFrame, text: str, body: Column) -> DataFrame:
    """The columns of ``docs``, of rows whose ``rest`` was carried along, with a new text."""
    at = {c: f"rest.c{i}" for i, c in enumerate(docs.columns) if c != text}
    kinds = dict(docs.dtypes)
    return rows.select(*[(body if c == text else F.col(at[c])).cast(kinds[c]).alias(c) for c in docs.columns])


Messages = Iterator[tuple[int, bytes]]
MESSAGE = "to int, sender int, load binary"


def _ordered(rows: pa.Table) -> pa.Table:
    """In the order of row_id, so that a row's place in its chunk is the same in every round."""
    return rows.sort_by("row_id") if rows.num_rows else rows


def ask(chunks: DataFrame, emit: Callable[[int, pa.Table], Messages]) -> DataFrame:
    """(to, sender, load): what ``emit`` makes of every chunk's rows (in the order of row_id), addressed to buckets."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        sender = key[0].as_py()
        out = _rows(sender, emit(sender, _ordered(docs)))
        tidy()
        return out

    return chunks.groupBy("chunk").applyInArrow(run, MESSAGE)


def answer(messages: DataFrame, reduce: Callable[[int, list[tuple[int, bytes]]], Messages], buckets: int) -> DataFrame:
    """(to, sender, load): what ``reduce`` makes of the messages to every bucket, addressed to chunks.

    The buckets are dealt to as many tasks, so that a task does not grow with the table.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sender = key[0].as_py()
        got = sorted(zip(rows["sender"].to_pylist(), rows["load"].to_pylist(), strict=True))
        out = _rows(sender, reduce(sender, got))
        tidy()
        return out

    return messages.repartition(buckets, "to").groupBy("to").applyInArrow(run, MESSAGE)


def meet(chunks: DataFrame, messages: DataFrame, use: Callable[[int, pa.Table, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """What ``use`` makes of every chunk's rows (in the order of row_id) together with the messages to the chunk."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, rows: pa.Table) -> pa.Table:
        got = sorted(zip(rows["sender"].to_pylist(), rows["load"].to_pylist(), strict=True))
        out = use(key[0].as_py(), _ordered(docs), got)
        tidy()
        return out

    return chunks.groupBy("chunk").cogroup(messages.groupBy("to")).applyInArrow(run, schema)


def rows_of(sender: int, messages: Messages) -> pa.Table:
    return _rows(sender, messages)


def _rows(sender: int, messages: Messages) -> pa.Table:
    to, load = [], []
    for x, y in messages:
        to.append(x)
        load.append(y)
    return pa.table({"to": pa.array(to, pa.int32()), "sender": pa.array([sender] * len(to), pa.int32()), "load": pa.array(load, pa.binary())})


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Messages:
    """One message a bucket, of the columns' values that belong to it."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    ends = np.flatnonzero(np.diff(b)) + 1
    for i, j in zip(np.concatenate([[0], ends]).tolist(), np.concatenate([ends, [len(b)]]).tolist(), strict=True):
        if i < j:
            yield int(b[i]), pack(*(c[order[i:j]] for c in columns))



def gather(messages: DataFrame, reduce: Callable[[int, list[tuple[int, bytes]]], pa.Table], buckets: int, schema: str) -> DataFrame:
    """What ``reduce`` makes of the messages to every bucket, as rows: nothing is packed that the next step unpacks."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        got = sorted(zip(rows["sender"].to_pylist(), rows["load"].to_pylist(), strict=True))
        out = reduce(key[0].as_py(), got)
        tidy()
        return out

    return messages.repartition(buckets, "to").groupBy("to").applyInArrow(run, schema)
