"""Resumable work on streams of documents: journals, cursors, idempotent writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sinks import exports
from textloom.sinks.collections import exists, read_text, write_text


class Journal:
    """An append-only log of documents in numbered batches, bound to one identity.

    A batch is a folder of Parquet with a line in the log that has its number, rows and checksum. What was written
    after the last line (a torn tail) does not count and is written again.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        head = f"{self.folder}/identity.json"
        if exists(spark, head):
            if json.loads(read_text(spark, head))["identity"] != identity:
                raise ValueError("the journal belongs to something else")
        else:
            write_text(spark, head, json.dumps({"identity": identity}))

    def _line(self, n: int) -> str:
        return f"{self.folder}/log/{n:010}.json"

    def batches(self) -> int:
        n = 0
        while exists(self.spark, self._line(n)):
            n += 1
        return n

    @staticmethod
    def _checksum(rows: DataFrame) -> dict:
        h = F.xxhash64(*rows.columns).cast("decimal(38,0)")
        r = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("sum")).first()
        return r.asDict()

    def append(self, rows: DataFrame) -> int:
        """The batch's number; it counts from the moment its line is there."""
        n = self.batches()
        path = f"{self.folder}/data/{n:010}"
        rows.write.mode("overwrite").parquet(path)
        write_text(self.spark, self._line(n), json.dumps({"batch": n} | self._checksum(self.spark.read.parquet(path))))
        return n

    def read(self) -> DataFrame | None:
        """All batches that count, each checked; None while there are none."""
        out = None
        for n in range(self.batches()):
            rows = self.spark.read.parquet(f"{self.folder}/data/{n:010}")
            line = json.loads(read_text(self.spark, self._line(n)))
            if {k: line[k] for k in ("rows", "sum")} != self._checksum(rows):
                raise ValueError(f"batch {n} has been changed")
            out = rows if out is None else out.unionByName(rows)
        return out


class Cursor:
    """How far an output is: next document, documents and chunks so far, whether it is complete."""

    def __init__(self, spark: SparkSession, path: str, identity: str):
        self.spark, self.path, self.identity = spark, path, identity

    def load(self) -> dict:
        if not exists(self.spark, self.path):
            return {"next": 0, "documents": 0, "chunks": 0, "complete": False}
        state = json.loads(read_text(self.spark, self.path))
        if state.pop("identity") != self.identity:
            raise ValueError("the cursor belongs to something else")
        return state

    def save(self, **state) -> None:
        write_text(self.spark, self.path, json.dumps({"identity": self.identity} | state))

    def check(self, stored: int) -> None:
        """An error if the store has fewer chunks than were written to it."""
        if stored < self.load()["chunks"]:
            raise ValueError("vectors were lost; start anew")


def upsert_stream(points: DataFrame, path: str, checkpoint: str, key: str = "point_id") -> StreamingQuery:
    """A stream of points into a Parquet table by key: a batch that comes again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            exports.upsert(batch, path, key)

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_points(points: DataFrame, time: str, key: str = "point_id", late: str = "1 day") -> DataFrame:
    """Each point once, also over batches and reruns of a stream."""
    return points.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
