"""Immutable snapshots: a stage's output under a name that its inputs and settings give, checked when it is read."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sinks.collections import exists, list_files, move, read_text, remove, write_text


def digest(value) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Snapshot:
    stage: str
    scope: str
    name: str
    path: str
    signature: dict = field(hash=False)


class Store:
    """Snapshots below a folder that driver and executors share.

    A snapshot's name is its stage and the digest of its signature: stage, scope, settings, names of inputs, version of
    the code. It is built beside its place and moved there whole, so a name that is there is complete.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def signature(self, stage: str, scope: str, settings: dict, inputs: list[str], code: str, nonce: str | None = None) -> dict:
        return {"stage": stage, "scope": scope, "settings": settings, "inputs": sorted(inputs), "code": code} | ({"nonce": nonce} if nonce else {})

    def _place(self, signature: dict) -> Snapshot:
        name = f"{signature['stage']}-{digest(signature)[:32]}"
        return Snapshot(signature["stage"], signature["scope"], name, f"{self.root}/{name}", signature)

    def build(self, stage: str, scope: str, settings: dict, inputs: list[str], code: str, make: Callable[[], DataFrame], nonce: str | None = None) -> Snapshot:
        """The snapshot, made only if it is not there; inputs are checked before and after."""
        s = self._place(self.signature(stage, scope, settings, inputs, code, nonce))
        if exists(self.spark, s.path):
            return self.load(s.name)
        for i in inputs:
            self.load(i)
        work = f"{s.path}.work"
        remove(self.spark, work)
        make().write.parquet(f"{work}/data")
        for i in inputs:
            self.load(i)
        manifest = {"signature": s.signature, "files": self._files(f"{work}/data"), "records": self.spark.read.parquet(f"{work}/data").count()}
        write_text(self.spark, f"{work}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
        move(self.spark, work, s.path)
        return s

    def _files(self, folder: str) -> dict[str, str]:
        """Digests of the folder's files, made where the files are read."""
        files = self.spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("h")).collect()  # a row a file
        return {r["path"].rpartition("/")[2]: r["h"] for r in sorted(files)}

    def load(self, name: str) -> Snapshot:
        """The snapshot if its manifest fits its name and its files fit the manifest; an error otherwise."""
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"no name of a snapshot: {name}")
        path = f"{self.root}/{name}"
        manifest = json.loads(read_text(self.spark, f"{path}/manifest.json"))
        s = self._place(manifest["signature"])
        if s.name != name:
            raise ValueError(f"{name} was made from something else")
        if self._files(f"{path}/data") != manifest["files"]:
            raise ValueError(f"{name} has been changed")
        return s

    def verify(self, name: str) -> None:
        """The snapshot and all that it was made from."""
        for i in self.load(name).signature["inputs"]:
            self.verify(i)

    def reuse(self, name: str, stage: str, scope: str, settings: dict, inputs: list[str], code: str) -> Snapshot:
        """The named snapshot, if it is exactly what would be built now."""
        s = self.load(name)
        wanted = self.signature(stage, scope, settings, inputs, code)
        if {k: v for k, v in s.signature.items() if k != "nonce"} != wanted:
            raise ValueError(f"{name} was made from other inputs or settings")
        return s

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.load(name).path}/data")

    def publish(self, reference: str, snapshots: list[Snapshot]) -> None:
        """A reference to one snapshot of each stage and scope; all of them are verified before."""
        scopes = [(s.stage, s.scope) for s in snapshots]
        if not snapshots or len(set(scopes)) != len(scopes):
            raise ValueError("one snapshot of each stage and scope")
        for s in snapshots:
            self.verify(s.name)
        write_text(self.spark, f"{self.root}/refs/{reference}.json", json.dumps({"snapshots": {f"{s.stage}/{s.scope}": s.name for s in snapshots}}, indent=2, sort_keys=True))

    def published(self, reference: str) -> dict[str, str]:
        return json.loads(read_text(self.spark, f"{self.root}/refs/{reference}.json"))["snapshots"]

    def names(self) -> list[str]:
        return [p.rpartition("/")[2] for p in list_files(self.spark, self.root, "*-*") if not p.endswith((".work", ".old"))]
