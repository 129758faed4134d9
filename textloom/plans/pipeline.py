"""Runs of stages over collections: planned first, then built as snapshots, with a report of what was done.

A plan names the stages, their order, settings and code before anything runs; a stage's snapshot is reused where
all of that is the same.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import signal
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.config import settings
from textloom.sinks.collections import exists, read_text, write_text
from textloom.sinks.snapshots import Snapshot, Store

#: Stages of a corpus and of its analysis, with what each one needs.
CORPUS = {"harvest": (), "normalize": ("harvest",), "dedupe": ("normalize",), "embed": ("dedupe",)}
ANALYSIS = {"registry": (), "georef": ("dedupe",), "semantic": ("embed", "registry"), "topics": ("embed",)}

Work = Callable[..., DataFrame]


def order(stages: dict[str, tuple[str, ...]]) -> list[str]:
    """Stages so that each comes after what it needs; a circle is an error."""
    out: list[str] = []
    left = dict(stages)
    while left:
        ready = sorted(s for s, needs in left.items() if all(n in out or n not in stages for n in needs))
        if not ready:
            raise ValueError(f"stages need each other: {sorted(left)}")
        out += ready
        for s in ready:
            del left[s]
    return out


@dataclass(frozen=True)
class Step:
    stage: str
    scope: str
    settings: dict = field(hash=False)
    needs: tuple[str, ...] = ()
    code: str = ""


def plan(stages: dict[str, tuple[str, ...]], scopes: list[str], work: dict[str, Work], given: dict[str, dict] | None = None) -> list[Step]:
    """The steps of all scopes; settings are checked and the code is fixed here, before any input is read."""
    if missing := set(stages) - set(work):
        raise ValueError(f"no work for {sorted(missing)}")
    known = lambda s: settings(s, **(given or {}).get(s, {})) if s != "registry" else {}
    code = {s: hashlib.sha256(inspect.getsource(work[s]).encode()).hexdigest()[:16] for s in stages}
    return [Step(s, scope, known(s), stages[s], code[s]) for s in order(stages) for scope in scopes]


class Control:
    """A pause that is asked for (by a file, or by SIGTERM) and granted between steps."""

    def __init__(self, spark: SparkSession | None = None, flag: str | None = None):
        self.spark, self.flag, self.stopped = spark, flag, threading.Event()

    def install(self) -> None:
        signal.signal(signal.SIGTERM, lambda *_: self.stopped.set())

    def pause(self) -> None:
        write_text(self.spark, self.flag, "pause")

    def asked(self) -> bool:
        return self.stopped.is_set() or bool(self.flag and exists(self.spark, self.flag))


def estimate(elapsed: float, done: float, total: float, past: list[float] = ()) -> dict:
    """Seconds that are left, by progress and by the median of past runs, and the range of both."""
    guesses = []
    if 0 < done <= total:
        guesses.append(elapsed * (total - done) / done)
    if past:
        middle = sorted(past)[len(past) // 2]
        guesses += [max(0.0, middle - elapsed)]
    if not guesses:
        return {"left": None, "least": None, "most": None}
    return {"left": sum(guesses) / len(guesses), "least": min(guesses), "most": max(guesses)}


class Progress:
    """How far a step is, in a file beside its output; written at most every few seconds."""

    def __init__(self, spark: SparkSession, path: str, total: int, unit: str = "documents", every: float = 5.0):
        self.spark, self.path, self.total, self.unit, self.every = spark, path, total, unit, every
        self.began, self.told = time.time(), 0.0

    def tell(self, done: int, final: bool = False) -> None:
        now = time.time()
        if final or now - self.told >= self.every:
            self.told = now
            write_text(self.spark, self.path, json.dumps({"done": done, "total": self.total, "unit": self.unit, "seconds": now - self.began, "final": final} | estimate(now - self.began, done, self.total)))


def run(store: Store, steps: list[Step], work: dict[str, Work], control: Control | None = None) -> tuple[dict[tuple[str, str], Snapshot], list[dict]]:
    """Snapshots by stage and scope, and a record of each step; stops between steps when a pause is asked for."""
    made: dict[tuple[str, str], Snapshot] = {}
    told: list[dict] = []
    for s in steps:
        if control and control.asked():
            told.append({"stage": s.stage, "scope": s.scope, "status": "paused"})
            break
        inputs = [made[n, s.scope] for n in s.needs if (n, s.scope) in made]
        there, began = set(store.names()), time.time()
        snapshot = store.build(s.stage, s.scope, s.settings, [i.name for i in inputs], s.code, lambda s=s, inputs=inputs: work[s.stage](*[store.read(i.name) for i in inputs], **s.settings))
        made[s.stage, s.scope] = snapshot
        told.append({"stage": s.stage, "scope": s.scope, "status": "reused" if snapshot.name in there else "built", "snapshot": snapshot.name, "seconds": round(time.time() - began, 3), "records": json.loads(read_text(store.spark, f"{snapshot.path}/manifest.json"))["records"]})
    return made, told


def overview(told: list[dict]) -> tuple[str, str]:
    """A run's steps as JSON and as a Markdown table."""
    names = ("stage", "scope", "status", "records", "seconds", "snapshot")
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    lines += ["| " + " | ".join(str(t.get(n, "")) for n in names) + " |" for t in told]
    return json.dumps({"steps": told}, indent=2), "\n".join(lines)
