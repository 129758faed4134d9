"""Settings of the stages, with their defaults and bounds."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Knob:
    """A setting: default, bounds, and what it means."""

    default: float | int | str | None
    least: float | None = None
    most: float | None = None
    meaning: str = ""


#: Knobs by stage.
KNOBS: dict[str, dict[str, Knob]] = {
    "harvest": {
        "max_captures_per_page": Knob(1, 0, None, "captures of a page and phase that stay; 0: all"), "max_seeds": Knob(None, 1, None, "seeds of a collection"),
        "request_interval": Knob(2.0, 0.5, 60, "seconds between requests, at least"), "max_failed_fraction": Knob(0.1, 0, 1, "of visited seeds"),
    },
    "normalize": {"captures_per_url": Knob(1, 1, None, "earliest captures of a page and phase"), "min_documents": Knob(1, 0, None, "fetched documents"), "max_failed_fraction": Knob(0.2, 0, 1, "of all documents")},
    "dedupe": {"threshold": Knob(0.9, 0, 1, "similarity of near copies; 1: equal texts only"), "max_docs": Knob(None, 1, None, "documents of a collection")},
    "embed": {"words_each": Knob(128, 8, None, "words of a chunk"), "dims": Knob(64, 2, None, "of a vector"), "batch": Knob(256, 1, None, "chunks written at once")},
    "georef": {"language": Knob("en", None, None, "of the documents")},
    "semantic": {"min_words": Knob(8, 1, None, "words of a chunk"), "min_chunks": Knob(20, 2, None, "of a period and tier"), "min_reference": Knob(3, 1, None, "authoritative chunks")},
    "topics": {"threshold": Knob(0.45, 0, 1, "similarity of linked topics"), "shift": Knob(0.35, 0, 1, "divergence of a shift"), "min_docs": Knob(50, 1, None, "documents of a window"), "min_topic_size": Knob(20, 2, None, "chunks of a topic"), "max_tracks": Knob(12, 1, None, "lineages shown")},
}


def settings(stage: str, **given) -> dict:
    """A stage's settings: defaults with what is given, each checked."""
    knobs = KNOBS[stage]
    if unknown := set(given) - set(knobs):
        raise ValueError(f"{stage} has no {sorted(unknown)}")
    out = {k: given.get(k, v.default) for k, v in knobs.items()}
    for k, v in out.items():
        knob = knobs[k]
        if v is None or isinstance(v, str):
            continue
        if knob.least is not None and v < knob.least or knob.most is not None and v > knob.most:
            raise ValueError(f"{stage}.{k} = {v} is out of bounds")
    return out


def schema() -> list[dict]:
    """All knobs as rows, for a form or a manual."""
    return [{"stage": s, "name": k, **asdict(v)} for s, knobs in KNOBS.items() for k, v in knobs.items()]


