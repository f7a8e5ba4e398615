"""Figures of a run, observed on the frames that it stores anyway, without jobs of their own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation

_notes: ContextVar[list[tuple[str, Observation]] | None] = ContextVar("notes", default=None)


@contextmanager
def collected() -> Iterator[list[tuple[str, Observation]]]:
    """While this lasts, `note` observes; the list has what was noted, in order."""
    found: list[tuple[str, Observation]] = []
    token = _notes.set(found)
    try:
        yield found
    finally:
        _notes.reset(token)


def note(df: DataFrame, name: str, *figures: Column) -> DataFrame:
    """df, observed under that name where figures are collected; it must be stored next, as figures come with its first action."""
    found = _notes.get()
    if found is None:
        return df
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    found.append((name, seen))
    return df.observe(seen, *figures)


def values(found: list[tuple[str, Observation]]) -> dict[str, list[dict]]:
    """Of each name the figures of every time that it was noted."""
    out: dict[str, list[dict]] = {}
    for name, seen in found:
        out.setdefault(name, []).append(seen.get)
    return out
