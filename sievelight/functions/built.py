"""Expressions that are costly to put together, kept for the life of the Spark gateway."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")
_KEPT: dict[tuple, object] = {}


def once(key: Hashable, build: Callable[[], T]) -> T:
    """`build()`, made once per key; for expressions that depend on column names only."""
    full = (id(SparkContext._gateway), key)
    if full not in _KEPT:
        _KEPT[full] = build()
    return _KEPT[full]  # type: ignore[return-value]
