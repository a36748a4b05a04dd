"""Arrow batches of bounded size, and objects that a Python worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from linkwell.batches import BYTES, KEY, ROWS, ROWS_KEY, bounded

__all__ = ["BYTES", "KEY", "ROWS", "ROWS_KEY", "bounded", "kept"]

T = TypeVar("T")
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], T]) -> T:
    """An object of this worker process, made once for each key.  Only the newest is kept, so tables don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
