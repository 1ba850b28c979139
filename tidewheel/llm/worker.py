"""What a Python worker keeps between tasks: the vocabulary and cache of one operator at a time.

Workers outlive stages, so without this every operator's cache would stay in each of them until the end of the job, as
would free memory that the allocators hold on to: later stages that run in the JVM alone would share the executor with it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_KEPT: dict[Hashable, object] = {}
SLICE = 256


def keep(key: Hashable, make: Callable[[], T]) -> T:
    """The object made for ``key`` in this process; asking for another key lets go of it."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def _trim() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back() -> None:
    """Hand the free memory of Arrow's and the C library's allocators back to the system."""
    _trim()


def let_go() -> None:
    """Drop the cache that is kept, if any, and hand back what it took."""
    if _KEPT:
        _KEPT.clear()
        _trim()


def strings(column, most: int = SLICE):
    """The values of an Arrow column, of which ``most`` are Python objects at a time."""
    for at in range(0, len(column), most):
        yield from column.slice(at, most).to_pylist()


def tidy(task: Callable, last: bool = False) -> Callable:
    """A task over batches that starts without other operators' caches and leaves no free memory behind; ``last``: nor its own cache."""

    def run(batches):
        let_go()
        yield from task(batches)
        if last:
            _KEPT.clear()
        give_back()

    return run
