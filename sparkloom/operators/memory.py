"""Memory of Python workers: they are used again, and what they hold counts against the executor."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """What has been freed goes back to the machine, from Arrow's pool and from malloc's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_memory() -> None:
    """What is garbage or has been freed goes back to the machine."""
    gc.collect()
    give_back()


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``: what it has freed is given back before each batch and once its task is over.

    Else a worker keeps the most that any earlier step took, also while it waits.
    """

    def fed(batches: Batches) -> Batches:
        for batch in batches:
            give_back()
            yield batch

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(fed(batches))
        finally:
            give_back()

    return wrapped
