"""What a Python worker holds from one task for the next.

Workers outlive the stages of a pipeline, and a task that only shuffles still has
them beside it.  Caches (words, vocabularies, automata) are kept for further tasks
of one operator and go when another one takes the worker; freed memory goes back
to the system at the end of every task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_CLEAR: dict[str, Callable[[], None]] = {}


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Names a cache of this worker."""
    _CLEAR[name] = clear


def _give_back() -> None:
    """Returns what Arrow and, where it is glibc, the C library have kept of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which finds the named caches only."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, clear in _CLEAR.items():
            if name not in names:
                clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return only
