"""What the Python workers of an executor keep between tasks.

Workers are used again by later tasks of any operator, and there are more of them than cores once a stage has two Arrow steps.  Those
that wait count beside those that run, so none holds buffers of an ended task or what another operator has kept.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """The value that this worker keeps by ``key``, made where it has none; a worker keeps one value at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drops what is kept.  A function of the module: a step is pickled with copies of the variables that it names itself."""
    _kept.clear()


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library both hold it for the next task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` of a ``mapInArrow`` that leaves nothing behind in its worker; with ``keeps``, what it has :func:`kept` stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from step(batches)
        finally:
            if not keeps:
                forget()
            give_back()

    return run
