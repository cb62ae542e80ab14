"""Python workers live on from task to task: what a task freed goes back to the system at its end."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def trim() -> None:
    """Gives freed memory back; does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    call = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if call is not None:
        call(0)


def trimmed(task):
    """A task over batches (an iterator) or over one group that trims when it ends."""

    def run(batches):
        out = task(batches)
        if isinstance(out, pa.Table):
            trim()
            return out

        def rows():
            try:
                yield from out
            finally:
                trim()

        return rows()

    return run
