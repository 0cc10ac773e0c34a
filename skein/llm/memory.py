"""Python workers outlive their tasks; what a task has freed should go back to the machine."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(results: Iterator) -> Iterator:
    """``results``, then memory given back."""
    try:
        yield from results
    finally:
        release()
