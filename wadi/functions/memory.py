"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Gives memory that a task has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
