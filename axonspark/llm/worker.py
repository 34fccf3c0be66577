"""Memory of Python workers, which live on from one operator's tasks to the next's."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_caches: dict[str, Callable[[], None]] = {}
_now: list[str] = [""]


def holds(owner: str, clear: Callable[[], None]) -> None:
    """``owner`` keeps something between its tasks, which ``clear`` lets go."""
    _caches[owner] = clear


def begin(owner: str) -> None:
    """A task of ``owner`` starts: what other operators have kept in this worker goes, and free memory goes back to the system."""
    if _now[0] != owner:
        _now[0] = owner
        for name, clear in _caches.items():
            if name != owner:
                clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
