"""What a worker process remembers between its tasks: what the operator at work needs, and no other's.

Spark reuses worker processes, so one operator's tables, and the memory that its allocators keep for later,
would otherwise stay while the next ones run.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa

_kept: dict[tuple, object] = {}


def give_back() -> None:
    """Return what the allocators hold unused to the system, where they can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def remembered(key: tuple, make: Callable):
    """What was made under this key in this process, or make() in place of all that was kept before."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """For operators that need memory and keep nothing."""
    _kept.clear()
    give_back()
