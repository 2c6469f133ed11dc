"""Memory of Python workers. They are kept between tasks, and what the allocators hold on to counts against the executor."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def tidy() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, whose free memory is its own affair
        pass


def tidied(run: Callable) -> Callable:
    """A function of one argument that tidies up behind itself."""

    @functools.wraps(run)
    def out(x):
        try:
            return run(x)
        finally:
            tidy()

    return out


def tidied_stream(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same of a function from batches to batches, at its end."""

    @functools.wraps(run)
    def out(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return out
