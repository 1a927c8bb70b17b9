"""A clock for one message inside a row function."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle

# Executors need not have this package installed: the helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Overdue(Exception):
    """A message took longer than it may."""


class Deadline:
    """Time since now, and a limit in seconds that `check` holds to; without a limit it only measures.

    A function is not interrupted: it asks between steps, so a cut message costs its limit and one step.
    """

    def __init__(self, limit_s: float | None = None) -> None:
        self.limit_s = limit_s
        self._started = time.monotonic()

    def elapsed_ms(self) -> int:
        return max(0, round((time.monotonic() - self._started) * 1000))

    def check(self) -> None:
        if self.limit_s is not None and time.monotonic() - self._started > self.limit_s:
            raise Overdue(f"timeout after {self.limit_s:g}s")


#: Rows, and bytes of theirs, whose records are held as Python objects at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 64, 1 << 20


def records(values: pa.Array, make: Callable[[pa.Scalar], dict | None], kind: pa.DataType) -> pa.Array:
    """What `make` gives for each value, turned into Arrow a few rows at a time: records of Python objects are many times their size."""
    done, held, size = [], [], 0
    for value in values:
        held.append(make(value))
        size += value.as_buffer().size if value.is_valid else 0
        if len(held) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            done.append(pa.array(held, type=kind))
            held, size = [], 0
    return pa.concat_arrays([*done, pa.array(held, type=kind)])


def timed(read, value, limit_s: float | None) -> dict | None:
    """What `read` makes of a value, with the time that it took in `elapsed_ms`."""
    clock = Deadline()
    record = read(value, limit_s)
    return None if record is None else record | {"elapsed_ms": clock.elapsed_ms()}
