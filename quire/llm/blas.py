"""One thread of linear algebra per task: Spark runs a task per core already."""

from __future__ import annotations

import ctypes
from functools import cache
from pathlib import Path

import numpy as np


@cache
def one_thread() -> bool:
    """Tells the library that numpy brings along to use one thread in this process; False where it is another one."""
    done = False
    for path in [*Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"), *Path(np.__file__).parent.glob(".libs/*openblas*")]:
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                done = True
    return done
