"""One BLAS thread for many small products: more threads only wait for each other."""

from __future__ import annotations

import ctypes
import glob
import os
from contextlib import contextmanager

import numpy as np


def _calls():
    """Getter and setter of the thread count of the OpenBLAS that numpy's wheel brings, or None."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(lib, name.format("set")):
                return getattr(lib, name.format("get")), getattr(lib, name.format("set"))
    return None


@contextmanager
def one_thread():
    calls = _calls()
    before = calls[0]() if calls else 0
    if calls:
        calls[1](1)
    try:
        yield
    finally:
        if calls:
            calls[1](before)
