"""Timed passes over a query, and the same in a fresh process."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from collections.abc import Callable
from statistics import median
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free digest of them: equal results of two passes have equal digests."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return row.n, str(row.h)


def passes(query: Callable[[], DataFrame], measured: int = 3, warm: int = 1) -> dict[str, Any]:
    """Seconds of ``measured`` passes after ``warm`` ones outside the window; a result that changes between passes is an error."""
    if measured < 1 or warm < 0:
        raise ValueError("there must be a measured pass")
    seconds, seen = [], set()
    for k in range(warm + measured):
        start = time.perf_counter()
        seen.add(content_hash(query()))
        if k >= warm:
            seconds.append(time.perf_counter() - start)
    if len(seen) != 1:
        raise RuntimeError("the result changed between passes")
    rows, digest = seen.pop()
    return {"rows": rows, "digest": digest, "seconds": seconds, "median": median(seconds), "least": min(seconds), "greatest": max(seconds)}


def fresh_process(code: str, timeout: float = 600) -> dict[str, Any]:
    """Run Python code that prints one JSON object in a process of its own; its wall time is added as ``process_seconds``."""
    start = time.perf_counter()
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(f"the fresh process failed: {done.stderr[-500:]}")
    return json.loads(done.stdout.strip().splitlines()[-1]) | {"process_seconds": time.perf_counter() - start}
