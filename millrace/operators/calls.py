"""Calls of an outside service from tasks: a bounded pool, retries with growing pauses, results in row order."""

from __future__ import annotations

import random
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retried(f: Callable, attempts: int = 8, base: float = 2.0, first: float = 1.0, jitter: bool = True, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``f`` called again after an error, each time after a pause ``base`` times as long; the last error is raised."""

    def call(x):
        pause = first
        for k in range(attempts):
            try:
                return f(x)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(pause * (1 + random.random() * jitter))
                pause *= base

    return call


def remembered(f: Callable, capacity: int, uses: int) -> Callable:
    """``f`` with its last ``capacity`` distinct results; the one used longest ago goes first, and one given ``uses`` times is fetched anew.

    Each task has its own memory.  Threads may fetch the same value at once.  Errors are not kept.
    """
    if capacity < 1 or uses < 1:
        raise ValueError(f"capacity {capacity} and uses {uses} must be at least 1")
    kept: OrderedDict = OrderedDict()

    def call(x):
        value, left = kept.pop(x, (None, 0))
        if not left:
            value, left = f(x), uses
        kept[x] = (value, left - 1)
        while len(kept) > capacity:
            kept.popitem(last=False)
        return value

    return call


def called(df: DataFrame, column: str, f: Callable[[str], str], out: str = "reply", workers: int = 8) -> DataFrame:
    """``df`` with ``out``: ``f`` of the column, ``workers`` calls of a task at once; null where a call fails for good.

    Calls may be repeated when a task is, so ``f`` should bear that.
    """

    def one(x):
        try:
            return f(x)
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                yield b.assign(**{out: list(pool.map(one, b[column]))})

    return df.mapInPandas(run, df.withColumn(out, F.lit(None).cast("string")).schema)
