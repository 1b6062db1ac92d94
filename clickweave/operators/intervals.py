"""Intervals per key that are merged where they lie close to each other.

A row is an interval with totals of its own; a single event is one of no length. Merging is
associative and takes rows in any order: intervals merged before, of any part of the data, may be
merged again with others, and a late row may bridge two of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.operators.running import CHUNK_MS, Running, Scan, running_steps, time_chunk


def merge_intervals(
    rows: DataFrame, keys: list[str], start: str, end: str, apart: Callable[[Column], Column], totals: list[Column],
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """One row per ``keys`` and run of intervals, with ``start``, ``end`` and ``totals`` (aggregates). A run goes
    on until ``apart`` holds for the time between the latest end so far and the next start."""
    before, run = "__reach", "__run"
    first = F.when(F.col(before).isNull() | apart(F.col(start) - F.col(before)), F.col(start))

    def steps(part: DataFrame, scan: Scan) -> DataFrame:
        reached = scan(part, [Running(before, "max", F.col(end), inclusive=False)])
        runs = scan(reached, [Running(run, "max", first)])
        ends = [F.min(start).alias(start), F.max(end).alias(end)]
        return runs.groupBy(*keys, run).agg(*ends, *totals).drop(run)

    return running_steps(rows, keys, [start, end], time_chunk(F.col(start), chunk_ms), steps)
