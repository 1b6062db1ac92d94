"""Running values per key that survive hot keys.

A window over ``partitionBy(key)`` sends all rows of a key to one task. That is the best
plan for ordinary keys, and fails once one key (a crawler's session, say) holds a large
share of the data. So keys are counted first, and hot ones take another way:

* ordinary keys: one window per key, one shuffle;
* hot keys: each (key, time chunk) is reduced to one row of totals, a window over those
  few rows gives what every chunk inherits from the earlier chunks of its key, the
  inherited values join the data as one extra row per chunk, and a window over
  ``partitionBy(key, chunk)`` finishes the job.

A key is hot from ``HOT_ROWS`` rows on (``spark.clickweave.hotKeyRows``), but only if it
holds more than one part in ``MAX_HOT_KEYS`` of all rows. There cannot be more such keys
than that, whatever the data, so the list of hot keys is safe to broadcast. Without hot
keys the list is empty, and adaptive execution drops the second branch at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_MS = 15 * 60 * 1000
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
BEFORE_ALL = -(2**63)  # chunk number of what comes before all data

_CHUNK, _CARRIED = "__chunk", "__carried"


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``min``, ``max`` or ``last`` (latest non-NULL)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True

    @property
    def input(self) -> str:
        return f"__in_{self.name}"

    def over(self, window: WindowSpec) -> Column:
        c = F.col(self.input)
        if self.kind == "last":
            return F.last(c, ignorenulls=True).over(window)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](c).over(window)

    def total(self, order: list[str]) -> Column:
        c = F.col(self.input)
        if self.kind == "last":
            return F.max(F.when(c.isNotNull(), F.struct(*order, c.alias("v"))))["v"]
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](c)


Scan = Callable[[DataFrame, list[Running]], DataFrame]


def time_chunk(ts: Column, width: int = CHUNK_MS) -> Column:
    return F.floor(ts / F.lit(width)).cast("bigint")


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with too many rows for one task; at most ``MAX_HOT_KEYS`` rows."""
    least = int(df.sparkSession.conf.get("spark.clickweave.hotKeyRows", str(HOT_ROWS)))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = counts.agg(F.sum("n")).scalar()
    return counts.filter((F.col("n") >= least) & (F.col("n") * MAX_HOT_KEYS > rows)).select(*keys)


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.withColumn(_CARRIED, F.lit(False)).unionByName(
        carried.withColumn(_CARRIED, F.lit(True)), allowMissingColumns=True
    )


def _finish(rows: DataFrame, parts: list[str], order: list[str], values: list[Running]) -> DataFrame:
    """Windows over ``parts``, starting from the carried row of each part, if any."""
    inputs = [v.input for v in values]
    carries = _CARRIED in rows.columns
    window = Window.partitionBy(*parts).orderBy(*[F.desc(_CARRIED)] * carries, *order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    done = rows.withColumns({v.name: v.over(upto if v.inclusive else before) for v in values})
    return (done.filter(~F.col(_CARRIED)) if carries else done).drop(_CARRIED, *inputs)


def _initial_rows(initial: DataFrame, keys: list[str], values: list[Running], *more: Column) -> DataFrame:
    return initial.select(*keys, *more, *[F.col(v.name).alias(v.input) for v in values])


def _by_key(keys: list[str], order: list[str], initial: DataFrame | None) -> Scan:
    def scan(df: DataFrame, values: list[Running]) -> DataFrame:
        rows = df.withColumns({v.input: v.value for v in values})
        if initial is not None:
            rows = _with_carried(rows, _initial_rows(initial, keys, values))
        return _finish(rows, keys, order, values)

    return scan


def _by_chunk(keys: list[str], order: list[str], chunk: Column, initial: DataFrame | None) -> Scan:
    def scan(df: DataFrame, values: list[Running]) -> DataFrame:
        rows = df.withColumns({_CHUNK: chunk, **{v.input: v.value for v in values}})
        # Every chunk gets its row, also one that adds nothing: it still inherits.
        totals = rows.groupBy(*keys, _CHUNK).agg(*[v.total(order).alias(v.input) for v in values])
        if initial is not None:
            first = F.lit(BEFORE_ALL).alias(_CHUNK)
            totals = totals.unionByName(_initial_rows(initial, keys, values, first))
        earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        inherited = totals.select(
            *keys, _CHUNK, *[v.over(earlier).alias(v.input) for v in values]
        ).filter(reduce(or_, [F.col(v.input).isNotNull() for v in values]))
        # Without this a layout by key alone, left by an earlier step, would do for the
        # window, and a hot key would be back in one task.
        spread = _with_carried(rows, inherited).repartition(*keys, _CHUNK)
        return _finish(spread, [*keys, _CHUNK], order, values).drop(_CHUNK)

    return scan


def running_steps(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    steps: Callable[[DataFrame, Scan], DataFrame],
    initial: DataFrame | None = None,
    gathered: bool = False,
) -> DataFrame:
    """Apply ``steps(part, scan)`` to ordinary and to hot keys. ``scan(df, values)`` adds
    running values in the way that suits the part and may be used several times. With ``gathered``
    the rows of ordinary keys lie together from the start, so that aggregates by key and more,
    before the first scan, stay where they are."""
    by_chunk = _by_chunk(keys, order, chunk, initial)
    if not keys:
        return steps(df, by_chunk)
    # NULL is a key like any other here, so it has to match itself.
    hot = F.broadcast(hot_keys(df, keys).select(*[F.col(k).alias(f"__hot_{k}") for k in keys]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys])
    ordinary, busy = df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")
    if gathered:
        ordinary = ordinary.repartition(*keys)
    return steps(ordinary, _by_key(keys, order, initial)).unionByName(steps(busy, by_chunk))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[Running],
    chunk: Column,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add the running ``values`` to ``df``.

    ``keys`` and ``order`` name columns; NULL is one key, ``order`` is non-NULL, ascending
    and unique within a key, and ``chunk`` must never decrease along ``order``. ``initial`` (keys
    and one column per value) is what a key brings along from earlier data. Without
    ``keys`` the whole table is one series and always goes by chunk.
    """
    return running_steps(df, keys, order, chunk, lambda part, scan: scan(part, values), initial)
