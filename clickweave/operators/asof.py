"""As-of joins: for every row the latest row of another table before it, by key and time.

Both tables are one series per key, and the latest row of the other table is a running value of it. So a
key is sorted once, no pair of rows is formed, and hot keys are cut into time chunks like those of other
running values (``running``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.operators.running import CHUNK_MS, Running, running, time_chunk

_AT, _SIDE, _TIE, _ROW, _FOUND = "__at", "__side", "__tie", "__row", "__found"


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_tie: str, name: str,
    tolerance_ms: int | None = None, inclusive: bool = True, chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """All rows of ``left`` with ``name``: the latest row of ``right`` (a struct of its columns but the keys) with
    the same ``keys`` and a time that is not later, or earlier unless ``inclusive``, and by at most
    ``tolerance_ms``. Of rows of one time the one with the greatest ``right_tie`` counts, a BIGINT. Rows with a
    NULL key or time match nothing and are kept."""
    others = [c for c in right.columns if c not in keys]
    usable = reduce(and_, [F.col(k).isNotNull() for k in keys])
    found = F.struct(*others)
    series = right.filter(usable & F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias(_AT), F.lit(0 if inclusive else 1).alias(_SIDE), F.col(right_tie).cast("bigint").alias(_TIE), found.alias(_FOUND)
    )
    # Every left row is its own: equal ones are told apart by number, and their order does not matter.
    asked = left.select(*keys, F.struct(*left.columns).alias(_ROW), F.col(left_time).alias(_AT)).withColumns(
        {_SIDE: F.lit(1 if inclusive else 0), _TIE: F.lit(0).cast("bigint")}
    )
    can = usable & F.col(_AT).isNotNull()
    both = series.unionByName(asked.filter(can), allowMissingColumns=True)
    latest = Running(name, "last", F.col(_FOUND))
    ran = running(both, keys, [_AT, _SIDE, _TIE], [latest], time_chunk(F.col(_AT), chunk_ms))
    ran = ran.filter(F.col(_ROW).isNotNull())
    near = F.col(name)
    if tolerance_ms is not None:
        near = F.when(F.col(_AT) - F.col(f"{name}.{right_time}") <= tolerance_ms, near)
    matched = ran.select(f"{_ROW}.*", near.alias(name))
    nothing = F.lit(None).cast(matched.schema[name].dataType).alias(name)
    return matched.unionByName(asked.filter(~F.coalesce(can, F.lit(False))).select(f"{_ROW}.*", nothing))
