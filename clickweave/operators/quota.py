"""Request quotas over fixed intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.operators.running import CHUNK_MS, Running, running, time_chunk

# Fixed value: code of a refused request.
RATE_LIMIT_EXCEEDED = "RATE_LIMIT_EXCEEDED"


def flag_over_quota(
    df: DataFrame, identifier: str, ts: str, tie: str, limit: int, interval_ms: int,
    chunk_ms: int | None = None,
) -> DataFrame:
    """Add ``window_start`` and ``code``; the code is set on every hit of an identifier
    after the first ``limit`` within one interval."""
    width = chunk_ms or min(CHUNK_MS, max(1, interval_ms // 16))
    windowed = df.withColumn("window_start", (F.floor(F.col(ts) / interval_ms) * interval_ms).cast("bigint"))
    counted = running(
        windowed,
        [identifier, "window_start"],
        [ts, tie],
        [Running("hit", "sum", F.lit(1))],
        time_chunk(F.col(ts), width),
    )
    return counted.withColumn("code", F.when(F.col("hit") > limit, F.lit(RATE_LIMIT_EXCEEDED))).drop("hit")
