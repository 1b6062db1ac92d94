"""Time bounds in epoch milliseconds. A bound of None, 0 or NaN means open."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# Presets of the dashboard, in days.
PRESETS = {"24h": 1, "7d": 7, "30d": 30, "all": None}


@dataclass(frozen=True)
class Timeframe:
    start: float | None = None
    end: float | None = None

    def _bound(self, x: float | None) -> int | None:
        return None if not x or x != x else int(x)

    @property
    def lo(self) -> int | None:
        return self._bound(self.start)

    @property
    def hi(self) -> int | None:
        return self._bound(self.end)

    @property
    def bounded(self) -> bool:
        return self.lo is not None or self.hi is not None


ALL_TIME = Timeframe()


def in_timeframe(df: DataFrame, column: str, tf: Timeframe = ALL_TIME) -> DataFrame:
    """Keep the rows whose ``column`` lies within both bounds, ends included.

    Stored tables are partitioned by ``event_date``; Spark cannot derive a date range
    from a millisecond range, so the matching partition filter is added here.
    """
    for bound, op in ((tf.lo, "ge"), (tf.hi, "le")):
        if bound is None:
            continue
        df = df.filter(F.col(column) >= bound if op == "ge" else F.col(column) <= bound)
        if "event_date" in df.columns:
            day = F.lit(datetime.fromtimestamp(bound / 1000, timezone.utc).date())
            date = F.col("event_date")
            df = df.filter(date >= day if op == "ge" else date <= day)
    return df


def timeframe_from_params(start: str | None, end: str | None) -> Timeframe:
    """Bounds from query parameters: the leading integer counts, anything else is open."""

    def bound(text: str | None) -> int | None:
        m = re.match(r"\s*([+-]?[0-9]+)", text or "")
        return int(m.group(1)) if m else None

    return Timeframe(bound(start), bound(end))


def preset_timeframe(name: str, now_ms: int) -> Timeframe:
    days = PRESETS[name]
    return ALL_TIME if days is None else Timeframe(now_ms - days * DAY_MS, now_ms)


def deploy_windows(deploy_time_s: int) -> tuple[Timeframe, Timeframe]:
    """The 24 hours up to a deployment, and the 24 hours before those. Both include
    their ends, so they share one instant."""
    end = deploy_time_s * 1000
    mid = end - DAY_MS
    return Timeframe(mid, end), Timeframe(mid - DAY_MS, mid)
