"""Sessions and engagement from raw interactions.

Interactions are rows ``(view_id, seq, ts, kind, ...)``; ``ts`` is in milliseconds and
``(ts, seq)`` orders the rows of a view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.operators.running import CHUNK_MS, Running, Scan, running, running_steps, time_chunk
from clickweave.schemas import VITALS

# Idle time that ends a session, bounce timer, engagement minima, the
# waits of the two debounce stages, and the performance entry names (milliseconds).
SESSION_GAP_MS = 30 * 60 * 1000
BOUNCE_MS = 30 * 1000
MIN_ENGAGEMENT_MS = 10 * 1000
SIGNIFICANT_SCROLL = 25
MERGE_WAIT_MS, SEND_WAIT_MS = 1000, 2000
NAVIGATION, LCP_ENTRY, SHIFT, FIRST_INPUT = (
    "navigation",
    "largest-contentful-paint",
    "layout-shift",
    "first-input",
)
FCP_NAME = "first-contentful-paint"
ENTER, LEAVE, SCROLL = "enter", "leave", "scroll"
SIGNALS = ("scroll", "signal")


def _runs(
    df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str, chunk: Column,
    then: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Add ``name``: time of the first row of the run a row belongs to. ``starts`` is
    tested with ``previous``, the time before the row. Times only grow along the order,
    so both are running maxima of one number, which aggregate by hash. ``then`` continues
    while the rows still lie together by key."""
    ts = F.col(order[0])
    first = F.when(F.col("previous").isNull() | starts, ts)

    def steps(part: DataFrame, scan: Scan) -> DataFrame:
        lagged = scan(part, [Running("previous", "max", ts, inclusive=False)])
        return then(scan(lagged, [Running(name, "max", first)]).drop("previous"))

    return running_steps(df, keys, order, chunk, steps)


def sessionize(
    df: DataFrame, user: str, ts: str, tie: str, gap_ms: int = SESSION_GAP_MS, chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Add ``session_start`` and ``session_id``. A session ends when its user is idle for
    strictly more than ``gap_ms``; the id is the user and the start, NULL for rows without a user."""
    idle = F.col(ts) - F.col("previous") > gap_ms
    runs = _runs(df, [user], [ts, tie], idle, "session_start", time_chunk(F.col(ts), chunk_ms))
    return runs.withColumn("session_id", F.concat(F.col(user), F.lit("-"), F.col("session_start")))


def compact_bursts(
    df: DataFrame, key: str, wait_ms: int, fields: list[str], chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Trailing debounce: rows closer than ``wait_ms`` to the one before form a burst.
    One row per burst, at its last row's time, with the last non-NULL value per field."""
    apart = F.col("ts") - F.col("previous") >= wait_ms
    at = F.struct("ts", "seq")

    def latest(f: str) -> Column:
        return F.max(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f))))[f].alias(f)

    def merged(rows: DataFrame) -> DataFrame:
        bursts = rows.groupBy(key, "first_ts").agg(
            F.max(at).alias("end"), F.count("*").alias("n_rows"), *[latest(f) for f in fields]
        )
        ends = [F.col("end.ts").alias("ts"), F.col("end.seq").alias("seq")]
        return bursts.select(key, "first_ts", *ends, "n_rows", *fields)

    chunk = time_chunk(F.col("ts"), chunk_ms)
    return _runs(df, [key], ["ts", "seq"], apart, "first_ts", chunk, merged)


def engagement(interactions: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Per view: start, end, interactions, deepest scroll, and when it became engaged.

    A signal engages the view if by then 10 s have passed, a quarter of the page was
    scrolled, or another signal came before; only then does it count as interaction.
    """
    engages = F.col("is_signal") & (
        (F.col("ts") - F.col("start") >= MIN_ENGAGEMENT_MS)
        | (F.coalesce("scroll_so_far", F.lit(0)) >= SIGNIFICANT_SCROLL)
        | (F.coalesce("signals_before", F.lit(0)) > 0)
    )
    so_far = [
        Running("start", "min", F.col("ts")),
        Running("scroll_so_far", "max", F.col("scroll_pct")),
        Running("signals_before", "sum", F.col("is_signal").cast("bigint"), inclusive=False),
    ]

    def steps(part: DataFrame, scan: Scan) -> DataFrame:
        return (
            scan(part, so_far)
            .groupBy("view_id")
            .agg(
                F.min("ts").alias("start"),
                F.max("ts").alias("end"),
                F.count_if("is_signal").alias("interactions"),
                F.coalesce(F.max("scroll_pct"), F.lit(0)).alias("max_scroll"),
                F.min(F.when(engages, F.col("ts"))).alias("engaged_at"),
            )
            .withColumn("engaged", F.col("engaged_at").isNotNull())
        )

    rows = interactions.withColumn("is_signal", F.col("kind").isin(*SIGNALS))
    chunk = time_chunk(F.col("ts"), chunk_ms)
    return running_steps(rows, ["view_id"], ["ts", "seq"], chunk, steps)


def outcome(engaged: DataFrame) -> DataFrame:
    """Per view of ``engagement``: whether the 30 s timer reported a bounce, and the event at unload."""
    late = F.col("engaged_at").isNull() | (F.col("engaged_at") > F.col("start") + BOUNCE_MS)
    return engaged.select(
        "view_id",
        # The timer only fires in views that last that long.
        (late & (F.col("end") - F.col("start") >= BOUNCE_MS)).alias("timer_bounce"),
        F.when(F.col("engaged"), "session_end").otherwise("bounce").alias("final_event"),
        (F.col("end") - F.col("start")).alias("time_on_page"),
    )


def bounce_or_end(interactions: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    return outcome(engagement(interactions, chunk_ms))


def scroll_buckets(interactions: DataFrame) -> DataFrame:
    """Views reaching each scroll step, one row per view and step."""
    scrolls = interactions.filter(F.col("kind") == SCROLL)
    return (
        scrolls.withColumn("bucket", S.scroll_bucket(F.col("scroll_pct")))
        .filter(F.col("bucket").isNotNull())
        .groupBy("view_id", "bucket")
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    )


def running_max_scroll(interactions: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Scroll rows with the deepest scroll of their view so far."""
    scrolls = interactions.filter(F.col("kind") == SCROLL)
    return running(
        scrolls,
        ["view_id"],
        ["ts", "seq"],
        [Running("max_scroll", "max", F.col("scroll_pct"))],
        time_chunk(F.col("ts"), chunk_ms),
    ).select("view_id", "seq", "ts", "scroll_pct", "max_scroll")


def vital_samples(entries: DataFrame) -> DataFrame:
    """Performance entries as the vitals they report, one row each."""
    c, kind = F.col, F.col("entry_type")
    return entries.select(
        "view_id",
        "seq",
        "ts",
        F.when(kind == NAVIGATION, c("response_start") - c("request_start")).alias("ttfb"),
        F.when(c("name") == FCP_NAME, c("start_time")).alias("fcp"),
        F.when(kind == LCP_ENTRY, c("start_time")).alias("lcp"),
        F.when(kind == SHIFT, c("shift_value")).alias("cls"),
        F.when(kind == FIRST_INPUT, c("processing_start") - c("start_time")).alias("fid"),
    )


def vital_aggregates() -> list[Column]:
    """Aggregates over performance entries: of four vitals the deciding entry's position and value, and
    the sum of unexpected shifts."""
    at = F.struct("ts", "seq")
    c = F.col

    def entry(pick, is_it: Column, value: Column) -> Column:
        return pick(F.when(is_it, F.struct(at.alias("at"), value.alias("v"))))

    kind = c("entry_type")
    return [
        entry(F.min, kind == NAVIGATION, c("response_start") - c("request_start")).alias("ttfb"),
        entry(F.min, c("name") == FCP_NAME, c("start_time")).alias("fcp"),
        entry(F.max, kind == LCP_ENTRY, c("start_time")).alias("lcp"),
        F.sum(F.when((kind == SHIFT) & ~c("had_recent_input"), c("shift_value"))).alias("cls"),
        entry(F.min, kind == FIRST_INPUT, c("processing_start") - c("start_time")).alias("fid"),
    ]


def vital_values(deciding: DataFrame) -> DataFrame:
    value = lambda v: F.col(v) if v == "cls" else F.col(v)["v"]
    return deciding.select("view_id", *[S.fixed(value(v), 4).alias(v) for v in VITALS])


def web_vitals(entries: DataFrame) -> DataFrame:
    """The five vitals of a view from its performance entries, in one aggregation."""
    return vital_values(entries.groupBy("view_id").agg(*vital_aggregates()))


def section_dwell(interactions: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Time between a section's coming into view and its leaving. A repeated enter starts
    over; a leave without an enter before it is ignored."""
    moves = interactions.filter(F.col("kind").isin(ENTER, LEAVE) & F.col("section").isNotNull())
    seen = running(
        moves,
        ["view_id", "section"],
        ["ts", "seq"],
        [Running("before", "last", F.struct("kind", "ts"), inclusive=False)],
        time_chunk(F.col("ts"), chunk_ms),
    )
    entered = (F.col("kind") == LEAVE) & (F.col("before.kind") == ENTER)
    return seen.filter(entered).select(
        "view_id",
        "section",
        "seq",
        F.col("before.ts").alias("entered_at"),
        F.col("ts").alias("left_at"),
        (F.col("ts") - F.col("before.ts")).alias("dwell_ms"),
    )


def time_on_page(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("view_id").agg(
        F.min("ts").alias("start"), (F.max("ts") - F.min("ts")).alias("time_on_page")
    )
