"""Streams as partial results by key that merge in any order.

A micro-batch is reduced to partial results by the batch operators' own expressions and
added to hash buckets of a store, which merges them level by level (``sources.store``). What a
partial holds is enough to go on from, however late the rows that follow:

* sessions and bursts: intervals with their totals; a late row may bridge two;
* engagement: bounds, counts, the first two signals and the first deep scroll of a view;
* vitals: of each field the value and the position it comes from;
* dwell: the moves themselves, as a late enter changes the pair of any later leave;
* quotas: hits per identifier and interval.

Reading merges what is there, so results are those of one batch over all rows, in whatever
order and split they came; rows that may still change are marked as open, none are held back or dropped.
A batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clickweave.operators import behavior
from clickweave.operators.intervals import merge_intervals
from clickweave.operators.quota import RATE_LIMIT_EXCEEDED
from clickweave.operators.running import CHUNK_MS
from clickweave.sources.store import BUCKET, BUCKETS, FAN_IN, Store, bucket_of


@dataclass(frozen=True)
class Partials:
    """How rows become partials, how partials of a key merge, and what they say in the end."""

    name: str
    keys: list[str]
    reduce: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def add_batch(batch: DataFrame, batch_id: int, root: str, kind: Partials, buckets: int = BUCKETS, fan_in: int = FAN_IN) -> None:
    store = Store(batch.sparkSession, root)
    run = store.begin(f"{kind.name}-{batch_id}")
    if run is None:
        return
    rows = kind.reduce(batch).withColumn(BUCKET, bucket_of(kind.keys, buckets))

    def merged(df: DataFrame) -> DataFrame:
        return kind.merge(df.drop(BUCKET)).withColumn(BUCKET, bucket_of(kind.keys, buckets)).select(*df.columns)

    run.merge(rows, kind.name, BUCKET, merged, fan_in=fan_in)
    run.commit()


def start(rows: DataFrame, root: str, checkpoint: str, kind: Partials, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Start a stream of rows into partials below ``root``."""
    return (
        rows.writeStream.foreachBatch(lambda df, n: add_batch(df, n, root, kind, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def results(spark: SparkSession, root: str, kind: Partials, schema: T.StructType) -> DataFrame:
    """Results as of now; ``schema`` is that of the partials."""
    return kind.finish(kind.merge(Store(spark, root).read(kind.name, BUCKET, schema).drop(BUCKET)))


def partial_schema(rows: DataFrame, kind: Partials) -> T.StructType:
    """The schema of the partials of rows like these."""
    return kind.reduce(rows.sparkSession.createDataFrame([], rows.schema)).schema


# --- intervals --------------------------------------------------------------------------


def _is_open(last: str, wait_ms: int, rows: DataFrame) -> Column:
    """Whether a row that belongs to the interval may still come, by the latest time seen."""
    return F.col(last) + wait_ms >= rows.agg(F.max(last)).scalar()


def sessions(user: str, ts: str, gap_ms: int = behavior.SESSION_GAP_MS, chunk_ms: int = CHUNK_MS) -> Partials:
    """Sessions of each user; a pause of exactly the gap does not split."""
    first, last = "session_start", "last_activity"

    def merge(rows: DataFrame) -> DataFrame:
        return merge_intervals(rows, [user], first, last, lambda gap: gap > gap_ms, [F.sum("n_events").alias("n_events")], chunk_ms)

    def reduce(rows: DataFrame) -> DataFrame:
        one = F.lit(1).cast("bigint").alias("n_events")
        return merge(rows.select(user, F.col(ts).alias(first), F.col(ts).alias(last), one))

    def finish(rows: DataFrame) -> DataFrame:
        return rows.withColumn("is_open", _is_open(last, gap_ms, rows))

    return Partials("sessions", [user], reduce, merge, finish)


def bursts(key: str, wait_ms: int, fields: list[str], chunk_ms: int = CHUNK_MS) -> Partials:
    """Trailing debounce of rows ``(key, ts, seq, fields)``: rows less than ``wait_ms`` apart become one,
    with the last value of each field that is not missing."""

    def merge(rows: DataFrame) -> DataFrame:
        totals = [F.max("end").alias("end"), F.sum("n_rows").alias("n_rows"), *[F.max(f).alias(f) for f in fields]]
        return merge_intervals(rows, [key], "first_ts", "ts", lambda gap: gap >= wait_ms, totals, chunk_ms)

    def reduce(rows: DataFrame) -> DataFrame:
        at = F.struct("ts", "seq")
        told = [F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v"))).alias(f) for f in fields]
        one = F.lit(1).cast("bigint").alias("n_rows")
        return merge(rows.select(key, F.col("ts").alias("first_ts"), "ts", at.alias("end"), one, *told))

    def finish(rows: DataFrame) -> DataFrame:
        values = [F.col(f"{f}.v").alias(f) for f in fields]
        return rows.select(key, "first_ts", "ts", F.col("end.seq").alias("seq"), "n_rows", *values)

    return Partials("bursts", [key], reduce, merge, finish)


# --- views --------------------------------------------------------------------------------


def engagement() -> Partials:
    """``behavior.engagement`` of a view. Its second signal engages a view in any case; its first one does
    if it comes late enough or after a deep scroll, so two positions decide."""

    def merge(rows: DataFrame) -> DataFrame:
        signals = F.slice(F.array_sort(F.flatten(F.collect_list("signals"))), 1, 2)
        return rows.groupBy("view_id").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("interactions").alias("interactions"),
            F.max("max_scroll").alias("max_scroll"), F.min("deep").alias("deep"), signals.alias("signals"),
        )

    def reduce(rows: DataFrame) -> DataFrame:
        at = F.struct("ts", "seq")
        is_signal = F.col("kind").isin(*behavior.SIGNALS)
        # The two first signals: the first, and the first of those after it, by two minima.
        signal = F.when(is_signal, at)
        deep = F.when(F.col("scroll_pct") >= behavior.SIGNIFICANT_SCROLL, at)
        first = rows.groupBy("view_id").agg(
            F.min("ts").alias("start"), F.max("ts").alias("end"), F.count_if(is_signal).alias("interactions"),
            F.coalesce(F.max("scroll_pct"), F.lit(0)).alias("max_scroll"), F.min(deep).alias("deep"),
            F.min(signal).alias("one"),
        )
        later = (
            rows.filter(is_signal).select("view_id", at.alias("at"))
            .join(first.filter("one IS NOT NULL").select("view_id", "one"), "view_id")
            .filter("at > one").groupBy("view_id").agg(F.min("at").alias("two"))
        )
        signals = F.array_compact(F.array("one", "two"))
        return first.join(later, "view_id", "left").select(
            "view_id", "start", "end", "interactions", "max_scroll", "deep", signals.alias("signals")
        )

    def finish(rows: DataFrame) -> DataFrame:
        one, two = F.get("signals", F.lit(0)), F.get("signals", F.lit(1))
        early = (one["ts"] - F.col("start") >= behavior.MIN_ENGAGEMENT_MS) | F.coalesce(F.col("deep") <= one, F.lit(False))
        engaged_at = F.when(early, one["ts"]).otherwise(two["ts"])
        done = rows.withColumn("engaged_at", engaged_at).withColumn("engaged", F.col("engaged_at").isNotNull())
        return done.select("view_id", "start", "end", "interactions", "max_scroll", "engaged_at", "engaged")

    return Partials("engagement", ["view_id"], reduce, merge, finish)


def _of_engagement(finish: Callable[[DataFrame], DataFrame]) -> Partials:
    kind = engagement()
    return Partials(kind.name, kind.keys, kind.reduce, kind.merge, lambda rows: finish(kind.finish(rows)))


def bounce_or_end() -> Partials:
    """``behavior.bounce_or_end``, from the partials of engagement."""
    return _of_engagement(behavior.outcome)


def time_on_page() -> Partials:
    """``behavior.time_on_page`` and the deepest scroll, from the partials of engagement."""
    spent = (F.col("end") - F.col("start")).alias("time_on_page")
    return _of_engagement(lambda rows: rows.select("view_id", "start", spent, "max_scroll"))


def web_vitals() -> Partials:
    """``behavior.web_vitals``: per field the first or last entry, and the sum of the shifts."""
    firsts, last = ("ttfb", "fcp", "fid"), "lcp"

    def merge(rows: DataFrame) -> DataFrame:
        picks = [F.min(f).alias(f) for f in firsts] + [F.max(last).alias(last), F.sum("cls").alias("cls")]
        return rows.groupBy("view_id").agg(*picks)

    def reduce(rows: DataFrame) -> DataFrame:
        return rows.groupBy("view_id").agg(*behavior.vital_aggregates())

    return Partials("vitals", ["view_id"], reduce, merge, behavior.vital_values)


def section_dwell(chunk_ms: int = CHUNK_MS) -> Partials:
    """``behavior.section_dwell`` over the moves of all batches; equal moves count once."""
    moves = ["view_id", "section", "seq", "ts", "kind"]

    def reduce(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("kind").isin(behavior.ENTER, behavior.LEAVE) & F.col("section").isNotNull()).select(*moves).distinct()

    return Partials(
        "moves", ["view_id", "section"], reduce, lambda rows: rows.distinct(), lambda rows: behavior.section_dwell(rows, chunk_ms)
    )


def over_quota(identifier: str, ts: str, limit: int, interval_ms: int) -> Partials:
    """Identifiers with more than ``limit`` hits in an interval."""
    keys = [identifier, "window_start"]

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("hits").alias("hits"))

    def reduce(rows: DataFrame) -> DataFrame:
        window = (F.floor(F.col(ts) / interval_ms) * interval_ms).cast("bigint").alias("window_start")
        return rows.groupBy(identifier, window).agg(F.count("*").alias("hits"))

    def finish(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("hits") > limit).select(*keys, "hits", F.lit(RATE_LIMIT_EXCEEDED).alias("code"))

    return Partials("quota", keys, reduce, merge, finish)
