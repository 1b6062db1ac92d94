"""Site metrics over an optional timeframe.

Facts are reduced to one row per session (or session and element) before they meet the
sessions table, so joins see small, unskewed rows. Totals used as denominators are
scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.operators.timeframe import ALL_TIME, Timeframe, in_timeframe

# Event names, label of a missing value, list length.
CLICK, CONVERSION = "click", "conversion"
MISSING_LABEL = "unknown"
TOP_K = 10


def _sessions(sessions: DataFrame, tf: Timeframe) -> DataFrame:
    return in_timeframe(sessions, "start_time", tf)


def total_visitors(sessions: DataFrame, tf: Timeframe = ALL_TIME) -> DataFrame:
    return _sessions(sessions, tf).agg(F.count_distinct("session_id").alias("total_visitors"))


def _view_counts(sessions: DataFrame, views: DataFrame, tf: Timeframe, *extra: str) -> DataFrame:
    """Sessions with their number of views in range. A bounded timeframe also tests the
    view's time after the join, so sessions without a view in range drop out; without
    bounds they stay with 0 views."""
    counts = (
        in_timeframe(views, "timestamp", tf).groupBy("session_id").agg(F.count("id").alias("page_count"))
    )
    how = "inner" if tf.bounded else "left"
    return (
        _sessions(sessions, tf)
        .select("session_id", *extra)
        .join(counts, "session_id", how)
        .withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    )


def bounce_rate(sessions: DataFrame, views: DataFrame, tf: Timeframe = ALL_TIME) -> DataFrame:
    """Share of sessions with exactly one view in range; NULL without sessions."""
    return _view_counts(sessions, views, tf).agg(
        S.pct(F.count_if(F.col("page_count") == 1), F.count("*")).alias("bounce_rate")
    )


def avg_time_spent_seconds(views: DataFrame, tf: Timeframe = ALL_TIME) -> DataFrame:
    """Mean time between first and last view of the sessions with more than one."""
    spans = (
        in_timeframe(views, "timestamp", tf)
        .groupBy("session_id")
        .agg((F.max("timestamp") - F.min("timestamp")).alias("span"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    return spans.agg((F.avg("span") / 1000).alias("avg_time_spent_seconds"))


def top_pages(views: DataFrame, tf: Timeframe = ALL_TIME, k: int = TOP_K) -> DataFrame:
    return (
        in_timeframe(views, "timestamp", tf)
        .groupBy("page")
        .agg(F.count("*").alias("views"))
        .orderBy(F.desc("views"), F.asc_nulls_last("page"))
        .limit(k)
    )


def click_through_rates(
    sessions: DataFrame, events: DataFrame, tf: Timeframe = ALL_TIME, k: int = TOP_K
) -> DataFrame:
    """Clicks per element of the sessions that started in range, and clicks per 100
    visitors. A missing element is a group of its own."""
    in_range = _sessions(sessions, tf).select("session_id")
    clicks = (
        events.filter(F.col("event_name") == CLICK)
        .groupBy("session_id", "element")
        .agg(F.count("*").alias("n"))
    )
    visitors = total_visitors(sessions, tf).scalar()
    return (
        clicks.join(in_range, "session_id")
        .groupBy("element")
        .agg(F.sum("n").alias("clicks"))
        .orderBy(F.desc("clicks"), F.asc_nulls_last("element"))
        .limit(k)
        .select("element", "clicks", S.pct(F.col("clicks"), visitors).alias("ctr"))
    )


def _breakdown(sessions: DataFrame, column: str, tf: Timeframe) -> DataFrame:
    """Sessions per raw value; the label is put on afterwards, so a NULL and a literal
    "unknown" stay two rows."""
    return (
        _sessions(sessions, tf)
        .groupBy(F.col(column).alias("raw"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc_nulls_last("raw"))
        .select(F.coalesce("raw", F.lit(MISSING_LABEL)).alias(column), "count")
    )


def device_breakdown(sessions: DataFrame, tf: Timeframe = ALL_TIME) -> DataFrame:
    return _breakdown(sessions, "device_type", tf)


def country_breakdown(sessions: DataFrame, tf: Timeframe = ALL_TIME) -> DataFrame:
    return _breakdown(sessions, "country", tf)


def _converting(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("event_name") == CONVERSION)
        .groupBy("session_id")
        .agg(F.lit(1).alias("converted"))
    )


def conversion_rate(
    sessions: DataFrame, events: DataFrame, tf: Timeframe = ALL_TIME
) -> DataFrame:
    """Share of the sessions started in range that converted at any time."""
    return (
        _sessions(sessions, tf)
        .select("session_id")
        .join(_converting(events), "session_id", "left")
        .agg(S.pct(F.count("converted"), F.count("*")).alias("conversion_rate"))
    )


# Columns of the long report: one row per scalar and per list entry.
REPORT = ("section", "key", "value", "rate")


def _row(section: str, key: Column, value: Column, rate: Column | None = None) -> list[Column]:
    return [
        F.lit(section).alias("section"),
        key.cast("string").alias("key"),
        F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"),
        (F.lit(None) if rate is None else rate).cast("double").alias("rate"),
    ]


def site_report(
    sessions: DataFrame, views: DataFrame, events: DataFrame, tf: Timeframe = ALL_TIME, k: int = TOP_K
) -> DataFrame:
    """All site metrics in long form; a missing scalar is 0, a missing list is empty.

    Sessions meet the per-session facts once, and that join is reduced to one small row
    per (device, country). Visitors, bounce and conversion rate and both breakdowns are
    sums over those rows, so the tables are not scanned again for each metric.
    """
    in_range = _sessions(sessions, tf).select("session_id", "device_type", "country")
    counts = (
        in_timeframe(views, "timestamp", tf).groupBy("session_id").agg(F.count("id").alias("page_count"))
    )
    countable = F.lit(True) if not tf.bounded else F.col("page_count").isNotNull()
    cube = (
        in_range.join(counts, "session_id", "left")
        .join(_converting(events), "session_id", "left")
        .groupBy("device_type", "country")
        .agg(
            F.count("*").alias("visitors"),
            F.count_if(countable).alias("counted"),
            F.count_if(F.col("page_count") == 1).alias("bounced"),
            F.count("converted").alias("converted"),
        )
    )
    c = F.col
    visitors = cube.agg(F.sum("visitors")).scalar()
    scalars = cube.agg(
        F.sum("visitors").alias("visitors"),
        S.pct(F.sum("bounced"), F.sum("counted")).alias("bounce"),
        S.pct(F.sum("converted"), F.sum("visitors")).alias("conversion"),
    ).select(
        F.inline(
            F.array(
                F.struct(*_row("total_visitors", F.lit(None), c("visitors"))),
                F.struct(*_row("bounce_rate", F.lit(None), c("bounce"))),
                F.struct(*_row("conversion_rate", F.lit(None), c("conversion"))),
            )
        )
    )
    spent = avg_time_spent_seconds(views, tf).select(
        *_row("avg_time_spent_seconds", F.lit(None), c("avg_time_spent_seconds"))
    )
    pages = top_pages(views, tf, k).select(*_row("top_pages", c("page"), c("views")))

    clicks = (
        events.filter(c("event_name") == CLICK)
        .groupBy("session_id", "element")
        .agg(F.count("*").alias("n"))
        .join(in_range.select("session_id"), "session_id")
        .groupBy("element")
        .agg(F.sum("n").alias("clicks"))
        .orderBy(F.desc("clicks"), F.asc_nulls_last("element"))
        .limit(k)
        .select(*_row("click_through_rates", c("element"), c("clicks"), S.pct(c("clicks"), visitors)))
    )
    report = scalars.unionByName(spent).unionByName(pages).unionByName(clicks)
    for section, column in (("device_breakdown", "device_type"), ("country_breakdown", "country")):
        part = cube.groupBy(column).agg(F.sum("visitors").alias("n"))
        label = F.coalesce(column, F.lit(MISSING_LABEL))
        report = report.unionByName(part.select(*_row(section, label, c("n"))))
    return report


def site_report_nested(long: DataFrame) -> DataFrame:
    """The long report as one row with arrays, each ordered by value. The lists are the
    top-k lists and the per-device and per-country counts."""

    def scalar(section: str) -> Column:
        v = F.max(F.when(F.col("section") == section, F.col("value")))
        return F.coalesce(v, F.lit(0.0)).alias(section)

    def entries(section: str, key: str, value: str, *rate: str) -> Column:
        row = F.struct(
            (-F.col("value")).alias("order"),
            F.col("key"),
            F.col("value").cast("bigint").alias("value"),
            F.col("rate"),
        )
        rows = F.sort_array(F.collect_list(F.when(F.col("section") == section, row)))
        names = lambda r: F.struct(
            r["key"].alias(key), r["value"].alias(value), *[r["rate"].alias(x) for x in rate]
        )
        return F.transform(rows, names).alias(section)

    return long.agg(
        scalar("total_visitors").cast("bigint").alias("total_visitors"),
        scalar("bounce_rate"),
        scalar("avg_time_spent_seconds"),
        entries("top_pages", "page", "views"),
        entries("click_through_rates", "element", "clicks", "ctr"),
        entries("device_breakdown", "device_type", "count"),
        entries("country_breakdown", "country", "count"),
        scalar("conversion_rate"),
    )


def display_kpis(report: DataFrame) -> DataFrame:
    """Report values as the dashboard labels them."""
    section, value = F.col("section"), F.col("value")
    label = (
        F.when(section.isin("bounce_rate", "conversion_rate"), S.percent_label(value))
        .when(section == "avg_time_spent_seconds", S.seconds_label(value))
        .when(section == "click_through_rates", S.count_label(value.cast("bigint"), F.col("rate")))
        .otherwise(value.cast("bigint").cast("string"))
    )
    key = F.when(section == "device_breakdown", F.initcap("key")).otherwise(F.col("key"))
    return report.select("section", key.alias("key"), label.alias("label"))
