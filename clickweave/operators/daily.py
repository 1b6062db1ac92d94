"""The site report of whole days from stored partials, without reading views or events.

Partials are sums per day: sessions and conversions by device and country, clicks by element (both by the day a
session started), views by page, and sessions by number and span of their views. The last are right
for a session whose views all lie on one day; the others, which span days, are kept as a row per day and
session and are put together for the timeframe asked for. The first instant of a day is a part of its own, as
timeframes include both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.operators import site
from clickweave.operators.timeframe import ALL_TIME, DAY_MS, Timeframe

PART = ("day", "first_instant")
TABLES = ("session_days", "click_days", "page_days", "view_days", "spanning")


def _part(ts: str) -> list[Column]:
    day = F.floor(F.col(ts) / DAY_MS).cast("bigint")
    return [day.alias("day"), (F.col(ts) == day * DAY_MS).alias("first_instant")]


def daily_partials(sessions: DataFrame, views: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The partials by name."""
    starts = sessions.select("session_id", *_part("start_time"), "device_type", "country")
    converting = events.filter(F.col("event_name") == site.CONVERSION).groupBy("session_id").agg(F.lit(1).alias("converted"))
    session_days = starts.join(converting, "session_id", "left").groupBy(*PART, "device_type", "country").agg(
        F.count("*").alias("visitors"), F.count("converted").alias("converted")
    )
    clicks = events.filter(F.col("event_name") == site.CLICK).groupBy("session_id", "element").agg(F.count("*").alias("n"))
    click_days = clicks.join(starts, "session_id").groupBy(*PART, "element").agg(F.sum("n").alias("clicks"))
    placed = views.select("session_id", "id", "page", "timestamp", *_part("timestamp"))
    page_days = placed.groupBy(*PART, "page").agg(F.count("*").alias("views"))

    per_day = placed.groupBy("session_id", *PART).agg(
        F.count("id").alias("page_count"), F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    began = starts.select("session_id", F.col("day").alias("start_day"), F.col("first_instant").alias("start_instant"))
    per_day = per_day.withColumn("parts", F.count("*").over(Window.partitionBy("session_id"))).join(began, "session_id", "left")
    many = F.col("n") > 1
    view_days = per_day.filter("parts = 1").groupBy(*PART, "start_day", "start_instant").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("page_count") == 1).alias("bounced"), F.count_if(many).alias("several"),
        F.sum(F.when(many, F.col("last") - F.col("first"))).alias("span"),
    )
    return {
        "session_days": session_days, "click_days": click_days, "page_days": page_days, "view_days": view_days,
        "spanning": per_day.filter("parts > 1").drop("parts"),
    }


def write_daily(partials: dict[str, DataFrame], root: str) -> None:
    for name, rows in partials.items():
        rows.write.parquet(f"{root}/{name}")


def read_daily(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}


def _within(tf: Timeframe, day: str = "day", first: str = "first_instant") -> Column:
    """Whether a part lies in the timeframe."""
    for bound in (tf.lo, tf.hi):
        if bound is not None and bound % DAY_MS:
            raise ValueError("partials are of whole UTC days")
    inside = F.col(day).isNotNull()
    if tf.lo is not None:
        inside &= F.col(day) >= tf.lo // DAY_MS
    if tf.hi is not None:
        last = tf.hi // DAY_MS
        inside &= (F.col(day) < last) | ((F.col(day) == last) & F.col(first))
    return inside


def _one_row(df: DataFrame, sums: list[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def site_report_from_partials(partials: dict[str, DataFrame], tf: Timeframe = ALL_TIME, k: int = site.TOP_K) -> DataFrame:
    """``site.site_report`` of a timeframe of whole UTC days."""
    c = F.col
    here = {name: rows.filter(_within(tf)) for name, rows in partials.items()}
    started = _within(tf, "start_day", "start_instant")

    # Sessions of one day are summed already; those that span days are put together here.
    of_view_days = here["view_days"].agg(
        F.sum(F.when(started, c("sessions"))).alias("counted"), F.sum(F.when(started, c("bounced"))).alias("bounced"),
        F.sum("several").alias("several"), F.sum("span").alias("span"),
    )
    whole = here["spanning"].groupBy("session_id").agg(
        F.sum("page_count").alias("page_count"), F.sum("n").alias("n"), (F.max("last") - F.min("first")).alias("span"),
        F.max(started).alias("started"),
    )
    many = c("n") > 1
    of_spanning = whole.agg(
        F.count_if("started").alias("counted"), F.count_if(c("started") & (c("page_count") == 1)).alias("bounced"),
        F.count_if(many).alias("several"), F.sum(F.when(many, c("span"))).alias("span"),
    )
    viewed = _one_row(of_view_days.unionByName(of_spanning), ["counted", "bounced", "several", "span"])
    totals = _one_row(here["session_days"], ["visitors", "converted"])
    visitors, converted = totals.select("visitors").scalar(), totals.select("converted").scalar()
    # Without bounds, sessions without a view are counted too.
    counted = c("counted") if tf.bounded else visitors
    none = F.lit(None)
    scalars = viewed.select(
        F.inline(
            F.array(
                F.struct(*site._row("total_visitors", none, visitors)),
                F.struct(*site._row("bounce_rate", none, S.pct(c("bounced"), counted))),
                F.struct(*site._row("conversion_rate", none, S.pct(converted, visitors))),
                F.struct(*site._row("avg_time_spent_seconds", none, S.ratio(c("span"), c("several")) / 1000)),
            )
        )
    )
    pages = here["page_days"].groupBy("page").agg(F.sum("views").alias("views"))
    pages = pages.orderBy(F.desc("views"), F.asc_nulls_last("page")).limit(k).select(*site._row("top_pages", c("page"), c("views")))
    clicks = here["click_days"].groupBy("element").agg(F.sum("clicks").alias("clicks"))
    clicks = clicks.orderBy(F.desc("clicks"), F.asc_nulls_last("element")).limit(k)
    report = scalars.unionByName(pages).unionByName(
        clicks.select(*site._row("click_through_rates", c("element"), c("clicks"), S.pct(c("clicks"), visitors)))
    )
    for section, column in (("device_breakdown", "device_type"), ("country_breakdown", "country")):
        part = here["session_days"].groupBy(column).agg(F.sum("visitors").alias("n"))
        report = report.unionByName(part.select(*site._row(section, F.coalesce(column, F.lit(site.MISSING_LABEL)), c("n"))))
    return report
