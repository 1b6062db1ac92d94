"""Metrics over deployment windows, for one deployment or for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.operators.running import CHUNK_MS, Running, Scan, running, running_steps, time_chunk
from clickweave.operators.site import CONVERSION
from clickweave.operators.timeframe import DAY_MS, Timeframe, deploy_windows, in_timeframe

# Fixed value: a view counts as engaged above this time spent.
ENGAGED_THRESHOLD = 10
HOUR_MS = 3_600_000


def _page_sums(within: dict[str, Column], threshold: int) -> list[Column]:
    """Per-session sums, one set per named window. Sums, not distinct counts: the rows
    are grouped by session first, so the totals need no second deduplication."""
    out = []
    for tag, inside in within.items():
        x = lambda name: F.when(inside, F.col(name))
        out += [
            F.count_if(inside).alias(f"{tag}_views"),
            F.max(F.when(inside, F.col("time_spent") > threshold)).alias(f"{tag}_engaged"),
            F.sum(x("time_spent")).alias(f"{tag}_spent"),
            F.count(x("time_spent")).alias(f"{tag}_spent_n"),
        ]
        for v in ("fcp", "lcp", "cls"):
            out += [F.sum(x(v)).alias(f"{tag}_{v}"), F.count(x(v)).alias(f"{tag}_{v}_n")]
    return out


def _page_totals(tag: str) -> list[Column]:
    c = lambda name: F.col(f"{tag}_{name}")
    known = F.col("session_id").isNotNull()
    mean = lambda name: S.fixed(S.ratio(F.sum(c(name)), F.sum(c(f"{name}_n"))), 4)
    zero = F.lit(0).cast("bigint")
    return [
        F.count_if(known & (c("views") > 0)).alias("total_sessions"),
        F.coalesce(F.sum(c("views")), zero).alias("total_pageviews"),
        F.count_if(known & c("engaged")).alias("engaged_sessions"),
        mean("spent").alias("avg_time_spent"),
        mean("fcp").alias("avg_fcp"),
        mean("lcp").alias("avg_lcp"),
        mean("cls").alias("avg_cls"),
    ]


def page_window_metrics(
    views: DataFrame, tf: Timeframe, threshold: int = ENGAGED_THRESHOLD
) -> DataFrame:
    inside = {"w": F.lit(True)}
    per_session = in_timeframe(views, "timestamp", tf).groupBy("session_id")
    return per_session.agg(*_page_sums(inside, threshold)).agg(*_page_totals("w"))


def bounced_session_ids(sessions: DataFrame, views: DataFrame, tf: Timeframe) -> DataFrame:
    """Sessions started in the window that ever had exactly one view."""
    started = in_timeframe(sessions, "start_time", tf).select("session_id", "start_time")
    single = views.groupBy("session_id").agg(F.count("id").alias("n")).filter("n = 1")
    return started.join(single.select("session_id"), "session_id")


def bounced_sessions(sessions: DataFrame, views: DataFrame, tf: Timeframe) -> DataFrame:
    return bounced_session_ids(sessions, views, tf).agg(F.count("*").alias("bounced_sessions"))


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "bounce_rate": S.pct(F.col("bounced_sessions"), F.col("total_sessions")),
            "engagement_rate": S.pct(F.col("engaged_sessions"), F.col("total_sessions")),
        }
    )


def window_metrics(
    sessions: DataFrame, views: DataFrame, tf: Timeframe, threshold: int = ENGAGED_THRESHOLD
) -> DataFrame:
    """Page metrics of a window with bounce and engagement rate, one row."""
    bounced = bounced_sessions(sessions, views, tf).scalar()
    pages = page_window_metrics(views, tf, threshold)
    return _with_rates(pages.withColumn("bounced_sessions", bounced))


def window_metrics_literal(
    sessions: DataFrame, views: DataFrame, tf: Timeframe, threshold: int = ENGAGED_THRESHOLD
) -> DataFrame:
    """As written in the original query: the bounce part is grouped per session and never
    summed, so there is one row per bounced session, each counting itself."""
    totals = page_window_metrics(views, tf, threshold)
    packed = totals.select(F.struct(*totals.columns).alias("t")).scalar()
    rows = bounced_session_ids(sessions, views, tf).select(
        packed.alias("t"), F.lit(1).cast("bigint").alias("bounced_sessions")
    )
    return _with_rates(rows.select("t.*", "bounced_sessions"))


def window_comparison(
    sessions: DataFrame, views: DataFrame, deploy_time_s: int, threshold: int = ENGAGED_THRESHOLD
) -> DataFrame:
    """Metrics of the window before a deployment, of the window before that, and the
    changes. Both windows come from one pass over the views and one over the sessions;
    the instant they share counts in both."""
    current, previous = deploy_windows(deploy_time_s)
    both = Timeframe(previous.start, current.end)
    at = lambda col, tf: F.col(col).between(tf.start, tf.end)

    sums = (
        in_timeframe(views, "timestamp", both)
        .groupBy("session_id")
        .agg(*_page_sums({"cur": at("timestamp", current), "prev": at("timestamp", previous)}, threshold))
    )
    bounced = (
        bounced_session_ids(sessions, views, both)
        .agg(
            F.struct(
                F.count_if(at("start_time", current)).alias("cur"),
                F.count_if(at("start_time", previous)).alias("prev"),
            ).alias("b")
        )
        .scalar()
    )
    totals = sums.agg(
        F.struct(*_page_totals("cur")).alias("cur"), F.struct(*_page_totals("prev")).alias("prev")
    ).withColumn("b", bounced)

    def rates(tag: str) -> dict[str, Column]:
        total = F.col(f"{tag}.total_sessions")
        return {
            f"{tag}_bounce": S.pct(F.col(f"b.{tag}"), total),
            f"{tag}_engagement": S.pct(F.col(f"{tag}.engaged_sessions"), total),
        }

    t = totals.withColumns(rates("cur") | rates("prev"))
    c = F.col
    return t.select(
        *[c(f"cur.{n}").alias(n) for n in ("total_sessions", "total_pageviews")],
        c("cur_bounce").alias("bounce_rate"),
        c("cur_engagement").alias("engagement_rate"),
        *[c(f"cur.{n}").alias(n) for n in ("avg_time_spent", "avg_fcp", "avg_lcp", "avg_cls")],
        *changes(
            c("cur.total_sessions"), c("prev.total_sessions"),
            c("cur.total_pageviews"), c("prev.total_pageviews"),
            c("cur_bounce"), c("prev_bounce"),
            c("cur_engagement"), c("prev_engagement"),
        ),
        F.lit(current.start).cast("bigint").alias("metrics_start_time"),
        F.lit(current.end).cast("bigint").alias("metrics_end_time"),
    )


def changes(
    sessions: Column, prev_sessions: Column, views: Column, prev_views: Column,
    bounce: Column, prev_bounce: Column, engagement: Column, prev_engagement: Column,
) -> list[Column]:
    return [
        S.pct_change(sessions, prev_sessions).alias("sessions_change"),
        S.pct_change(views, prev_views).alias("pageviews_change"),
        S.point_change(bounce, prev_bounce).alias("bounce_rate_change"),
        S.point_change(engagement, prev_engagement).alias("engagement_rate_change"),
    ]


def deployment_record(deployment: DataFrame, comparison: DataFrame) -> DataFrame:
    """A deployment (one row) with its comparison or rollup (one row), ready to be
    appended. The two kinds of record fill different columns of the table."""
    packed = comparison.select(F.struct(*comparison.columns).alias("m")).scalar()
    return (
        deployment.withColumn("m", packed)
        .withColumn("deployment_duration", F.col("deploy_time") - F.col("build_time"))
        .select(
            "deploy_time", "build_time", "deployment_duration", "status", "environment",
            "commit_sha", "branch", "m.*",
        )
    )


def data_availability(
    sessions: DataFrame, views: DataFrame, events: DataFrame, tf: Timeframe
) -> DataFrame:
    n = F.count("*")
    in_events = in_timeframe(events, "timestamp", tf).agg(n).scalar()
    in_sessions = in_timeframe(sessions, "start_time", tf).agg(n).scalar()
    return (
        in_timeframe(views, "timestamp", tf)
        .agg(n.alias("page_views_in_range"))
        .withColumns({"events_in_range": in_events, "sessions_in_range": in_sessions})
    )


def _session_rollup(views: DataFrame, events: DataFrame, tf: Timeframe) -> DataFrame:
    """One row per session with views in the window: views, span, and its events there."""
    v = (
        in_timeframe(views, "timestamp", tf)
        .groupBy("session_id")
        .agg(F.count("*").alias("n"), (F.max("timestamp") - F.min("timestamp")).alias("span"))
    )
    e = (
        in_timeframe(events, "timestamp", tf)
        .groupBy("session_id")
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(F.col("event_name") == CONVERSION).alias("n_conversions"),
        )
    )
    return v.join(e, "session_id", "left").withColumns(
        {
            "span": F.when((F.col("n") > 1) & F.col("session_id").isNotNull(), F.col("span")).otherwise(0),
            "n_events": F.coalesce("n_events", F.lit(0)),
            "converted": F.coalesce(F.col("n_conversions") > 0, F.lit(False)),
        }
    )


def _kpis(visitors: Column, bounced: Column, mean_ms: Column, converted: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.coalesce(visitors, F.lit(0)).cast("bigint").alias("total_visitors"),
        F.coalesce(S.pct(bounced, visitors), zero).alias("bounce_rate"),
        F.coalesce(S.fixed(mean_ms / 1000, 2), zero).alias("avg_time_spent_seconds"),
        F.coalesce(S.pct(converted, visitors), zero).alias("conversion_rate"),
    ]


def deployment_rollup(views: DataFrame, events: DataFrame, tf: Timeframe) -> DataFrame:
    """Visitors, bounce rate, mean time and conversion rate of a window, each session
    counted once; zeros when the window is empty."""
    s = _session_rollup(views, events, tf).filter(F.col("session_id").isNotNull())
    return s.agg(
        *_kpis(
            F.count("*"),
            F.count_if(F.col("n") == 1),
            S.ratio(F.sum("span"), F.count("*")),
            F.count_if("converted"),
        )
    )


def stamped(metrics: DataFrame, tf: Timeframe) -> DataFrame:
    """Window metrics with the window's bounds as columns."""
    return metrics.withColumns(
        {
            "metrics_start_time": F.lit(tf.start).cast("bigint"),
            "metrics_end_time": F.lit(tf.end).cast("bigint"),
        }
    )


def deployment_rollup_literal(views: DataFrame, events: DataFrame, tf: Timeframe) -> DataFrame:
    """The same KPIs as written originally, over views joined with the events of their
    session. A session with ``n`` views and ``m`` events contributes ``n * max(m, 1)``
    rows there; the sums over those rows are taken without producing them."""
    s = _session_rollup(views, events, tf)
    known = F.col("session_id").isNotNull()
    per_view = F.greatest("n_events", F.lit(1))
    # Products of three counts: beyond BIGINT for a busy session.
    rows = F.col("n").cast("decimal(38,0)") * per_view
    return s.agg(
        *_kpis(
            F.count_if(known),
            F.coalesce(F.sum(F.when(known & (F.col("n") == 1), per_view)), F.lit(0)),
            S.ratio(F.sum(F.col("span") * rows), F.sum(rows)),
            F.count_if(known & F.col("converted")),
        )
    )


# --- all deployments at once ----------------------------------------------------
#
# A window metric, seen as a function of the window's end, is a step function: it
# changes where a fact enters the window (its time) and where it leaves (one window
# length later). Summing the steps up to each deployment's time gives its metrics. The
# work grows with facts plus deployments, not with their product, however dense the
# deployments are, and no (fact, deployment) pair is ever produced.


def steps_at(steps: DataFrame, ends: DataFrame, end: str, weights: list[str]) -> DataFrame:
    """Sum of all steps (columns ``t`` and ``weights``) up to each ``ends`` row's time."""
    moved = steps.groupBy("t").agg(*[F.sum(w).alias(w) for w in weights])
    queries = ends.select(
        F.col(end).alias("t"), F.struct(*[F.col(c) for c in ends.columns]).alias("row")
    )
    timeline = (
        moved.unionByName(queries, allowMissingColumns=True)
        .withColumn("kind", F.col("row").isNotNull().cast("int"))
        # Steps at the same millisecond come before the deployments they count for.
    )
    zero = F.lit(0)
    done = running(
        timeline,
        [],
        ["t", "kind"],
        [Running(f"sum_{w}", "sum", F.coalesce(w, zero)) for w in weights],
        time_chunk(F.col("t"), HOUR_MS),
    )
    return done.filter("kind = 1").select(
        "row.*", *[F.coalesce(f"sum_{w}", zero).cast("bigint").alias(w) for w in weights]
    )


def _enter_leave(t: Column, width: int, **weights: Column) -> Column:
    """A fact's two steps: it enters at ``t`` and leaves after ``t + width``."""
    return F.array(
        F.struct(t.alias("t"), *[w.alias(n) for n, w in weights.items()]),
        F.struct((t + width + 1).alias("t"), *[(-w).alias(n) for n, w in weights.items()]),
    )


def window_counts_all(
    sessions: DataFrame, views: DataFrame, events: DataFrame, deployments: DataFrame, width: int = DAY_MS
) -> DataFrame:
    """Facts in the window before every deployment and in the window before that."""
    names = ("page_views", "events", "sessions")
    steps = None
    for name, df, ts in zip(names, (views, events, sessions), ("timestamp", "timestamp", "start_time")):
        one = {n: F.lit(int(n == name)).cast("bigint") for n in names}
        # Facts of the same millisecond first become one row.
        per_ms = df.groupBy(F.col(ts).alias("at")).agg(F.count("*").alias("n"))
        rows = per_ms.select(
            F.inline(_enter_leave(F.col("at"), width, **{n: w * F.col("n") for n, w in one.items()}))
        )
        steps = rows if steps is None else steps.unionByName(rows)
    keys = deployments.select("id", (F.col("deploy_time") * 1000).alias("current"))
    ends = keys.select(
        "id",
        F.inline(
            F.array(
                F.struct(F.lit("current").alias("period"), F.col("current").alias("end")),
                F.struct(F.lit("previous").alias("period"), (F.col("current") - width).alias("end")),
            )
        ),
    )
    return steps_at(steps, ends, "end", list(names)).select(
        "id", "period", *[F.col(n).alias(f"{n}_in_range") for n in names]
    )


def rollup_all_deployments(
    views: DataFrame, events: DataFrame, deployments: DataFrame, width: int = DAY_MS,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """``deployment_rollup`` of the window before every deployment.

    Per session, views and conversions enter and leave the window in time order. Running
    counts tell before and after each such moment whether the session is present, is a
    bounce, or has converted; the differences are the steps. The time between two
    successive views counts while both are in the window.
    """
    facts = (
        views.filter(F.col("session_id").isNotNull())
        .select("session_id", F.col("timestamp").alias("at"), F.lit(1).alias("v"), F.lit(0).alias("c"))
        .unionByName(
            events.filter((F.col("event_name") == CONVERSION) & F.col("session_id").isNotNull()).select(
                "session_id", F.col("timestamp").alias("at"), F.lit(0).alias("v"), F.lit(1).alias("c")
            )
        )
    )
    c = F.col
    values = [
        Running("views", "sum", c("v")),
        Running("conversions", "sum", c("c")),
        Running("last_view", "last", c("opened"), inclusive=False),
    ]

    def counted(part: DataFrame, scan: Scan) -> DataFrame:
        moves = (
            part.groupBy("session_id", "at")
            .agg(F.sum("v").alias("v"), F.sum("c").alias("c"))
            .select("session_id", F.inline(_enter_leave(F.col("at"), width, v=F.col("v"), c=F.col("c"))))
            .groupBy("session_id", "t")
            .agg(
                F.sum("v").alias("v"),
                F.sum("c").alias("c"),
                # A view at this very moment enters, even if another one leaves.
                F.max(F.when(F.col("v") > 0, F.col("t"))).alias("opened"),
            )
        )
        return scan(moves, values)

    state = running_steps(facts, ["session_id"], ["t"], time_chunk(c("t"), chunk_ms), counted, gathered=True)
    was_views, was_conversions = c("views") - c("v"), c("conversions") - c("c")

    def step(now: Column, before: Column) -> Column:
        return now.cast("bigint") - before.cast("bigint")

    gap = F.when(
        c("opened").isNotNull() & (c("t") - c("last_view") <= width), c("t") - c("last_view")
    )
    zero = F.lit(0).cast("bigint")
    weights = ["visitors", "bounced", "converted", "span"]
    own = F.struct(
        c("t"),
        step(c("views") > 0, was_views > 0).alias("visitors"),
        step(c("views") == 1, was_views == 1).alias("bounced"),
        step(
            (c("views") > 0) & (c("conversions") > 0), (was_views > 0) & (was_conversions > 0)
        ).alias("converted"),
        F.coalesce(gap, zero).alias("span"),
    )
    ended = F.when(
        gap.isNotNull(),
        F.struct(
            (c("last_view") + width + 1).alias("t"),
            zero.alias("visitors"), zero.alias("bounced"), zero.alias("converted"),
            (-gap).alias("span"),
        ),
    )
    steps = state.select(F.inline(F.array_compact(F.array(own, ended))))
    ends = deployments.withColumn("end", c("deploy_time") * 1000)
    return steps_at(steps, ends.select("id", "deploy_time", "end"), "end", weights).select(
        "id",
        "deploy_time",
        *_kpis(
            c("visitors"), c("bounced"), S.ratio(c("span"), c("visitors")), c("converted")
        ),
    )
