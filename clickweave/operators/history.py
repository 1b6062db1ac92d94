"""Deployment history: current and previous deployments, means, changes and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.operators.running import Running, running, time_chunk

# Default environment, list lengths, the compared KPIs, and the KPI that
# is better when it falls.
PRODUCTION = "production"
PREVIOUS_K = 10
LAST_N = 3
KPIS = ("total_visitors", "bounce_rate", "avg_time_spent_seconds", "conversion_rate")
LOWER_IS_BETTER = ("bounce_rate",)
MONTH_S = 30 * 86_400


def _newest(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("deploy_time"), F.desc("id")).limit(k)


def _in_env(deployments: DataFrame, env: str) -> DataFrame:
    return deployments.filter(F.col("environment") == env)


def current_deployment(deployments: DataFrame, env: str = PRODUCTION) -> DataFrame:
    return _newest(_in_env(deployments, env), 1)


def previous_deployments(
    deployments: DataFrame, env: str = PRODUCTION, k: int = PREVIOUS_K
) -> DataFrame:
    """The ``k`` newest deployments strictly earlier than the current one; others at the
    current one's time are left out."""
    mine = _in_env(deployments, env)
    bound = mine.agg(F.max("deploy_time")).scalar()
    return _newest(mine.filter(F.col("deploy_time") < bound), k)


def history_view(
    deployments: DataFrame, env: str = PRODUCTION, k: int = PREVIOUS_K
) -> DataFrame:
    """Current and previous deployments as the API returns them."""

    def shaped(df: DataFrame, role: str) -> DataFrame:
        score = F.struct(*[F.lit(0).alias(v) for v in ("ttfb", "fcp", "lcp", "cls", "fid")])
        return df.select(
            F.lit(role).alias("role"),
            F.col("id").alias("deploymentId"),
            S.iso_time(F.col("deploy_time")).alias("deploymentDate"),
            F.col("total_visitors").alias("totalVisitors"),
            F.col("bounce_rate").alias("bounceRate"),
            F.col("avg_time_spent_seconds").alias("avgTimeSpentSeconds"),
            F.col("conversion_rate").alias("conversionRate"),
            score.alias("performanceScore"),
        )

    return shaped(current_deployment(deployments, env), "current").unionByName(
        shaped(previous_deployments(deployments, env, k), "previous")
    )


def history_labels(history: DataFrame) -> DataFrame:
    """The history table as the dashboard labels it."""
    conversion = S.percent_label(F.col("conversionRate"))
    return history.select(
        "role",
        "deploymentId",
        "deploymentDate",
        F.col("totalVisitors").cast("string").alias("visitors"),
        S.percent_label(F.col("bounceRate")).alias("bounce"),
        S.seconds_label(F.col("avgTimeSpentSeconds")).alias("avg_time"),
        F.coalesce(conversion, F.lit("0%")).alias("conversion"),
    )


def previous_mean(previous: DataFrame, metric: str) -> Column:
    """Mean of a metric over previous deployments: a missing value counts as zero, and
    no deployment at all gives zero."""
    zero = F.lit(0.0)
    return F.coalesce(S.ratio(F.sum(F.coalesce(F.col(metric).cast("double"), zero)), F.count("*")), zero)


def change_vs_previous_mean(
    deployments: DataFrame, env: str = PRODUCTION, k: int = PREVIOUS_K
) -> DataFrame:
    """The current deployment's KPIs against the mean of the previous ones, long form.
    The change is NULL where that mean is zero."""
    previous = previous_deployments(deployments, env, k)
    means = previous.agg(
        F.struct(*[previous_mean(previous, m).alias(m) for m in KPIS]).alias("m")
    ).scalar()
    rows = current_deployment(deployments, env).withColumn("m", means)
    long = rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("current"),
                        F.col(f"m.{m}").alias("mean"),
                    )
                    for m in KPIS
                ]
            )
        )
    )
    change = S.ratio(F.col("current") - F.col("mean"), F.col("mean")) * 100
    up = F.col("change") >= 0
    good = F.when(F.col("metric").isin(*LOWER_IS_BETTER), ~up).otherwise(up)
    return long.withColumn("change", change).select(
        "metric",
        "current",
        S.fixed(F.col("mean"), 4).alias("previous_mean"),
        S.fixed(F.abs("change"), 1).alias("change"),
        F.when(up, "up").when(~up, "down").alias("direction"),
        F.when(good, "good").when(~good, "bad").alias("tone"),
    )


def last_deployments(deployments: DataFrame, n: int = LAST_N) -> DataFrame:
    return _newest(deployments, n)


def deployment_deltas(deployments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Differences between each deployment and the next older one; the oldest is
    dropped. ``keys`` (the environment, for a whole history) separate the series."""
    values = ("bounce_rate", "avg_time_spent_seconds", "total_visitors", "conversion_rate")
    with_older = running(
        deployments,
        keys or [],
        ["deploy_time", "id"],
        [Running("older", "last", F.struct(*values), inclusive=False)],
        time_chunk(F.col("deploy_time"), MONTH_S),
    )
    zero = F.lit(0)

    def delta(name: str) -> Column:
        return F.coalesce(F.col(name), zero) - F.coalesce(F.col(f"older.{name}"), zero)

    return with_older.filter(F.col("older").isNotNull()).select(
        *(keys or []),
        "id",
        "deploy_time",
        "commit_sha",
        delta("bounce_rate").alias("bounce_rate_change"),
        delta("avg_time_spent_seconds").alias("avg_time_change"),
        delta("total_visitors").alias("visitors_change"),
        delta("conversion_rate").alias("conversion_change"),
    )
