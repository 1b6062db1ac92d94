"""A/B tests over one row per session: segment, variant and whether it converted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.functions import stats


def variant_counts(sessions: DataFrame, segment: str = "segment", variant: str = "variant") -> DataFrame:
    return sessions.groupBy(segment, variant).agg(
        F.count("*").alias("visitors"), F.sum(F.col("converted").cast("bigint")).alias("conversions")
    )


def ab_test(sessions: DataFrame, control: str, lift: float = 0.1) -> DataFrame:
    """Every variant against the control of its segment: rates, confidence that they
    differ, and visitors needed per variant to see ``lift`` over the control's rate."""
    counts = variant_counts(sessions)
    base = counts.filter(F.col("variant") == control).select(
        "segment", F.col("visitors").alias("control_visitors"), F.col("conversions").alias("control_conversions")
    )
    c = F.col
    rate = S.ratio(c("control_conversions"), c("control_visitors"))
    return (
        counts.filter(F.col("variant") != control)
        .join(base, "segment")
        .select(
            "segment",
            "variant",
            "visitors",
            "conversions",
            "control_visitors",
            "control_conversions",
            S.fixed(S.ratio(c("conversions"), c("visitors")), 6).alias("rate"),
            S.fixed(rate, 6).alias("control_rate"),
            S.fixed(
                stats.ab_confidence(
                    c("conversions"), c("visitors"), c("control_conversions"), c("control_visitors")
                ),
                6,
            ).alias("confidence"),
            stats.required_sample_size(rate, F.lit(lift)).alias("sample_size"),
        )
    )


def sample_sizes(sessions: DataFrame, levels: list[tuple[float, float, float]]) -> DataFrame:
    """Required sample size per segment for (lift, confidence, power) settings, with the
    segment's own conversion rate as baseline."""
    rates = sessions.groupBy("segment").agg(
        S.ratio(F.sum(F.col("converted").cast("bigint")), F.count("*")).alias("base")
    )
    settings = F.array(
        *[
            F.struct(F.lit(l).alias("lift"), F.lit(conf).alias("confidence"), F.lit(p).alias("power"))
            for l, conf, p in levels
        ]
    )
    n = stats.required_sample_size(F.col("base"), F.col("lift"), F.col("confidence"), F.col("power"))
    return rates.select("segment", "base", F.inline(settings)).select(
        "segment", "lift", "confidence", "power", n.alias("sample_size")
    )
