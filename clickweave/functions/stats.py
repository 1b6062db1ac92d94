"""Experiment statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickweave.functions.scalars import ratio

# Two-sided z quantiles, and the coefficients of the Abramowitz and
# Stegun approximation 7.1.26 of the error function -------------------------
Z_SCORES = {0.80: 1.28, 0.85: 1.44, 0.90: 1.645, 0.95: 1.96, 0.99: 2.576, 0.999: 3.291}
DEFAULT_Z = 1.96
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
MAX_CONFIDENCE = 0.9999
# --------------------------------------------------------------------------


def z_score(level: Column) -> Column:
    """z for a listed confidence level, the 95 % value for any other."""
    out = F.lit(None).cast("double")
    for known, z in Z_SCORES.items():
        out = F.when(level == F.lit(known), F.lit(z)).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_Z))


def standard_error(p: Column, n: Column) -> Column:
    return F.sqrt(ratio(p * (1 - p), n))


def erf(x: Column) -> Column:
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    powers = sum((F.lit(a) * F.pow(t, F.lit(i + 1)) for i, a in enumerate(ERF_COEFFICIENTS)), F.lit(0.0))
    sign = F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * (1 - powers * F.exp(-x * x))


def ab_confidence(conv_a: Column, n_a: Column, conv_b: Column, n_b: Column) -> Column:
    """Confidence that two conversion rates differ, between 0 and 0.9999."""
    rate_a, rate_b = ratio(conv_a, n_a), ratio(conv_b, n_b)
    se = F.sqrt(ratio(rate_a * (1 - rate_a), n_a) + ratio(rate_b * (1 - rate_b), n_b))
    z = ratio(F.abs(rate_a - rate_b), se)
    confidence = F.least(F.lit(MAX_CONFIDENCE), (1 + erf(z / F.sqrt(F.lit(2.0)))) / 2)
    return (
        F.when((n_a == 0) | (n_b == 0) | (rate_a == rate_b), F.lit(0.0))
        .when(se == 0, F.lit(MAX_CONFIDENCE))
        .otherwise(confidence)
    )


def required_sample_size(
    base: Column, lift: Column, confidence: Column | None = None, power: Column | None = None
) -> Column:
    """Visitors per variant needed to see ``lift``. The z for power comes from the
    same two-sided table as the one for confidence."""
    z = z_score(F.lit(0.95) if confidence is None else confidence)
    z_power = z_score(F.lit(0.80) if power is None else power)
    lifted = base * (1 + lift)
    mean = (base + lifted) / 2
    spread = ratio(z + z_power, lifted - base)
    return F.ceil(2 * mean * (1 - mean) * spread * spread)
