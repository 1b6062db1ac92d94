"""Scalar column expressions: parsing, defaults, percentages and labels.

Everything here is a built-in expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
UNKNOWN_DEVICE = "unknown"
UNKNOWN_IP = "unknown"
UNKNOWN_PLACE = "Unknown"
INT_PREFIX = r"^\s*([+-]?[0-9]+)"
FLOAT_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
SCROLL_STEPS = (25, 50, 75, 100)
# --------------------------------------------------------------------------


def fixed(x: Column, places: int) -> Column:
    """Round half up as if written with eight decimals first, so that the digits do not depend on
    how an engine rounds binary doubles."""
    return F.round(F.round(x.cast("double"), 8), places)


def ratio(n: Column, d: Column) -> Column:
    """``n / d`` as DOUBLE, NULL where the denominator is zero."""
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def pct(n: Column, d: Column) -> Column:
    """Percentage with two decimals, NULL where the denominator is zero."""
    return fixed(ratio(n, d) * 100, 2)


def pct_change(current: Column, previous: Column) -> Column:
    """Relative change in percent, 0 where the earlier value is zero."""
    return F.when(previous == 0, F.lit(0.0)).otherwise(
        pct(current.cast("double") - previous.cast("double"), previous)
    )


def point_change(current: Column, previous: Column) -> Column:
    """Difference in points; a missing side counts as zero."""
    zero = F.lit(0.0)
    return fixed(F.coalesce(current, zero) - F.coalesce(previous, zero), 2)


def present(c: Column) -> Column:
    """True for text that is neither NULL nor empty."""
    return c.isNotNull() & (c != "")


def text_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def number_or_null(c: Column, zero_is_null: bool = True) -> Column:
    """NaN, and by default also 0, become NULL (they count as missing)."""
    c = F.when(F.isnan(c.cast("double")), F.lit(None)).otherwise(c)
    return F.when(c != 0, c) if zero_is_null else c


def parse_int(c: Column) -> Column:
    """Leading integer of a text ("12px" is 12), NULL if there is none."""
    return F.nullif(F.regexp_extract(c, INT_PREFIX, 1), F.lit("")).try_cast("bigint")


def parse_float(c: Column) -> Column:
    """Leading decimal number of a text, NULL if there is none."""
    return F.nullif(F.regexp_extract(c, FLOAT_PREFIX, 1), F.lit("")).try_cast("double")


def device_type(user_agent: Column, hint: Column) -> Column:
    ua = F.lower(user_agent)
    return (
        F.when(present(hint), hint)
        .when(~present(F.coalesce(user_agent, F.lit(""))), F.lit(UNKNOWN_DEVICE))
        .when(ua.contains("mobile"), F.lit("mobile"))
        .when(ua.contains("tablet") | ua.contains("ipad"), F.lit("tablet"))
        .otherwise(F.lit("desktop"))
    )


def client_ip(forwarded_for: Column, remote: Column) -> Column:
    """First hop of the forwarding list, else the peer address."""
    first = text_or_null(F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1))))
    return F.coalesce(first, text_or_null(remote), F.lit(UNKNOWN_IP))


def place(c: Column) -> Column:
    return F.coalesce(text_or_null(c), F.lit(UNKNOWN_PLACE))


def event_time(client_ms: Column, arrival_ms: Column) -> Column:
    return F.coalesce(F.nullif(client_ms, F.lit(0).cast("bigint")), arrival_ms)


def iso_time(epoch_seconds: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds."""
    ms = F.floor(epoch_seconds * 1000)
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")).cast("string")
    rest = F.pmod(ms, F.lit(86_400_000))
    parts = (F.floor(rest / 3_600_000), F.floor(rest / 60_000) % 60, F.floor(rest / 1000) % 60)
    clock = F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])
    return F.concat(day, F.lit("T"), clock, F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"))


def js_round(x: Column) -> Column:
    """Round to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def one_decimal(x: Column) -> Column:
    """Text with one decimal, half up."""
    text = F.round(x.try_cast("decimal(20,8)"), 1).cast("decimal(20,1)").cast("string")
    return F.coalesce(text, F.round(x.cast("double"), 1).cast("string"))


def percent_label(x: Column) -> Column:
    return F.concat(one_decimal(x), F.lit("%"))


def seconds_label(x: Column) -> Column:
    return F.concat(js_round(x).cast("bigint").cast("string"), F.lit("s"))


def count_label(n: Column, x: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" ("), one_decimal(x), F.lit("%)"))


def scroll_percent(top: Column, height: Column) -> Column:
    """Scrolled share of the page in whole percent."""
    return js_round(ratio(top, height) * 100).cast("int")


def scroll_bucket(percent: Column) -> Column:
    """25, 50, 75 for the quarter reached, 100 only at the very end, else NULL."""
    *lower, full = SCROLL_STEPS
    bucket = F.when(percent == full, F.lit(full))
    for step in reversed(lower):
        bucket = bucket.when((percent >= step) & (percent < full), F.lit(step))
    return bucket
