import pytest
from pyspark.sql import functions as F

from clickweave.operators import site
from clickweave.operators.timeframe import Timeframe

S = "session_id string, start_time long, device_type string, country string"
V = "id long, session_id string, page string, timestamp long"
E = "id long, session_id string, event_name string, element string, timestamp long"


@pytest.fixture
def tables(table):
    sessions = table(
        S,
        ("a", 100, "mobile", "DE"), ("b", 200, None, None), ("c", 300, "unknown", "DE"), ("d", 900, "mobile", "FR"),
    )
    views = table(
        V,
        (1, "a", "/1", 100), (2, "a", "/2", 3100), (3, "b", "/1", 200), (4, "d", "/1", 950),
        (5, "d", "/3", 5000), (6, "ghost", "/1", 120), (7, "ghost", "/1", 1120),
    )
    events = table(
        E,
        (1, "a", "click", "x", 1), (2, "a", "click", "x", 2), (3, "a", "click", None, 2), (4, "b", "conversion", None, 9000),
        (5, "b", "conversion", None, 9001), (6, "ghost", "click", "x", 1), (7, "d", "click", "y", 1),
    )
    return sessions, views, events


def one(df):
    return df.collect()[0][0]


def test_all_time(tables):
    s, v, e = tables
    assert one(site.total_visitors(s)) == 4
    # a has two views, b one, c none (stays, no bounce), d two.
    assert one(site.bounce_rate(s, v)) == 25.0
    # Spans 3000, 4050 and the ghost session's 1000.
    assert one(site.avg_time_spent_seconds(v)) == pytest.approx((3000 + 4050 + 1000) / 3 / 1000)
    assert [tuple(r) for r in site.click_through_rates(s, e).collect()] == [
        ("x", 2, 50.0), ("y", 1, 25.0), (None, 1, 25.0),
    ]
    assert one(site.conversion_rate(s, e)) == 25.0
    assert [tuple(r) for r in site.top_pages(v, k=2).collect()] == [("/1", 5), ("/2", 1)]


def test_timeframe_drops_sessions_without_views_in_range(tables):
    s, v, e = tables
    tf = Timeframe(100, 1000)
    # c has no view; of d only one view is in range; a keeps one of two.
    assert one(site.bounce_rate(s, v, tf)) == 100.0
    assert one(site.conversion_rate(s, e, Timeframe(None, 250))) == 50.0
    assert one(site.total_visitors(s, Timeframe(0, 250))) == 2


def test_missing_label_and_literal_stay_two_groups(tables):
    rows = sorted(tuple(r) for r in site.device_breakdown(tables[0]).collect())
    assert rows == [("mobile", 2), ("unknown", 1), ("unknown", 1)]


def test_breakdowns_add_up(tables):
    s = tables[0]
    for df in (site.device_breakdown(s), site.country_breakdown(s)):
        assert one(df.agg(F.sum("count"))) == 4


def test_no_data(tables):
    s, v, e = tables
    tf = Timeframe(10**9, None)
    assert one(site.bounce_rate(s, v, tf)) is None
    assert one(site.conversion_rate(s, e, tf)) is None
    report = {(r.section, r.key): r.value for r in site.site_report(s, v, e, tf).collect()}
    assert report == {
        ("total_visitors", None): 0.0, ("bounce_rate", None): 0.0,
        ("conversion_rate", None): 0.0, ("avg_time_spent_seconds", None): 0.0,
    }


@pytest.mark.parametrize("tf", [Timeframe(), Timeframe(100, 1000)])
def test_report_agrees_with_single_metrics(tables, tf):
    s, v, e = tables
    r = site.site_report_nested(site.site_report(s, v, e, tf)).collect()[0]
    assert r.total_visitors == one(site.total_visitors(s, tf))
    assert r.bounce_rate == (one(site.bounce_rate(s, v, tf)) or 0)
    assert r.conversion_rate == (one(site.conversion_rate(s, e, tf)) or 0)
    assert r.avg_time_spent_seconds == (one(site.avg_time_spent_seconds(v, tf)) or 0)
    assert [tuple(x) for x in r.top_pages] == [tuple(x) for x in site.top_pages(v, tf).collect()]
    assert sorted(map(str, r.click_through_rates)) == sorted(map(str, site.click_through_rates(s, e, tf).collect()))
    assert sorted(map(tuple, r.device_breakdown)) == sorted(map(tuple, site.device_breakdown(s, tf).collect()))


def test_labels(tables):
    labels = {(r.section, r.key): r.label for r in site.display_kpis(site.site_report(*tables)).collect()}
    assert labels["bounce_rate", None] == "25.0%"
    assert labels["avg_time_spent_seconds", None] == "3s"
    assert labels["click_through_rates", "x"] == "2 (50.0%)"
    assert labels["device_breakdown", "Mobile"] == "2"


def test_report_from_partials_with_sessions_over_days(spark, table):
    """Sessions that span days, views on the first instant of a day, and no read of views or events."""
    from clickweave.operators import daily
    from clickweave.operators.timeframe import DAY_MS, Timeframe
    from clickweave.session import scratch_dir

    day = DAY_MS
    sessions = table(
        "session_id string, start_time long, device_type string, country string",
        ("a", 5, "mobile", None), ("b", day, None, "DE"), ("c", day + 9, "mobile", "DE"), ("d", 2 * day, "x", "FR"), ("e", 3 * day, "x", "FR"),
    )
    views = table(
        "id long, session_id string, page string, timestamp long",
        (1, "a", "/", 6), (2, "a", "/", day + 1), (3, "a", "/x", 2 * day), (4, "b", "/", day), (5, "c", "/x", day + 10),
        (6, "c", None, day + 500), (7, "d", "/", 2 * day), (8, "d", "/", 2 * day + 3), (9, "z", "/q", day + 2), (10, "z", "/q", 3 * day),
    )
    events = table(
        "session_id string, event_name string, element string, timestamp long",
        ("a", "click", "e1", 7), ("b", "conversion", None, day), ("d", "click", None, 2 * day), ("d", "conversion", None, 9 * day),
    )
    root = scratch_dir(spark, "daily")
    daily.write_daily(daily.daily_partials(sessions, views, events), root)
    stored = daily.read_daily(spark, root)
    for tf in (Timeframe(None, None), Timeframe(day, 2 * day), Timeframe(day, None), Timeframe(None, day), Timeframe(7 * day, 8 * day)):
        got = daily.site_report_from_partials(stored, tf)
        expected = site.site_report(sessions, views, events, tf)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect())), tf
        assert all(root in f for f in got.inputFiles())
