import random

import pytest
from pyspark.sql import functions as F

from clickweave.operators import deploy
from clickweave.operators.timeframe import DAY_MS, Timeframe

S = "session_id string, start_time long"
V = "id long, session_id string, timestamp long, time_spent long, fcp double, lcp double, cls double"
E = "id long, session_id string, event_name string, timestamp long"


def test_changes_of_the_stated_cases(table):
    """100 against 80 sessions, 500 against 400 views, 20 % against 25 % bounce, 80 % against
    75 % engagement; and a window before with nothing in it."""
    df = table(
        "s long, ps long, v long, pv long, b double, pb double, e double, pe double",
        (100, 80, 500, 400, 20.0, 25.0, 80.0, 75.0),
        (100, 0, 500, 0, 20.0, 0.0, 80.0, 0.0),
    )
    got = df.select(*deploy.changes(*[F.col(c) for c in df.columns])).collect()
    assert tuple(got[0]) == (25.0, 25.0, -5.0, 5.0)
    assert tuple(got[1])[:2] == (0.0, 0.0)


@pytest.fixture
def facts(table):
    s = table(S, ("a", 10), ("b", 20), ("c", 30), ("d", 500))
    v = table(
        V,
        (1, "a", 10, 11, 1.0, None, 0.0), (2, "b", 20, 5, 3.0, 2.0, None), (3, "b", 25, 99, None, None, 0.5),
        (4, "c", 800, None, None, None, None), (5, None, 15, 50, None, None, None),
    )
    e = table(E, (1, "a", "conversion", 12), (2, "a", "click", 13), (3, "b", "click", 14), (4, "b", "conversion", 900))
    return s, v, e


def test_window_metrics(facts):
    s, v, _ = facts
    r = deploy.window_metrics(s, v, Timeframe(10, 100)).collect()[0]
    assert (r.total_sessions, r.total_pageviews, r.engaged_sessions) == (2, 4, 2)
    # c's only view lies outside the window, but bounces look at all views of a session.
    assert (r.bounced_sessions, r.bounce_rate, r.engagement_rate) == (2, 100.0, 100.0)
    assert (r.avg_fcp, r.avg_lcp, r.avg_cls, r.avg_time_spent) == (2.0, 2.0, 0.25, 41.25)


def test_literal_window_metrics_has_a_row_per_bounce(facts):
    s, v, _ = facts
    rows = deploy.window_metrics_literal(s, v, Timeframe(10, 100)).collect()
    assert len(rows) == 2 and set(rows) == {rows[0]}
    assert (rows[0].bounced_sessions, rows[0].bounce_rate) == (1, 50.0)
    assert deploy.window_metrics_literal(s, v, Timeframe(10**6, 10**7)).count() == 0


def test_empty_window_has_no_rates(facts):
    s, v, _ = facts
    r = deploy.window_metrics(s, v, Timeframe(10**6, 10**7)).collect()[0]
    assert (r.total_sessions, r.total_pageviews, r.bounce_rate, r.engagement_rate) == (0, 0, None, None)


def test_comparison_equals_two_window_metrics(table):
    day = DAY_MS
    t = 3 * day // 1000
    rng = random.Random(3)
    sessions = [(f"s{i}", rng.choice([2 * day, 3 * day, rng.randrange(0, 4 * day)])) for i in range(60)]
    views = [
        (i, f"s{rng.randrange(60)}", rng.choice([day, 2 * day, 3 * day, rng.randrange(0, 4 * day)]),
         rng.choice([None, 5, 50]), 1.0, 2.0, 0.5)
        for i in range(80)
    ]
    s, v = table(S, *sessions), table(V, *views)
    got = deploy.window_comparison(s, v, t).collect()[0]
    cur = deploy.window_metrics(s, v, Timeframe(2 * day, 3 * day)).collect()[0]
    prev = deploy.window_metrics(s, v, Timeframe(day, 2 * day)).collect()[0]
    for n in ("total_sessions", "total_pageviews", "bounce_rate", "engagement_rate", "avg_time_spent"):
        assert got[n] == cur[n]
    assert got.sessions_change == pytest.approx((cur.total_sessions / prev.total_sessions - 1) * 100, abs=0.006)
    assert got.bounce_rate_change == pytest.approx(cur.bounce_rate - prev.bounce_rate, abs=0.006)
    assert (got.metrics_start_time, got.metrics_end_time) == (2 * day, 3 * day)


def test_rollup_counts_each_session_once(facts):
    _, v, e = facts
    r = deploy.deployment_rollup(v, e, Timeframe(10, 100)).collect()[0]
    assert tuple(r) == (2, 50.0, 0.0, 50.0)
    assert tuple(deploy.deployment_rollup(v, e, Timeframe(10**6, 10**7)).collect()[0]) == (0, 0.0, 0.0, 0.0)


def test_literal_rollup_counts_joined_rows(facts):
    _, v, e = facts
    # Joined rows: a 1 view x 2 events, b 2 x 1, and the view without a session.
    r = deploy.deployment_rollup_literal(v, e, Timeframe(10, 100)).collect()[0]
    assert tuple(r) == (2, 100.0, 0.0, 50.0)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("width", [50, 1000])
def test_all_deployments_against_single_rollups(table, seed, width, both_ways):
    """Dense deployments, ties, and windows narrower and wider than sessions."""
    rng = random.Random(seed)
    view_rows = [(i, f"s{rng.randrange(6)}", rng.randrange(0, 2000), None, None, None, None) for i in range(60)]
    event_rows = [
        (i, f"s{rng.randrange(8)}", rng.choice(["conversion", "click"]), rng.randrange(0, 2000)) for i in range(30)
    ]
    v, e = table(V, *view_rows), table(E, *event_rows)
    d = table("id long, deploy_time long", *[(i, rng.choice([0, 1, 2, 1])) for i in range(5)])
    got = {r.id: r for r in deploy.rollup_all_deployments(v, e, d, width, chunk_ms=100).collect()}
    assert len(got) == 5
    for row in d.collect():
        end = row.deploy_time * 1000
        views = {}
        for _, s, t, *_ in view_rows:
            if end - width <= t <= end:
                views.setdefault(s, []).append(t)
        converted = {s for _, s, n, t in event_rows if n == "conversion" and end - width <= t <= end}
        n = len(views)
        r = got[row.id]
        assert r.total_visitors == n
        if n:
            assert r.bounce_rate == pytest.approx(100 * sum(len(x) == 1 for x in views.values()) / n, abs=0.006)
            span = sum(max(x) - min(x) for x in views.values())
            assert r.avg_time_spent_seconds == pytest.approx(span / n / 1000, abs=0.0051)
            assert r.conversion_rate == pytest.approx(100 * len(converted & set(views)) / n, abs=0.006)
        else:
            assert tuple(r)[2:] == (0, 0.0, 0.0, 0.0)


def test_window_counts_of_all_deployments(facts, table):
    s, v, e = facts
    d = table("id long, deploy_time long", (1, 0), (2, 1))
    got = {(r.id, r.period): tuple(r)[2:] for r in deploy.window_counts_all(s, v, e, d, 500).collect()}
    assert got == {
        (1, "current"): (0, 0, 0), (1, "previous"): (0, 0, 0),
        (2, "current"): (1, 1, 1), (2, "previous"): (4, 3, 4),
    }
