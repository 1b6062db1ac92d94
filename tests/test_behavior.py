import pytest

from clickweave.operators import behavior, quota
from clickweave.operators.experiments import ab_test

I = "view_id string, seq long, ts long, kind string, section string, scroll_pct int"


def interactions(table, *rows):
    return table(I, *[(v, i, ts, kind, *(more or (None, None))) for i, (v, ts, kind, *more) in enumerate(rows)])


@pytest.mark.parametrize("chunk", [1, 500, 10**9])
def test_sessions_split_only_after_more_than_the_gap(table, chunk, both_ways):
    gap = 1_800_000
    df = table("u string, ts long, n long", ("a", 0, 1), ("a", gap, 2), ("a", 2 * gap + 1, 3), ("b", 5, 4), ("a", 2 * gap + 1, 5))
    got = behavior.sessionize(df, "u", "ts", "n", gap, max(chunk, gap // 50))
    assert {r.n: r.session_id for r in got.collect()} == {
        1: "a-0", 2: "a-0", 3: f"a-{2 * gap + 1}", 5: f"a-{2 * gap + 1}", 4: "b-5",
    }


@pytest.mark.parametrize("chunk", [1000, 10**9])
def test_engagement(table, chunk, both_ways):
    df = interactions(
        table,
        ("one", 0, "start"), ("one", 100, "signal"),
        ("two", 0, "start"), ("two", 100, "signal"), ("two", 200, "signal"),
        ("deep", 0, "start"), ("deep", 50, "scroll", None, 25),
        ("late", 0, "start"), ("late", 10_000, "signal"),
        ("slow", 0, "start"), ("slow", 40_000, "signal"),
        ("quiet", 0, "start"), ("quiet", 31_000, "enter", "s", None),
    )
    got = {r.view_id: (r.engaged_at, r.interactions, r.max_scroll) for r in behavior.engagement(df, chunk).collect()}
    assert got == {
        "one": (None, 1, 0), "two": (200, 2, 0), "deep": (50, 1, 25), "late": (10_000, 1, 0),
        "slow": (40_000, 1, 0), "quiet": (None, 0, 0),
    }
    ends = {r.view_id: (r.timer_bounce, r.final_event) for r in behavior.bounce_or_end(df, chunk).collect()}
    assert ends == {
        "one": (False, "bounce"), "two": (False, "session_end"), "deep": (False, "session_end"),
        "late": (False, "session_end"), "slow": (True, "session_end"), "quiet": (True, "bounce"),
    }


def test_section_dwell(table, both_ways):
    df = interactions(
        table,
        ("v", 0, "leave", "s", None), ("v", 10, "enter", "s", None), ("v", 20, "enter", "s", None),
        ("v", 25, "enter", "t", None), ("v", 50, "leave", "s", None), ("v", 60, "leave", "s", None),
        ("v", 70, "leave", "t", None),
    )
    got = [(r.section, r.entered_at, r.left_at, r.dwell_ms) for r in behavior.section_dwell(df, 15).orderBy("left_at").collect()]
    assert got == [("s", 20, 50, 30), ("t", 25, 70, 45)]


@pytest.mark.parametrize("chunk", [700, 10**9])
def test_bursts(table, chunk, both_ways):
    df = table(
        "k string, seq long, ts long, a int, b int",
        ("x", 1, 0, 1, None), ("x", 2, 999, None, 2), ("x", 3, 1999, 5, None), ("x", 4, 2500, 6, None), ("x", 5, 2500, None, 7),
    )
    got = behavior.compact_bursts(df, "k", 1000, ["a", "b"], chunk).orderBy("first_ts").collect()
    assert [tuple(r) for r in got] == [("x", 0, 999, 2, 2, 1, 2), ("x", 1999, 2500, 5, 3, 6, 7)]


def test_web_vitals(table):
    df = table(
        "view_id string, seq long, ts long, entry_type string, name string, start_time double, request_start double, "
        "response_start double, processing_start double, shift_value double, had_recent_input boolean",
        ("v", 1, 1, "navigation", None, 0.0, 10.0, 30.0, None, None, None),
        ("v", 2, 2, "navigation", None, 0.0, 0.0, 99.0, None, None, None),
        ("v", 3, 3, "paint", "first-paint", 5.0, None, None, None, None, None),
        ("v", 4, 4, "paint", "first-contentful-paint", 7.0, None, None, None, None, None),
        ("v", 5, 5, "largest-contentful-paint", None, 8.0, None, None, None, None, None),
        ("v", 6, 6, "largest-contentful-paint", None, 9.0, None, None, None, None, None),
        ("v", 7, 7, "layout-shift", None, None, None, None, None, 0.25, False),
        ("v", 8, 8, "layout-shift", None, None, None, None, None, 0.5, True),
        ("v", 9, 9, "layout-shift", None, None, None, None, None, 0.125, False),
        ("v", 10, 10, "first-input", None, 20.0, None, None, 28.0, None, None),
        ("v", 11, 11, "first-input", None, 20.0, None, None, 99.0, None, None),
        ("w", 12, 1, "paint", "first-paint", 5.0, None, None, None, None, None),
    )
    got = {r.view_id: tuple(r)[1:] for r in behavior.web_vitals(df).collect()}
    assert got == {"v": (20.0, 7.0, 9.0, 0.375, 8.0), "w": (None,) * 5}


@pytest.mark.parametrize("chunk", [None, 5])
def test_quota(table, chunk, both_ways):
    df = table("u string, ts long, n long", *[("a", t, i) for i, t in enumerate([0, 10, 20, 99, 100, 101])], ("b", 5, 9))
    got = quota.flag_over_quota(df, "u", "ts", "n", 2, 100, chunk)
    flags = {r.n: r.code for r in got.collect()}
    assert {n for n, c in flags.items() if c == "RATE_LIMIT_EXCEEDED"} == {2, 3}
    assert len(flags) == 7


def test_ab_test_is_symmetric(table):
    data = [(1, "A", 1 if i < 10 else 0) for i in range(100)] + [(1, "B", 1 if i < 20 else 0) for i in range(100)]
    df = table("segment long, variant string, converted int", *data)
    a, b = (ab_test(df, control).collect()[0] for control in "AB")
    assert a.confidence == b.confidence > 0.9
    assert (a.variant, a.rate, a.control_rate) == ("B", 0.2, 0.1)
