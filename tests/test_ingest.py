import pytest
from pyspark.sql import functions as F

from clickweave.operators import ingest
from clickweave.operators.ingest import INVALID_EVENTS, INVALID_SESSION, MISSING_SESSION


def by(df, key, *fields):
    return {r[key]: tuple(r[f] for f in fields) for r in df.collect()}


def test_session_start_and_end(raw):
    log = raw(
        ("a", 1, 10, "session_start", {"user_agent": "first", "latitude": 0.0}),
        ("a", 2, 20, "session_start", {"user_agent": "second"}),
        ("a", 3, 30, "session_end"),
        ("a", 4, 40, "session_end"),
        ("b", 5, 10, "session_end"),
        ("b", 6, 20, "session_start", {"user_agent": ""}),
    )
    got = by(ingest.fold_sessions(log), "session_id", "start_time", "end_time", "user_agent", "latitude")
    assert got == {"a": (10, 40, "first", None), "b": (20, None, None, None)}
    kept = by(ingest.fold_sessions(log, zero_is_null=False), "session_id", "latitude")
    assert kept["a"] == (0.0,)


def test_rejects(raw, both_ways):
    log = raw(
        (None, 1, 5, "session_start"), ("", 2, 5, "click"), ("a", 3, 5, "pageview", {"page": "/"}),
        ("a", 4, 6, "session_start"), ("a", 5, 6, "click"), ("b", 6, 1, "click"),
    )
    assert by(ingest.rejects(log), "seq", "reason", "status") == {
        1: (MISSING_SESSION, 400), 2: (MISSING_SESSION, 400), 3: (INVALID_SESSION, 403), 6: (INVALID_SESSION, 403),
    }


def test_time_spent_goes_to_the_view_before(raw, both_ways):
    log = raw(
        ("a", 0, 1, "pageview", {"page": "/early", "time_spent": 9}),
        ("a", 1, 10, "session_start"),
        ("a", 2, 20, "pageview", {"page": "/1", "time_spent": 5}),
        ("a", 3, 30, "pageview", {"page": "/2", "time_spent": 7}),
        ("a", 4, 40, "click", {"time_spent": 100}),
        ("a", 5, 50, "session_end", {"time_spent": 11}),
        ("a", 6, 60, "session_end", {"time_spent": 0}),
        ("b", 7, 10, "session_start"),
        ("b", 8, 20, "session_end", {"time_spent": 3}),
    )
    got = by(ingest.fold_page_views(log), "page", "time_spent")
    assert got == {"/1": (7,), "/2": (11,)}


def test_performance_updates_the_latest_view(raw, both_ways):
    log = raw(
        ("a", 1, 10, "session_start"),
        ("a", 2, 15, "performance", {"ttfb": 1.0}),
        ("a", 3, 20, "pageview", {"page": "/1", "cls": 0.5, "scroll_depth": "30px"}),
        ("a", 4, 30, "performance", {"ttfb": 2.0, "cls": 0.0}),
        ("a", 5, 40, "performance", {"ttfb": 3.0, "lcp": 8.0}),
        ("a", 6, 50, "performance", {"page": "/2", "ttfb": 4.0, "scroll_depth": "x"}),
    )
    got = by(ingest.fold_page_views(log), "page", "ttfb", "cls", "lcp", "scroll_depth")
    assert got == {"/1": (3.0, 0.5, 8.0, 30), "/2": (4.0, None, None, None)}
    kept = by(ingest.fold_page_views(log, zero_is_null=False), "page", "cls")
    assert kept["/1"] == (0.0,)
    names = [r.event_name for r in ingest.fold_events(log).orderBy("id").collect()]
    assert names == ["performance", "pageview", "performance", "performance", "performance"]


@pytest.mark.parametrize("chunk", [7, 10**12])
def test_every_record_has_one_fate(spark, chunk, both_ways):
    from clickweave.sources.fixtures import view

    log = view(spark, "/root/testdata/sf0.001", "fx_raw")
    width = chunk if chunk > 10**9 else chunk * 3_600_000
    rejected = ingest.rejects(log, width).select("seq")
    kept = ingest.accepted(log, width).select("seq")
    all_seq = [r.seq for r in rejected.unionByName(kept).collect()]
    assert sorted(all_seq) == sorted(r.seq for r in log.select("seq").collect())
    views = ingest.fold_page_views(log, chunk_ms=width)
    base = ingest.fold_page_views(log)
    assert sorted(map(str, views.collect())) == sorted(map(str, base.collect()))
    known = ingest.fold_sessions(log).select("session_id")
    assert views.join(known, "session_id", "left_anti").count() == 0


def test_batches(table):
    df = table(
        "session_id string, arrival long, user_agent string, body string",
        ("s", 5, "ua", '{"events":[{"event":"session_start"},{"sessionId":"t","event":"click","timeSpent":4,"scrollDepth":"9"}]}'),
        ("s", 6, "ua", '{"events":{"event":"x"}}'),
        ("s", 7, "ua", "{}"),
        (None, 8, "ua", '{"events":[]}'),
        ("s", 9, "ua", '{"events":[]}'),
    )
    records, refused = ingest.explode_batch(df)
    rows = [(r.session_id, r.ts, r.pos, r.event, r.time_spent, r.scroll_depth, r.user_agent) for r in records.orderBy("pos").collect()]
    assert rows == [("s", 5, 0, "session_start", None, None, "ua"), ("t", 5, 1, "click", 4, "9", "ua")]
    assert by(refused, "arrival", "reason") == {
        6: (INVALID_EVENTS,), 7: (INVALID_EVENTS,), 8: (MISSING_SESSION,),
    }


def test_gate_against_known_sessions(raw, table):
    log = raw(("a", 1, 1, "click"), ("b", 2, 1, "click"), ("c", 3, 1, "session_start"))
    passed, refused = ingest.gate_against(log, table("session_id string", ("a",)))
    assert {r.seq for r in passed.collect()} == {1, 3}
    assert {r.seq for r in refused.collect()} == {2}


def test_normalize(table):
    df = table(
        "session_id string, seq long, arrival long, event string, time_spent string, country string, device_hint string, cls string",
        ("s", 1, 99, "", "12s", None, "tv", "0.5x"),
    )
    r = ingest.normalize(df).collect()[0]
    assert (r.ts, r.event, r.time_spent, r.country, r.city, r.device_type, r.cls, r.ip_address) == (
        99, None, 12, "Unknown", "Unknown", "tv", 0.5, "unknown",
    )


def test_parameters_of_metrics_survive_folding(raw):
    """A page record next to its session start in one batch counts, whatever its position."""
    log = raw(("a", 1, 10, "session_start"), ("a", 2, 10, "pageview", {"page": "/"}))
    assert ingest.fold_page_views(log).count() == 1
    assert ingest.fold_events(log).select(F.first("event_name")).collect()[0][0] == "pageview"


def test_request_lines_of_every_kind(table):
    """Fractions and quoted numbers, a record's own session, bodies and lines that cannot be read."""
    import json

    line = lambda **r: (json.dumps(r),)
    events = [{"page": "/", "timeSpent": 12.5}, {"page": "/a", "timeSpent": "13", "cls": "0.5x", "sessionId": "own"}, 7, {"sessionId": ""}]
    lines = table(
        "value string",
        line(seq=1, arrival=5, session_id="a", event="pageview", page="/", time_spent="8s", latitude=3, remote_ip="1.1.1.1"),
        line(seq=2, arrival="6", session_id="b", user_agent="iPad", country="", body=json.dumps({"events": events})),
        line(seq=3, arrival=7, session_id="c", body='{"events": {"page": "/"}}'),
        line(seq=4, arrival=7, body='{"events": []}'),
        line(seq=5, arrival=7, session_id="c", body="{"),
        line(arrival=7, session_id="c"),
        ('{"seq": 6, "arr',), ("",), (None,), ("[1]",),
        line(seq=8, arrival=9, session_id="d", body='{"events": []}'),
    )
    records, dead = ingest.split_requests(lines)
    got = {r.seq: r for r in records.collect()}
    whole = ingest.RECORDS
    assert sorted(got) == [whole, *range(2 * whole, 2 * whole + 4)]
    one = got[whole]
    assert (one.time_spent, one.ts, one.latitude, one.ip_address, one.country) == (8, 5, 3.0, "1.1.1.1", "Unknown")
    first, second, third, fourth = (got[2 * whole + k] for k in range(4))
    assert (first.session_id, first.time_spent, first.device_type, first.country) == ("b", 12, "tablet", "Unknown")
    assert (second.session_id, second.time_spent, second.cls, second.ts) == ("own", 13, 0.5, 6)
    assert (third.session_id, third.page, third.event) == ("b", None, None) and fourth.session_id == ""
    reasons = sorted((r.reason, r.status, r.value) for r in dead.collect() if r.value)
    assert [r[:2] for r in reasons] == [("Invalid events array", 400)] * 2 + [("Missing required session ID", 400)] + [("Unreadable request", 500)] * 3
    assert dead.count() == 8
