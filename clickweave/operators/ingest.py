"""Tracking records into sessions, page views and events.

The fold is a set operation over the log, ordered by ``(session_id, ts, seq)``:
records of a session count from its first ``session_start`` on, and updates of "the
latest page view" are found with running values instead of one lookup per record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave import schemas
from clickweave.functions import scalars as S
from clickweave.operators.running import CHUNK_MS, Running, running_steps, time_chunk
from clickweave.sources.tables import evolve_schema

CONTEXT_TEXTS = ("user_agent", "ip_address", "referrer", "device_type", "country", "city")
CONTEXT_NUMBERS = ("latitude", "longitude")

# Event names with a meaning of their own, and the reject classes.
START, END, PERFORMANCE = "session_start", "session_end", "performance"
MISSING_SESSION, INVALID_SESSION, INVALID_EVENTS = (
    "Missing required session ID",
    "Invalid session",
    "Invalid events array",
)
REJECT_STATUS = {MISSING_SESSION: 400, INVALID_EVENTS: 400, INVALID_SESSION: 403}


def _tracked() -> list[Column]:
    """Columns of a tracking record, from those of a request."""
    c = F.col
    return [
        c("session_id"),
        c("seq"),
        c("arrival").alias("ts"),
        *[S.text_or_null(c(n)).alias(n) for n in ("event", "page", "scroll_depth", "element", "href", "section")],
        S.parse_int(c("time_spent")).alias("time_spent"),
        c("user_agent"),
        S.client_ip(c("forwarded_for"), c("remote_ip")).alias("ip_address"),
        S.place(c("country")).alias("country"),
        S.place(c("city")).alias("city"),
        S.parse_float(c("latitude")).alias("latitude"),
        S.parse_float(c("longitude")).alias("longitude"),
        c("referrer"),
        S.device_type(c("user_agent"), c("device_hint")).alias("device_type"),
        *[S.parse_float(c(v)).alias(v) for v in schemas.VITALS],
    ]


def normalize(requests: DataFrame) -> DataFrame:
    """Tracking requests (header texts) into typed tracking records. The server's
    arrival time stamps the record."""
    return evolve_schema(requests, schemas.REQUEST).select(*_tracked())


#: Names of a batch record's values where they differ from a request's.
_RECORD_NAMES = {"session_id": "sessionId", "scroll_depth": "scrollDepth", "time_spent": "timeSpent"}
_OF_RECORD = ("event", "page", "scroll_depth", "element", "href", "section", "time_spent", *schemas.VITALS)


def _batch_records(body: Column) -> Column:
    """A body's records, NULL unless its ``events`` are an array; one that is no object has no values."""
    texts = F.from_json(body, schemas.BATCH_BODY)["events"]
    return F.transform(texts, lambda t: F.from_json(t, schemas.BATCH_RECORD))


def _batch_reason(body: Column) -> Column:
    missing = F.when(~S.present(F.coalesce("session_id", F.lit(""))), F.lit(MISSING_SESSION))
    return missing.when(F.from_json(body, schemas.BATCH_BODY)["events"].isNull(), F.lit(INVALID_EVENTS))


def _record_session(record: Column) -> Column:
    """A record's own session id, even an empty one, overrides the header's."""
    return F.coalesce(record["sessionId"], F.col("session_id")).alias("session_id")


def _record_value(record: Column, name: str) -> Column:
    return record[_RECORD_NAMES.get(name, name)].alias(name)


def explode_batch(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch requests into tracking records, and the requests that are refused.

    An envelope has ``body`` (JSON text), ``arrival``, the header's ``session_id`` and
    the shared header values. A record keeps its position in the batch as ``pos``; numbers may be
    written as such or as text.
    """
    reasoned = envelopes.withColumn("reason", _batch_reason(F.col("body")))
    header = [c for c in envelopes.columns if c not in ("body", "session_id", "arrival")]
    r = F.col("r")
    numbers = {"time_spent": S.parse_int, **dict.fromkeys(schemas.VITALS, S.parse_float)}
    parsed = lambda n: numbers.get(n, lambda c: c)(_record_value(r, n)).alias(n)
    records = (
        reasoned.filter(F.col("reason").isNull())
        .select("session_id", "arrival", *header, F.posexplode(_batch_records(F.col("body"))).alias("pos", "r"))
        .select(_record_session(r), F.col("arrival").alias("ts"), "pos", *header, *[parsed(n) for n in _OF_RECORD])
    )
    return records, reasoned.filter(F.col("reason").isNotNull())


#: Places for the records of a request between its number and the next one.
RECORDS = 1 << 20
UNREADABLE = "Unreadable request"


def read_requests(lines: DataFrame) -> DataFrame:
    """Lines of JSON (``value``), single and batch requests mixed: a row per tracking record, and one per dead
    letter, with its ``value``, ``reason`` and ``status`` and the arrival time as ``ts``.

    A line with a ``body`` is a batch; its records share the header values and the arrival time. A record's
    number is that of the request times ``RECORDS`` plus its position. Dead letters
    keep the line as it came: those that are no JSON object with a number and an arrival time, batches
    without a session id, and those whose ``events`` are no array. Records without a session are left to the gate.
    """
    read = F.from_json("value", schemas.REQUEST_LINE)
    rows = lines.select("value", read.alias("r")).select("value", "r.*")
    rows = rows.withColumns({"seq": F.col("seq").try_cast("bigint"), "arrival": F.col("arrival").try_cast("bigint")})
    unreadable = F.col("seq").isNull() | F.col("arrival").isNull()
    batch = F.when(F.col("body").isNotNull(), _batch_reason(F.col("body")))
    rows = rows.withColumn("reason", F.when(unreadable, F.lit(UNREADABLE)).otherwise(batch))
    dead = F.col("reason").isNotNull()
    status = F.when(dead, F.when(F.col("reason") == UNREADABLE, 500).otherwise(400))

    own = F.struct(*[F.col(n).alias(_RECORD_NAMES.get(n, n)) for n in ("session_id", *_OF_RECORD)])
    records = F.when(~dead, F.when(F.col("body").isNull(), F.array(own)).otherwise(_batch_records(F.col("body"))))
    header = [f.name for f in schemas.REQUEST.fields if f.name not in ("session_id", "seq", *_OF_RECORD)]
    letter = [F.when(dead, F.col("value")).alias("value"), "reason", status.alias("status")]
    r = F.col("r")
    requests = (
        rows.select("session_id", "seq", *header, *letter, F.posexplode_outer(records).alias("pos", "r"))
        # A batch may be empty.
        .filter("reason IS NOT NULL OR pos IS NOT NULL")
        .select(
            _record_session(r), F.when(~dead, F.col("seq") * RECORDS + F.col("pos")).alias("seq"), *header,
            *[_record_value(r, n) for n in _OF_RECORD], "value", "reason", "status",
        )
    )
    return requests.select(*_tracked(), "value", "reason", "status")


def split_read(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracking records and dead letters among rows of ``read_requests``."""
    dead = rows.filter("reason IS NOT NULL").select("value", F.col("ts").alias("arrival"), "reason", "status")
    return rows.filter("reason IS NULL").drop("value", "reason", "status"), dead


def split_requests(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON into tracking records and dead letters, see ``read_requests``."""
    return split_read(read_requests(lines))


def _at() -> Column:
    return F.struct("ts", "seq")


def _view() -> Column:
    return F.struct("ts", "seq", "page")


def is_view() -> Column:
    ends = F.coalesce(F.col("event").isin(START, END), F.lit(False))
    return ~ends & S.present(F.coalesce("page", F.lit("")))


def session_gate(
    raw: DataFrame,
    chunk_ms: int = CHUNK_MS,
    known: DataFrame | None = None,
    then: Callable[[DataFrame], DataFrame] = lambda gated: gated,
) -> DataFrame:
    """Records with a session id, with ``started`` (position of the session's first
    start, NULL before it), ``latest_view`` (position and page of the latest valid page
    view before the record) and ``pos`` (number within the session). Records without a
    start before them are invalid.

    ``known`` holds the three for sessions seen in earlier data. ``then`` continues with
    the records while they still lie together by session.
    """
    with_id = raw.filter(S.present(F.coalesce("session_id", F.lit(""))))
    values = [
        Running("started", "min", F.when(F.col("event") == START, _at())),
        Running("latest_view", "max", F.when(is_view(), _view()), inclusive=False),
        Running("pos", "sum", F.lit(1)),
    ]
    # A page record before the session's start is no view; and if the latest page
    # record is one of those, there is no valid view yet.
    viewed = F.struct("latest_view.ts", "latest_view.seq")
    valid_view = F.when(viewed > F.col("started"), F.col("latest_view"))
    return running_steps(
        with_id,
        ["session_id"],
        ["ts", "seq"],
        time_chunk(F.col("ts"), chunk_ms),
        lambda part, scan: then(scan(part, values).withColumn("latest_view", valid_view)),
        known,
    )


def accepted(raw: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    return session_gate(raw, chunk_ms).filter(F.col("started").isNotNull())


def refused(raw: DataFrame, gated: DataFrame) -> DataFrame:
    """Records of ``raw`` without a session id, and those the gate found no start for, with
    their reason and status class."""
    no_id = raw.filter(~S.present(F.coalesce("session_id", F.lit("")))).withColumn(
        "reason", F.lit(MISSING_SESSION)
    )
    early = (
        gated.filter(F.col("started").isNull())
        .drop("started", "latest_view", "pos")
        .withColumn("reason", F.lit(INVALID_SESSION))
    )
    status = F.when(F.col("reason") == INVALID_SESSION, 403).otherwise(400)
    return no_id.unionByName(early).withColumn("status", status)


def rejects(raw: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Refused records with their reason and status class."""
    return refused(raw, session_gate(raw, chunk_ms))


def gate_against(raw: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split records by an existing sessions table: known sessions and starts pass."""
    known = sessions.select("session_id")
    begins = F.coalesce(F.col("event") == START, F.lit(False))
    rest = raw.filter(~begins)
    passed = raw.filter(begins).unionByName(rest.join(known, "session_id", "left_semi"))
    return passed, rest.join(known, "session_id", "left_anti")


def session_bounds(raw: DataFrame, zero_is_null: bool = True) -> DataFrame:
    """Per session: its first start with its context, and its last ``session_end``."""
    r = evolve_schema(raw, schemas.TRACKING).filter(
        F.col("event").isin(START, END) & S.present(F.coalesce("session_id", F.lit("")))
    )
    start = F.struct(
        "ts",
        "seq",
        *[S.text_or_null(F.col(t)).alias(t) for t in CONTEXT_TEXTS],
        *[S.number_or_null(F.col(n), zero_is_null).alias(n) for n in CONTEXT_NUMBERS],
    )
    return r.groupBy("session_id").agg(
        F.min(F.when(F.col("event") == START, start)).alias("s"),
        F.max(F.when(F.col("event") == END, _at())).alias("e"),
    )


def bounds_to_sessions(bounds: DataFrame) -> DataFrame:
    begun = F.struct("s.ts", "s.seq")
    return bounds.filter(F.col("s").isNotNull()).select(
        "session_id",
        F.col("s.ts").alias("start_time"),
        F.when(F.col("e") > begun, F.col("e.ts")).alias("end_time"),
        *[f"s.{t}" for t in (*CONTEXT_TEXTS, *CONTEXT_NUMBERS)],
    )


def fold_sessions(raw: DataFrame, zero_is_null: bool = True) -> DataFrame:
    """One row per started session. The first start wins and supplies the context;
    the last ``session_end`` after it sets ``end_time``. One aggregation, no window."""
    return bounds_to_sessions(session_bounds(raw, zero_is_null))


def view_statements(valid: DataFrame, zero_is_null: bool = True) -> DataFrame:
    """What every accepted record says about a page view.

    A page record opens one; a page or ``session_end`` record with a time spent closes
    the latest earlier view; a ``performance`` record carries vitals for the latest
    view. ``pos`` orders the statements of a session.
    """
    c = F.col
    spent = F.nullif(c("time_spent"), F.lit(0).cast("bigint"))
    vitals = {v: S.number_or_null(c(v), zero_is_null) for v in schemas.VITALS}
    none = F.lit(None).cast("double")
    closes = spent.isNotNull() & (is_view() | (c("event") == END))
    measures = ~is_view() & (c("event") == PERFORMANCE)

    opened = F.struct(
        _view().alias("view"),
        S.parse_int(c("scroll_depth")).cast("int").alias("scroll_depth"),
        spent.alias("time_spent"),
        *[vitals[v].alias(v) for v in schemas.VITALS],
    )
    said = F.struct(
        c("latest_view").alias("view"),
        F.lit(None).cast("int").alias("scroll_depth"),
        F.when(closes, spent).alias("time_spent"),
        *[F.when(measures, vitals[v]).otherwise(none).alias(v) for v in schemas.VITALS],
    )
    statements = F.array_compact(
        F.array(
            F.when(is_view(), opened),
            F.when(c("latest_view").isNotNull() & (closes | measures), said),
        )
    )
    return valid.select("session_id", "pos", F.explode(statements).alias("v")).select(
        "session_id", "pos", "v.*"
    )


def merge_statements(statements: DataFrame, keep_pos: bool = False) -> DataFrame:
    """Page views from statements: per view and field the latest non-missing one wins.
    ``keep_pos`` adds ``pos``, the number of the record that spoke of the view last.
    Views are keyed by (session, ts, seq), so however long a session is, the shuffle is
    balanced. The page is part of the key, and what remains are numbers with a number as
    their order, which aggregate by hash."""
    c = F.col

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(c(name).isNotNull(), c("pos"))).alias(name)

    return (
        statements.groupBy("session_id", "view")
        .agg(
            F.max("scroll_depth").alias("scroll_depth"),
            latest("time_spent"),
            *[latest(v) for v in schemas.VITALS],
            F.max("pos").alias("pos"),
        )
        .select(
            c("view.seq").alias("id"),
            "session_id",
            "view.page",
            c("view.ts").alias("timestamp"),
            "time_spent",
            "scroll_depth",
            *schemas.VITALS,
            *["pos"] * keep_pos,
        )
    )


def fold_page_views(raw: DataFrame, zero_is_null: bool = True, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Page views with everything later records add to them. Ordinary sessions are merged
    where the gate left them, without another shuffle."""

    def merged(gated: DataFrame) -> DataFrame:
        return merge_statements(view_statements(gated.filter("started IS NOT NULL"), zero_is_null))

    return session_gate(evolve_schema(raw, schemas.TRACKING), chunk_ms, then=merged)


def named_events(valid: DataFrame) -> DataFrame:
    """Accepted records with a name, other than session starts and ends."""
    named = S.present(F.coalesce("event", F.lit(""))) & ~F.col("event").isin(START, END)
    return valid.filter(named).select(
        F.col("seq").alias("id"),
        "session_id",
        F.col("event").alias("event_name"),
        S.text_or_null(F.col("element")).alias("element"),
        S.text_or_null(F.col("href")).alias("href"),
        F.col("ts").alias("timestamp"),
    )


def fold_events(raw: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    return named_events(accepted(evolve_schema(raw, schemas.TRACKING), chunk_ms))
