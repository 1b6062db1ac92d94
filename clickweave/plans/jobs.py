"""Whole jobs: from the raw log to stored tables, and from tables to a deployment row."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickweave import schemas
from clickweave.functions import scalars as S
from clickweave.operators import deploy, ingest
from clickweave.operators.timeframe import deploy_windows
from clickweave.session import scratch_dir
from clickweave.sources import tables
from clickweave.sources.store import BUCKET, BUCKETS, DATE, Store, bucket_of, buckets_of, parts_of
from clickweave.sources.tables import day_of


#: What later runs have to know of a session: the position of its first start, its latest
#: page view, and its number of records. One row per session and run, merged by key.
POSITION = T.StructType([T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType())])
SESSION_STATE = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("started", POSITION),
        T.StructField("latest_view", T.StructType([*POSITION.fields, T.StructField("page", T.StringType())])),
        T.StructField("pos", T.LongType()),
    ]
)
STATE, KEY = "session_state", ["session_id"]


def merged_state(rows: DataFrame) -> DataFrame:
    values = [F.min("started").alias("started"), F.max("latest_view").alias("latest_view"), F.max("pos").alias("pos")]
    return rows.groupBy("session_id", *[c for c in rows.columns if c == BUCKET]).agg(*values)


def known_sessions(store: Store, log: DataFrame, buckets: int = BUCKETS) -> DataFrame | None:
    """State of the sessions that have records in ``log``, from their buckets only."""
    if not store.has(STATE):
        return None
    here = store.read(STATE, BUCKET, SESSION_STATE, parts=buckets_of(log, KEY, buckets))
    ids = log.select("session_id").distinct()
    return merged_state(here.join(ids, "session_id", "left_semi").drop(BUCKET))


def ingest_requests(lines: DataFrame, root: str, run: str | None = None, fan_in: int = 1, buckets: int = BUCKETS) -> None:
    """Fold lines of JSON, single and batch requests mixed, into the stored tables and dead letters. A line
    is read once."""
    _fold(lines, ingest.read_requests, ingest.split_read, root, run, fan_in, buckets)


def _log_read(raw: DataFrame) -> DataFrame:
    return tables.evolve_schema(raw, schemas.TRACKING).select(*schemas.TRACKING.fieldNames())


def ingest_log(raw: DataFrame, root: str, run: str | None = None, fan_in: int = 1, buckets: int = BUCKETS) -> None:
    """Fold a log into the stored sessions, page views, events and rejects below ``root``.

    Logs may come one after the other: a session goes on where earlier runs left it, and the
    result is that of one log with all records, if each log is later than those before it.
    A session's first start to arrive counts. All tables change at once, when the run
    commits; a run that stopped may be started again under its name, and one that has been
    committed changes nothing. With the default ``fan_in`` the days whose views or sessions are
    corrected are written anew; a greater one (small runs) lets corrections wait in files of
    their own, see ``sources.store``.

    The log as read and the gated records are written once each to the scratch folder, since several
    passes and all tables start from them; however costly the log is to read, it is read once, and a lost
    executor costs no second pass over it.
    """
    _fold(raw, _log_read, lambda log: (log, None), root, run, fan_in, buckets)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written to the scratch folder and read from there."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fold(
    source: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]],
    root: str,
    run: str | None,
    fan_in: int,
    buckets: int,
) -> None:
    """Fold ``source`` into the stored tables. ``read`` makes the rows that are kept, ``split`` the log and the dead
    letters of these, which are stored in the same run."""
    store = Store(source.sparkSession, root)
    change = store.begin(run or uuid.uuid4().hex)
    if change is None:
        return
    raw, dead = split(_kept(read(source), "log"))
    log = _log_read(raw)
    known = known_sessions(store, log, buckets)
    gated = _kept(ingest.session_gate(log, known=known), "gated")
    valid = gated.filter("started IS NOT NULL")

    sessions, ended_days = _session_rows(valid, known)
    change.merge(
        tables.dated(sessions, schemas.SESSIONS, "start_time"), "sessions", DATE, tables.merged_sessions, ended_days, fan_in,
        lambda rows: tables.laid_out(rows, schemas.SESSIONS, "start_time"),
    )
    views = ingest.merge_statements(ingest.view_statements(valid), keep_pos=True)
    stated_days = set()
    if known is not None:
        latest = known.select("session_id", F.col("latest_view.ts").alias("timestamp"), F.col("latest_view.seq").alias("id"))
        stated_days = parts_of(views.join(latest, ["session_id", "timestamp", "id"], "left_semi").select(day_of("timestamp").alias(DATE)), DATE)
    change.merge(
        tables.dated(views, tables.STORED_VIEWS, "timestamp"), "page_views", DATE, tables.merged_views, stated_days, fan_in,
        lambda rows: tables.laid_out(rows, tables.STORED_VIEWS, "timestamp"),
    )
    change.add(tables.laid_out(ingest.named_events(valid), schemas.EVENTS, "timestamp"), "events")
    refused = ingest.refused(log, gated)
    change.add(tables.laid_out(refused, tables.STORED_REJECTS, "ts"), "rejects")
    if dead is not None:
        change.add(dead.withColumn(DATE, day_of("arrival")), "dead_letters")
    change.merge(_state_rows(valid, known).withColumn(BUCKET, bucket_of(KEY, buckets)), STATE, BUCKET, merged_state)
    change.commit()


def _session_rows(valid: DataFrame, known: DataFrame | None) -> tuple[DataFrame, set[str]]:
    """New sessions, and ends of stored ones beside the start they are stored under, with the days of those."""
    bounds = ingest.session_bounds(valid)
    if known is None:
        return ingest.bounds_to_sessions(bounds), set()
    told = bounds.join(known.select("session_id", F.col("started").alias("before")), "session_id", "left")
    fresh = ingest.bounds_to_sessions(told.filter("before IS NULL").drop("before"))
    ended = told.filter("before IS NOT NULL AND e > before").select(
        "session_id", F.col("before.ts").alias("start_time"), F.col("e.ts").alias("end_time")
    )
    days = parts_of(ended.select(day_of("start_time").alias(DATE)), DATE)
    return fresh.unionByName(ended, allowMissingColumns=True), days


def _state_rows(valid: DataFrame, known: DataFrame | None) -> DataFrame:
    """State of the sessions of a run. A start counts when it arrives, however early it is stamped."""
    view = F.when(ingest.is_view(), F.struct("ts", "seq", "page"))
    rows = valid.groupBy("session_id").agg(
        F.min("started").alias("started"), F.max(view).alias("latest_view"), F.max("pos").alias("pos")
    )
    if known is None:
        return rows
    before = known.select("session_id", F.col("started").alias("before"))
    first = F.coalesce("before", "started")
    return rows.join(before, "session_id", "left").withColumn("started", first).drop("before")


def with_device(sessions: DataFrame) -> DataFrame:
    """Sessions whose device is detected from the user agent where none was recorded."""
    return sessions.withColumn("device_type", S.device_type(F.col("user_agent"), F.col("device_type")))


def record_deployment(deployment: DataFrame, deploy_time_s: int, root: str) -> None:
    """Roll up the day before a deployment from the stored tables and append the row."""
    spark = deployment.sparkSession
    current, _ = deploy_windows(deploy_time_s)
    views, events = tables.read_page_views(spark, root), tables.read_events(spark, root)
    rollup = deploy.stamped(deploy.deployment_rollup(views, events, current), current)
    tables.append_deployments(deploy.deployment_record(deployment, rollup), root)
