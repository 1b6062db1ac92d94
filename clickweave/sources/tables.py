"""Readers and sinks of the stored tables (parquet) and of the record log (JSON).

Time-stamped tables are partitioned by ``event_date``, so a time filter prunes whole
folders, and sorted by session inside each file, so row-group statistics stay narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickweave import schemas
from clickweave.sources.store import DATE, Store, exists

TIME_COLUMN = {"sessions": "start_time", "page_views": "timestamp", "events": "timestamp"}

DAY_MS = 86_400_000


def evolve_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as NULL. Others are kept."""
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def _dated(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(DATE, T.DateType())])


# What is stored of a page view besides its columns: the number of the record, within its
# session, that spoke of it last.
STORED_VIEWS = T.StructType([*schemas.PAGE_VIEWS.fields, T.StructField("pos", T.LongType())])
STORED_REJECTS = T.StructType(
    [*schemas.TRACKING.fields, T.StructField("reason", T.StringType()), T.StructField("status", T.IntegerType())]
)


def merged_sessions(rows: DataFrame) -> DataFrame:
    """One row per session: its start with its context, and the latest end. A later run only
    says the end, beside the start it was stored under."""
    told = [f for f in schemas.SESSIONS.fieldNames() if f not in ("session_id", "start_time", "end_time")]
    return rows.groupBy("session_id", "start_time", DATE).agg(
        F.max("end_time").alias("end_time"), *[F.first(c, ignorenulls=True).alias(c) for c in told]
    )


def merged_views(rows: DataFrame) -> DataFrame:
    """One row per page view: of every field the latest value that is not missing."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    return rows.groupBy("id", "session_id", "page", "timestamp", DATE).agg(
        F.max("scroll_depth").alias("scroll_depth"), latest("time_spent"), *[latest(v) for v in schemas.VITALS],
        F.max("pos").alias("pos"),
    )


def _read_dated(spark: SparkSession, root: str, table: str, schema: T.StructType, stored: T.StructType, merged) -> DataFrame:
    """A table of a store with commits, or plain folders that were only appended to."""
    store = Store(spark, root)
    if store.has(table):
        return store.read(table, DATE, stored, merged).select(*_dated(schema).fieldNames())
    return spark.read.schema(_dated(schema)).parquet(f"{root}/{table}")


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    return _read_dated(spark, root, "sessions", schemas.SESSIONS, schemas.SESSIONS, merged_sessions)


def read_page_views(spark: SparkSession, root: str) -> DataFrame:
    return _read_dated(spark, root, "page_views", schemas.PAGE_VIEWS, STORED_VIEWS, merged_views)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return _read_dated(spark, root, "events", schemas.EVENTS, schemas.EVENTS, None)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Refused records as they came, with their reason and status class."""
    return _read_dated(spark, root, "rejects", STORED_REJECTS, STORED_REJECTS, None)


DEAD_LETTERS = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("status", T.IntegerType()),
    ]
)


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """Requests that could not be read, as they came."""
    return _read_dated(spark, root, "dead_letters", DEAD_LETTERS, DEAD_LETTERS, None)


def read_request_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests, single and batch mixed, as lines of text."""
    return (spark.readStream if stream else spark.read).text(path)


def read_deployments(spark: SparkSession, root: str) -> DataFrame:
    """Deployment history in its widest form; columns an old file lacks read as NULL."""
    return spark.read.schema(schemas.DEPLOYMENTS).parquet(f"{root}/deployment_metrics")


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Tracking requests as JSON lines, header values as text."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.REQUEST).json(path)


def read_tracking(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Normalised tracking records as JSON lines."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.TRACKING).json(path)


def day_of(time: str) -> Column:
    """The UTC day, whatever the time zone of the session."""
    return F.date_from_unix_date(F.floor(F.col(time) / DAY_MS).cast("int"))


def dated(df: DataFrame, schema: T.StructType, time: str) -> DataFrame:
    """Columns of ``schema`` and the day."""
    return evolve_schema(df, schema).select(*schema.fieldNames()).withColumn(DATE, day_of(time))


def laid_out(df: DataFrame, schema: T.StructType, time: str) -> DataFrame:
    """Columns of ``schema`` and the day, in the order they are stored in."""
    return (
        dated(df, schema, time)
        # Few files per folder; a busy day, and even a busy session within it, is still
        # written by many tasks, since the time is part of the range.
        .repartitionByRange(DATE, "session_id", time)
        .sortWithinPartitions(DATE, "session_id", time)
    )


def _append_dated(df: DataFrame, root: str, table: str, schema: T.StructType) -> None:
    rows = laid_out(df, schema, TIME_COLUMN[table])
    rows.write.mode("append").partitionBy(DATE).parquet(f"{root}/{table}")


def append_sessions(df: DataFrame, root: str) -> None:
    _append_dated(df, root, "sessions", schemas.SESSIONS)


def append_page_views(df: DataFrame, root: str) -> None:
    _append_dated(df, root, "page_views", schemas.PAGE_VIEWS)


def append_events(df: DataFrame, root: str) -> None:
    _append_dated(df, root, "events", schemas.EVENTS)


def append_deployments(df: DataFrame, root: str) -> None:
    """Append deployment rows. Rows may have only some of the columns; a missing
    ``created_at`` becomes the time of writing, a missing ``id`` a hash of environment,
    deploy time and commit. Rows whose id is stored already are not stored again."""
    now = F.unix_seconds(F.current_timestamp())
    row = evolve_schema(df, schemas.DEPLOYMENTS).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.DEPLOYMENTS.fields]
    )
    key = F.abs(F.xxhash64("environment", "deploy_time", "commit_sha") % 2**53)
    rows = row.withColumns({"created_at": F.coalesce("created_at", now), "id": F.coalesce("id", key)}).dropDuplicates(["id"])
    path = f"{root}/deployment_metrics"
    if exists(df.sparkSession, path):
        rows = rows.join(read_deployments(df.sparkSession, root).select("id"), "id", "left_anti")
    rows.select(*schemas.DEPLOYMENTS.fieldNames()).write.mode("append").parquet(path)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, location: str) -> None:
    """Create an external parquet table unless it exists."""
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=location, source="parquet", schema=schema)
