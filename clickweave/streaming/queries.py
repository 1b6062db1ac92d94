"""Streaming queries run to the end of the available data, for the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.operators import behavior
from clickweave.session import scratch_dir
from clickweave.sources.fixtures import view
from clickweave.sources.tables import read_page_views, read_tracking
from clickweave.streaming import ingest, partials

QUOTA_LIMIT, QUOTA_INTERVAL_MS = 2, 86_400_000
#: Parts a table is dealt to, about a micro-batch each; rows of any time are in each of them.
FILES = 3
#: Few buckets for small tables.
BUCKETS = 4
# The interaction views compress a week into two minutes, so chunks shrink as well.
CHUNK = 1_000


def replayed(rows: DataFrame, kind: partials.Partials, key: str, files: int = FILES) -> DataFrame:
    """Results of a stream of ``rows`` in ``files`` micro-batches or a few more, dealt by ``key`` and thus in no
    order. A part of a large table is as many files as it takes tasks to write it."""
    spark = rows.sparkSession
    root = scratch_dir(spark, kind.name)
    dealt = rows.withColumn("file", F.pmod(F.xxhash64(key), F.lit(files)))
    dealt.hint("rebalance", "file").write.partitionBy("file").parquet(f"{root}/rows")
    written = len(spark.read.schema(rows.schema).parquet(f"{root}/rows").inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, written // files)).parquet(f"{root}/rows")
    query = partials.start(stream.select(*rows.columns), f"{root}/partials", f"{root}/checkpoint", kind, BUCKETS)
    query.awaitTermination()
    return partials.results(spark, f"{root}/partials", kind, partials.partial_schema(rows, kind))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_base").select("event_id", "user_id", "ms")


def _interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_interactions").select("view_id", "seq", "ts", "kind", "section", "scroll_pct")


def run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(_base(spark, sf_dir), partials.sessions("user_id", "ms"), "event_id")


def run_over_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = partials.over_quota("user_id", "ms", QUOTA_LIMIT, QUOTA_INTERVAL_MS)
    return replayed(_base(spark, sf_dir), kind, "event_id")


def run_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged vitals of runs of performance entries."""
    samples = behavior.vital_samples(view(spark, sf_dir, "fx_perf_entries"))
    kind = partials.bursts("view_id", behavior.MERGE_WAIT_MS, list(behavior.VITALS), CHUNK)
    return replayed(samples, kind, "seq").select(
        "view_id", "first_ts", "ts", "seq", "n_rows", *[S.fixed(F.col(f), 4).alias(f) for f in behavior.VITALS]
    )


def run_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(_interactions(spark, sf_dir), partials.engagement(), "seq")


def run_bounce_or_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(_interactions(spark, sf_dir), partials.bounce_or_end(), "seq")


def run_time_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(_interactions(spark, sf_dir), partials.time_on_page(), "seq")


def run_section_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(_interactions(spark, sf_dir), partials.section_dwell(CHUNK), "seq")


def run_web_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(view(spark, sf_dir, "fx_perf_entries"), partials.web_vitals(), "seq")


def run_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the raw log as JSON lines, stream it through the fold, return page views."""
    root = scratch_dir(spark, "ingest")
    view(spark, sf_dir, "fx_raw").drop("forwarded_for").write.json(f"{root}/log")
    records = read_tracking(spark, f"{root}/log", stream=True)
    ingest.start(records, f"{root}/tables", f"{root}/checkpoint", buckets=BUCKETS).awaitTermination()
    return read_page_views(spark, f"{root}/tables").select(
        "id", "session_id", "page", "timestamp", "time_spent", "scroll_depth", "ttfb", "cls"
    )
