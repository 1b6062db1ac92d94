"""Incremental fold of the tracking stream into the stored tables.

Each micro-batch is a run of ``jobs.ingest_log``: it takes what it must know of its own
sessions (first start, latest view, number of records) from their hash buckets, folds its
records with the batch operators, and commits all tables at once. There is no Python on the data path.
Runs are named after the stream and the batch, so a batch repeated after a failure changes
nothing; state and corrections are merged level by level (``sources.store``), so the work
of a batch follows its own records, not the age of the stream.

The tables are the stored ones: ``tables.read_sessions`` and the others read them.
Batches arrive in order, as the records of the original do; inside a batch records are
ordered by ``(ts, seq)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clickweave.plans import jobs
from clickweave.sources.store import BUCKETS, FAN_IN


def fold_batch(
    batch: DataFrame, batch_id: int, root: str, stream: str = "tracking", fan_in: int = FAN_IN, buckets: int = BUCKETS
) -> None:
    jobs.ingest_log(batch, root, f"{stream}-{batch_id}", fan_in, buckets)


def start(
    records: DataFrame, root: str, checkpoint: str, stream: str = "tracking", buckets: int = BUCKETS, **trigger
) -> StreamingQuery:
    """Start the ingest of a stream of tracking records."""
    return (
        records.writeStream.foreachBatch(lambda df, n: fold_batch(df, n, root, stream, buckets=buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_requests(
    lines: DataFrame, root: str, checkpoint: str, stream: str = "requests", buckets: int = BUCKETS, **trigger
) -> StreamingQuery:
    """Start the ingest of a stream of request lines, single and batch mixed."""

    def fold(df: DataFrame, n: int) -> None:
        jobs.ingest_requests(df, root, f"{stream}-{n}", FAN_IN, buckets)

    return (
        lines.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
