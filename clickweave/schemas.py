"""Spark schemas of the stored tables and of the records on the wire."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
}


def _struct(spec: str) -> T.StructType:
    fields = (part.split() for part in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


def _array(spec: str, *more: T.StructField) -> T.ArrayType:
    return T.ArrayType(T.StructType([*_struct(spec).fields, *more]))


SESSIONS = _struct(
    "session_id STRING, start_time BIGINT, end_time BIGINT, user_agent STRING, "
    "ip_address STRING, referrer STRING, device_type STRING, country STRING, "
    "city STRING, latitude DOUBLE, longitude DOUBLE"
)

PAGE_VIEWS = _struct(
    "id BIGINT, session_id STRING, page STRING, timestamp BIGINT, time_spent BIGINT, "
    "scroll_depth INT, ttfb DOUBLE, fcp DOUBLE, lcp DOUBLE, cls DOUBLE, fid DOUBLE"
)

EVENTS = _struct(
    "id BIGINT, session_id STRING, event_name STRING, element STRING, href STRING, "
    "timestamp BIGINT"
)

# First form of the deployment table; the second adds the website columns.
DEPLOYMENTS_V1 = _struct(
    "id BIGINT, deploy_time BIGINT, build_time BIGINT, deployment_duration BIGINT, "
    "status STRING, environment STRING, commit_sha STRING, branch STRING, "
    "metrics_start_time BIGINT, metrics_end_time BIGINT, bounce_rate DOUBLE, "
    "avg_time_spent_seconds DOUBLE, total_visitors BIGINT, conversion_rate DOUBLE, "
    "created_at BIGINT"
)

DEPLOYMENTS = T.StructType(
    DEPLOYMENTS_V1.fields
    + _struct(
        "total_sessions BIGINT, total_pageviews BIGINT, engagement_rate DOUBLE, "
        "avg_time_spent DOUBLE, avg_fcp DOUBLE, avg_lcp DOUBLE, avg_cls DOUBLE, "
        "sessions_change DOUBLE, pageviews_change DOUBLE, bounce_rate_change DOUBLE, "
        "engagement_rate_change DOUBLE"
    ).fields
)

# One tracking record after normalisation. ``seq`` is the record's number in the
# log and breaks ties between records stamped in the same millisecond.
TRACKING = _struct(
    "session_id STRING, seq BIGINT, ts BIGINT, event STRING, page STRING, "
    "scroll_depth STRING, element STRING, href STRING, section STRING, "
    "time_spent BIGINT, user_agent STRING, ip_address STRING, country STRING, "
    "city STRING, latitude DOUBLE, longitude DOUBLE, referrer STRING, "
    "device_type STRING, ttfb DOUBLE, fcp DOUBLE, lcp DOUBLE, cls DOUBLE, fid DOUBLE"
)

# One tracking request as received: header values are text.
REQUEST = _struct(
    "seq BIGINT, arrival BIGINT, session_id STRING, event STRING, page STRING, "
    "scroll_depth STRING, element STRING, href STRING, section STRING, "
    "time_spent STRING, user_agent STRING, forwarded_for STRING, remote_ip STRING, "
    "country STRING, city STRING, latitude STRING, longitude STRING, referrer STRING, "
    "device_hint STRING, ttfb STRING, fcp STRING, lcp STRING, cls STRING, fid STRING"
)

# A request as one line of JSON: header values and, for a batch, the body's text. All values are
# read as text, so that none is lost to its type.
REQUEST_LINE = T.StructType([*[T.StructField(f.name, T.StringType()) for f in REQUEST.fields], T.StructField("body", T.StringType())])

# Body of a batch request: its records as text, and the values of a record as text.
BATCH_BODY = T.StructType([T.StructField("events", T.ArrayType(T.StringType()))])
BATCH_RECORD = _struct(
    "sessionId STRING, event STRING, page STRING, scrollDepth STRING, element STRING, href STRING, section STRING, "
    "timeSpent STRING, ttfb STRING, fcp STRING, lcp STRING, cls STRING, fid STRING"
)

# Reply of the suggestion model. Numbers are read as text and converted later so
# that one ill-typed value does not lose the whole reply.
MODIFICATIONS = _array("type STRING, lineNumber STRING, content STRING, reasoning STRING")
REPLY = T.StructType(
    [
        T.StructField(
            "changes",
            _array(
                "filePath STRING, confidence_score STRING, reasoning STRING",
                T.StructField("modifications", MODIFICATIONS),
            ),
        )
    ]
)

VITALS = ("ttfb", "fcp", "lcp", "cls", "fid")
