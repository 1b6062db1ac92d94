"""Derived inputs: clickstream, deployment and text views over the given tables.

Each view is one SQL text for Spark and for the SQL oracle. Only the millisecond
expression differs: ``{ms}`` stands for the event time, ``{ms_o}`` for the order date.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

MILLIS = {
    "spark": "unix_millis(CAST({c} AS TIMESTAMP))",
    "duckdb": "(epoch_us({c}) // 1000)",
}

VIEWS: dict[str, str] = {}

VIEWS["fx_base"] = """
SELECT event_id, user_id, event_type, value, {ms} AS ms,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CAST(floor({ms} / 86400000) AS BIGINT) AS day_no,
  concat(CAST(user_id AS STRING), '-', CAST(CAST(floor({ms} / 86400000) AS BIGINT) AS STRING)) AS day_session,
  concat(CAST(user_id AS STRING), '-w', CAST(CAST(floor({ms} / 604800000) AS BIGINT) AS STRING)) AS week_session
FROM events
"""

VIEWS["fx_sessions"] = """
SELECT day_session AS session_id, min(ms) AS start_time, max(ms) AS end_time,
  CASE user_id % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' WHEN 2 THEN 'desktop' WHEN 3 THEN 'unknown' ELSE NULL END AS device_type,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('NATION_', CAST(user_id % 25 AS STRING)) END AS country
FROM fx_base GROUP BY day_session, user_id
"""

VIEWS["fx_page_views"] = """
SELECT event_id AS id, day_session AS session_id, concat('/p/', CAST(k % 20 AS STRING)) AS page, ms AS timestamp,
  CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS time_spent,
  k AS scroll_depth, value AS ttfb, value * 5 AS fcp, value * 10 AS lcp,
  CASE WHEN k % 4 = 0 THEN NULL ELSE value / 1000 END AS cls,
  CASE WHEN k % 3 = 0 THEN NULL ELSE value / 10 END AS fid
FROM fx_base WHERE event_type = 'view'
"""

VIEWS["fx_events"] = """
SELECT event_id AS id, day_session AS session_id,
  CASE event_type WHEN 'purchase' THEN 'conversion' ELSE event_type END AS event_name,
  CASE WHEN k % 15 = 14 THEN NULL ELSE concat('el_', CAST(k % 15 AS STRING)) END AS element,
  CASE WHEN k % 2 = 0 THEN concat('/p/', CAST(k % 20 AS STRING)) ELSE NULL END AS href, ms AS timestamp
FROM fx_base WHERE event_type <> 'view'
"""

VIEWS["fx_deploys"] = """
SELECT day_no AS id, (day_no + 1) * 86400 AS deploy_time, (day_no + 1) * 86400 - 60 * (1 + day_no % 10) AS build_time,
  CASE WHEN day_no % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN day_no % 3 = 0 THEN 'preview' ELSE 'production' END AS environment,
  concat('c', CAST(day_no AS STRING)) AS commit_sha, 'main' AS branch
FROM (SELECT DISTINCT day_no FROM fx_base) d
"""

VIEWS["fx_deploy_history"] = """
SELECT o_orderkey AS id, CAST(floor({ms_o} / 1000) AS BIGINT) AS deploy_time,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'production' ELSE 'preview' END AS environment,
  concat('c', CAST(o_orderkey AS STRING)) AS commit_sha,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS total_visitors,
  CAST(o_orderkey % 101 AS DOUBLE) AS bounce_rate,
  CAST(o_custkey % 600 AS DOUBLE) AS avg_time_spent_seconds,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 37 AS DOUBLE) END AS conversion_rate
FROM orders
"""

VIEWS["fx_raw"] = """
SELECT CASE WHEN event_id % 50 = 49 THEN NULL ELSE week_session END AS session_id, event_id AS seq, ms AS ts,
  CASE WHEN rn = 1 AND user_id % 10 <> 9 THEN 'session_start'
       WHEN event_type = 'view' THEN 'pageview' WHEN event_type = 'purchase' THEN 'conversion'
       WHEN event_type = 'signup' THEN 'performance' WHEN event_type = 'error' THEN 'session_end' ELSE event_type END AS event,
  CASE WHEN event_type = 'view' THEN concat('/p/', CAST(k % 20 AS STRING)) ELSE NULL END AS page,
  CASE WHEN k % 8 = 0 THEN concat(CAST(k AS STRING), 'px') WHEN k % 8 = 1 THEN 'abc' ELSE CAST(k AS STRING) END AS scroll_depth,
  CASE WHEN event_type IN ('view', 'error') AND k % 3 <> 0 THEN CAST(k * 100 AS BIGINT) ELSE NULL END AS time_spent,
  CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN value ELSE NULL END AS ttfb,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN 0.0 WHEN event_type = 'signup' THEN value / 1000 ELSE NULL END AS cls,
  CASE k % 6 WHEN 0 THEN 'Mozilla/5.0 (iPhone) Mobile' WHEN 1 THEN 'Mozilla/5.0 (iPad)' WHEN 2 THEN 'Mozilla/5.0 Tablet'
    WHEN 3 THEN 'Mozilla/5.0 (X11)' WHEN 4 THEN '' ELSE NULL END AS user_agent,
  CASE k % 3 WHEN 0 THEN ' 10.0.0.1 , 10.0.0.2' WHEN 1 THEN '10.0.0.3' ELSE NULL END AS forwarded_for,
  concat('el_', CAST(k % 15 AS STRING)) AS element
FROM (SELECT b.*, CASE WHEN concat(lpad(CAST(b.ms AS STRING), 15, '0'), lpad(CAST(b.event_id AS STRING), 15, '0')) = f.first_key
    THEN 1 ELSE 2 END AS rn
  FROM fx_base b JOIN (SELECT week_session, min(concat(lpad(CAST(ms AS STRING), 15, '0'), lpad(CAST(event_id AS STRING), 15, '0'))) AS first_key
    FROM fx_base GROUP BY week_session) f ON b.week_session = f.week_session) r
"""

VIEWS["fx_interactions"] = """
SELECT week_session AS view_id, event_id AS seq, CAST(floor((ms % 604800000) / 5000) AS BIGINT) AS ts,
  CASE event_type WHEN 'view' THEN 'scroll' WHEN 'click' THEN 'enter' WHEN 'error' THEN 'leave' WHEN 'signup' THEN 'start' ELSE 'signal' END AS kind,
  CASE WHEN event_type IN ('click', 'error') THEN concat('s', CAST(k % 2 AS STRING)) ELSE NULL END AS section,
  CASE WHEN event_type = 'view' THEN CASE WHEN k >= 95 THEN 100 ELSE k END ELSE NULL END AS scroll_pct, value
FROM fx_base
"""

VIEWS["fx_perf_entries"] = """
SELECT week_session AS view_id, event_id AS seq, CAST(floor((ms % 604800000) / 5000) AS BIGINT) AS ts,
  CASE k % 5 WHEN 0 THEN 'navigation' WHEN 1 THEN 'paint' WHEN 2 THEN 'largest-contentful-paint' WHEN 3 THEN 'layout-shift' ELSE 'first-input' END AS entry_type,
  CASE WHEN k % 5 = 1 AND k % 2 = 1 THEN 'first-contentful-paint' WHEN k % 5 = 1 THEN 'first-paint' ELSE NULL END AS name,
  value * 10 AS start_time, value AS request_start, value * 1.5 AS response_start, value * 10 + 8 AS processing_start,
  value / 1000 AS shift_value, k % 2 = 0 AS had_recent_input
FROM fx_base
"""

VIEWS["fx_ab"] = """
SELECT user_id % 25 AS segment, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, day_session AS session_id,
  max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS converted
FROM fx_base GROUP BY user_id, day_session
"""

VIEWS["fx_repo_files"] = """
SELECT CASE p_partkey % 4 WHEN 0 THEN concat('src/app/d', CAST(p_partkey AS STRING), '/page.tsx')
    WHEN 1 THEN concat('src/app/d', CAST(p_partkey - 1 AS STRING), '/view.tsx')
    WHEN 2 THEN concat('src/lib/m', CAST(p_partkey AS STRING), '.ts') ELSE concat('src/app/_x', CAST(p_partkey AS STRING), '.tsx') END AS path,
  concat('import React from ''react'';', chr(10), 'import View from ''./view'';', chr(10),
    'import { M } from "../../lib/m', CAST(p_partkey + 2 AS STRING), '.ts";', chr(10), 'export const n = ''', p_name, ''';') AS content
FROM part
"""

VIEWS["fx_commits"] = """
SELECT concat('sha', CAST(o_orderkey AS STRING)) AS sha, CAST(floor({ms_o} / 1000) AS BIGINT) AS ts, o_orderkey AS seq,
  concat('Update page', chr(10), 'touches src/app/d', CAST((o_orderkey % 40) * 4 AS STRING), '/page.tsx') AS message
FROM orders
"""

VIEWS["fx_replies"] = """
SELECT conv_id * 1000 + turn AS reply_id,
  CASE WHEN (conv_id + turn) % 5 = 4 THEN concat('Sorry: ', role) ELSE
  concat('Here you go:', chr(10), '```json', chr(10), '{"changes":[{"filePath":"src/app/d', CAST(conv_id % 40 AS STRING),
    '/page.tsx","modifications":[{"type":"', CASE WHEN turn % 2 = 0 THEN 'TEXT_CHANGE' ELSE 'CTA_CHANGE' END,
    '","lineNumber":', CAST(turn + 1 AS STRING), ',"content":"x","reasoning":"', role, '"}],"confidence_score":',
    CASE WHEN turn % 3 = 0 THEN '0' ELSE '0.75' END, '}]}', chr(10), '```', chr(10), 'Done.') END AS raw
FROM conversations
"""

# Requests as the tracking route receives them: header values are text.
VIEWS["fx_requests"] = """
SELECT session_id, seq, ts AS arrival, event, page, scroll_depth, element,
  CAST(time_spent AS STRING) AS time_spent, CAST(ttfb AS STRING) AS ttfb,
  CASE WHEN cls = 0 THEN '0' ELSE CAST(cls AS STRING) END AS cls,
  user_agent, forwarded_for,
  CASE WHEN seq % 4 = 0 THEN '10.9.9.9' ELSE NULL END AS remote_ip,
  CASE seq % 3 WHEN 0 THEN 'DE' WHEN 1 THEN '' ELSE NULL END AS country,
  CASE WHEN seq % 5 = 0 THEN 'mobile' WHEN seq % 5 = 1 THEN '' ELSE NULL END AS device_hint,
  CASE seq % 4 WHEN 0 THEN '0' WHEN 1 THEN '52.5N' WHEN 2 THEN 'north' ELSE NULL END AS latitude
FROM fx_raw
"""

# Which requests are sent in batches, and the time spent as a client may write it.
VIEWS["fx_sent"] = """
SELECT r.*, CAST(floor(seq / 25) AS BIGINT) AS batch_no, CASE WHEN floor(seq / 25) % 2 = 1 THEN 1 ELSE 0 END AS in_batch,
  CASE WHEN time_spent IS NULL THEN NULL WHEN seq % 2 = 0 THEN concat(time_spent, '.5') ELSE time_spent END AS time_sent,
  CASE WHEN seq % 6 = 0 THEN 'https://a.example/' ELSE NULL END AS referrer,
  CASE WHEN seq % 3 = 1 THEN 'Bonn' ELSE NULL END AS city, CASE WHEN seq % 4 = 1 THEN '-7.25' ELSE NULL END AS longitude,
  CASE WHEN seq % 7 = 0 THEN ttfb ELSE NULL END AS fcp
FROM fx_requests r
"""

# A model's answer with a whole source file: prose, fence, code.
VIEWS["fx_code_replies"] = """
SELECT path, CASE WHEN length(path) % 7 = 0 THEN concat('```', chr(10), '```')
  ELSE concat('Here is the file:', chr(10), '```tsx', chr(10), content, chr(10), '```', chr(10)) END AS answer
FROM fx_repo_files
"""


def _needed(names: list[str]) -> list[str]:
    """The named views and all they build on, in order of definition."""
    want, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in want:
            want.add(name)
            todo += [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]
    return [v for v in VIEWS if v in want]


def _text(name: str, engine: str) -> str:
    millis = MILLIS[engine]
    sql = VIEWS[name].strip()
    return sql.replace("{ms}", millis.replace("{c}", "ts")).replace(
        "{ms_o}", millis.replace("{c}", "o_orderdate")
    )


def oracle(names: list[str], body: str) -> str:
    """Oracle query: the named views as WITH clauses, then ``body``, which is either a
    SELECT or starts with further clauses ("name AS (...), ... SELECT")."""
    views = ",\n".join(f"{v} AS ({_text(v, 'duckdb')})" for v in _needed(names))
    glue = "\n" if re.match(r"\s*SELECT\b", body) else ",\n"
    return f"WITH {views}{glue}{body.strip()}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the parquet files below ``sf_dir``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    needed = _needed([name])
    texts = {v: _text(v, "spark") for v in needed}
    base = [
        t for t in TABLES if any(re.search(rf"\bFROM {t}\b", s) for s in texts.values())
    ]
    clauses = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in base]
    clauses += [f"{v} AS ({texts[v]})" for v in needed]
    return spark.sql(f"WITH {', '.join(clauses)} SELECT * FROM {name}")
