"""SQL oracle: for each registered query the same result in plain SQL.

Written apart from the operators: per-row windows, plain joins and range joins where the
operators use running values, pre-aggregation or step sums.
"""

from __future__ import annotations

from clickweave.operators.timeframe import ALL_TIME, DAY_MS, Timeframe, deploy_windows
from clickweave.plans import catalog as C
from clickweave.sources.fixtures import oracle
from clickweave.streaming import queries as streams

# Fixed values, stated here apart from the code they test: leading numbers, refusals, when a view is
# engaged, z values of confidence levels, the error function's coefficients, import lines, starts of code.
INT_PREFIX = r"^\s*([+-]?[0-9]+)"
FLOAT_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
MISSING_SESSION, INVALID_SESSION = "Missing required session ID", "Invalid session"
ENGAGED_ABOVE = 10
Z = {0.80: 1.28, 0.85: 1.44, 0.90: 1.645, 0.95: 1.96, 0.99: 2.576, 0.999: 3.291}
OTHER_Z = 1.96
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_T = 0.3275911
IMPORT_LINE = r"""import\s+(?:\{[^}]+\}|\w+)\s+from\s+['"]([^'"]+)['"]"""
CODE_START = r"(?i)((?:import|export|class|function|const|let|var|/\*|//|<!DOCTYPE|<\?|<html)[\s\S]*)"


def fixed(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(20,8)), {places}) AS DOUBLE)"


def ratio(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0))"


def pct(n: str, d: str) -> str:
    return fixed(f"{ratio(n, d)} * 100", 2)


def between(column: str, tf: Timeframe) -> str:
    parts = []
    if tf.lo is not None:
        parts.append(f"{column} >= {tf.lo}")
    if tf.hi is not None:
        parts.append(f"{column} <= {tf.hi}")
    return " AND ".join(parts) or "1 = 1"


def bigint(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# --- site ---------------------------------------------------------------------


def _site_sql(tf: Timeframe) -> dict[str, str]:
    s, p = between("s.start_time", tf), between("pv.timestamp", tf)
    where_counts = f"WHERE {s} AND {p}" if tf.bounded else ""
    visitors = f"(SELECT count(DISTINCT session_id) FROM fx_sessions s WHERE {s})"
    return {
        "total_visitors": f"SELECT count(DISTINCT session_id) AS total_visitors FROM fx_sessions s WHERE {s}",
        "bounce_rate": f"""SELECT {pct("sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)", "count(*)")} AS bounce_rate FROM (
            SELECT s.session_id, count(pv.id) AS n FROM fx_sessions s
            LEFT JOIN fx_page_views pv ON s.session_id = pv.session_id {where_counts} GROUP BY s.session_id) t""",
        "avg_time": f"""SELECT avg(span) / 1000 AS avg_time_spent_seconds FROM (
            SELECT session_id, max(timestamp) - min(timestamp) AS span FROM fx_page_views pv
            WHERE {p} GROUP BY session_id HAVING count(*) > 1) t""",
        "top_pages": f"""SELECT page, count(*) AS views FROM fx_page_views pv WHERE {p}
            GROUP BY page ORDER BY views DESC, page ASC NULLS LAST LIMIT 10""",
        "ctr": f"""SELECT element, clicks, {pct("clicks", visitors)} AS ctr FROM (
            SELECT e.element, count(*) AS clicks FROM fx_events e JOIN fx_sessions s ON e.session_id = s.session_id
            WHERE e.event_name = 'click' AND {s} GROUP BY e.element
            ORDER BY clicks DESC, e.element ASC NULLS LAST LIMIT 10) t""",
        "device_breakdown": f"""SELECT coalesce(raw, 'unknown') AS device_type, n AS count FROM (
            SELECT device_type AS raw, count(*) AS n FROM fx_sessions s WHERE {s} GROUP BY device_type) t""",
        "country_breakdown": f"""SELECT coalesce(raw, 'unknown') AS country, n AS count FROM (
            SELECT country AS raw, count(*) AS n FROM fx_sessions s WHERE {s} GROUP BY country) t""",
        "conversion_rate": f"""SELECT {pct(f'''(SELECT count(DISTINCT e.session_id) FROM fx_events e
            JOIN fx_sessions s ON e.session_id = s.session_id WHERE e.event_name = 'conversion' AND {s})''', visitors)}
            AS conversion_rate""",
    }


def _report(parts: dict[str, str]) -> str:
    def scalar(section: str, sql: str, column: str) -> str:
        return (
            f"SELECT '{section}' AS section, CAST(NULL AS VARCHAR) AS key, "
            f"coalesce(CAST((SELECT {column} FROM ({sql}) q) AS DOUBLE), 0) AS value, CAST(NULL AS DOUBLE) AS rate"
        )

    def entries(section: str, sql: str, key: str, value: str, rate: str = "CAST(NULL AS DOUBLE)") -> str:
        return f"SELECT '{section}' AS section, {key} AS key, CAST({value} AS DOUBLE) AS value, {rate} AS rate FROM ({sql}) q"

    return " UNION ALL ".join(
        [
            scalar("total_visitors", parts["total_visitors"], "total_visitors"),
            scalar("bounce_rate", parts["bounce_rate"], "bounce_rate"),
            scalar("conversion_rate", parts["conversion_rate"], "conversion_rate"),
            scalar("avg_time_spent_seconds", parts["avg_time"], "avg_time_spent_seconds"),
            entries("top_pages", parts["top_pages"], "page", "views"),
            entries("click_through_rates", parts["ctr"], "element", "clicks", "ctr"),
            entries("device_breakdown", parts["device_breakdown"], "device_type", "count"),
            entries("country_breakdown", parts["country_breakdown"], "country", "count"),
        ]
    )


ONE_DECIMAL = "CAST(CAST(round(CAST({x} AS DECIMAL(20,8)), 1) AS DECIMAL(20,1)) AS VARCHAR)"


def _label(x: str) -> str:
    return ONE_DECIMAL.replace("{x}", x)


def _site() -> dict[str, str]:
    views = ["fx_sessions", "fx_page_views", "fx_events"]
    out = {}
    for suffix, tf in (("", ALL_TIME), ("_window", C.WEEK)):
        parts = _site_sql(tf)
        out |= {f"site_{k}{suffix}": oracle(views, sql) for k, sql in parts.items()}
        out[f"site_report_long{suffix}"] = oracle(views, _report(parts))
    report = _report(_site_sql(C.WEEK))
    out["site_report_from_partials"] = oracle(views, report)
    out["site_report_from_partials_all"] = oracle(views, _report(_site_sql(ALL_TIME)))
    out["site_total_visitors_7d"] = oracle(
        ["fx_sessions"], f"""SELECT count(DISTINCT session_id) AS total_visitors FROM fx_sessions
        WHERE start_time BETWEEN {C.NOW - 7 * DAY_MS} AND {C.NOW}"""
    )
    one = lambda section: f"(SELECT max(value) FROM r WHERE section = '{section}')"
    out["site_report_nested"] = oracle(
        views,
        f"""r AS ({report}) SELECT CAST({one("total_visitors")} AS BIGINT) AS total_visitors, {one("bounce_rate")} AS bounce_rate,
        {one("conversion_rate")} AS conversion_rate,
        CAST((SELECT count(*) FROM r WHERE section = 'country_breakdown') AS INTEGER) AS n_countries,
        key AS page, CAST(value AS BIGINT) AS views FROM r WHERE section = 'top_pages'""",
    )
    out["display_kpis"] = oracle(
        views,
        f"""SELECT section, CASE WHEN section = 'device_breakdown' THEN concat(upper(key[1]), key[2:]) ELSE key END AS key,
        CASE WHEN section IN ('bounce_rate', 'conversion_rate') THEN concat({_label("value")}, '%')
          WHEN section = 'avg_time_spent_seconds' THEN concat(CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR), 's')
          WHEN section = 'click_through_rates' THEN concat(CAST(CAST(value AS BIGINT) AS VARCHAR), ' (', {_label("rate")}, '%)')
          ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS label FROM ({report}) r""",
    )
    return out


# --- ingest -------------------------------------------------------------------

# Accepted records, page views numbered per session, and per record the number of the
# latest view before it.
def _fold_ctes(source: str, vitals: tuple[str, ...]) -> str:
    """Accepted records, views numbered per session, and what later records say about them."""
    last = "last({v} ORDER BY ts, seq) FILTER (WHERE {v} IS NOT NULL{more}) AS {name}"
    perf = [last.format(v=v, more=f" AND {v} <> 0", name=v) for v in vitals]
    perf += [last.format(v=v, more="", name=f"{v}_keep") for v in vitals]
    values = [f"coalesce(perf.{v}, nullif(v.{v}, 0)) AS {v}, coalesce(perf.{v}_keep, v.{v}) AS {v}_keep" for v in vitals]
    return FOLD_TEXT.replace("{source}", source).replace("{perf}", ", ".join(perf)).replace("{vitals}", ", ".join(values))


FOLD_TEXT = """
g AS (SELECT *, max(CASE WHEN event = 'session_start' THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS ok
  FROM {source} WHERE session_id IS NOT NULL AND session_id <> ''),
a AS (SELECT *, (page IS NOT NULL AND page <> '' AND event NOT IN ('session_start', 'session_end')) AS is_view
  FROM g WHERE ok = 1),
u AS (SELECT *, coalesce(sum(CASE WHEN is_view THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS views_before
  FROM a),
v AS (SELECT *, views_before + 1 AS vn FROM u WHERE is_view),
spent AS (SELECT session_id, views_before AS vn, last(time_spent ORDER BY ts, seq) AS time_spent FROM u
  WHERE time_spent <> 0 AND views_before > 0 AND (is_view OR event = 'session_end') GROUP BY session_id, views_before),
perf AS (SELECT session_id, views_before AS vn,
    {perf}
  FROM u WHERE event = 'performance' AND NOT is_view AND views_before > 0 GROUP BY session_id, views_before),
views AS (SELECT v.seq AS id, v.session_id, v.page, v.ts AS timestamp,
    coalesce(spent.time_spent, nullif(v.time_spent, 0)) AS time_spent,
    TRY_CAST(nullif(regexp_extract(v.scroll_depth, '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER) AS scroll_depth,
    {vitals}
  FROM v LEFT JOIN spent USING (session_id, vn) LEFT JOIN perf USING (session_id, vn)),
starts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS rn
  FROM a WHERE event = 'session_start') q WHERE rn = 1),
ends AS (SELECT session_id, last(ts ORDER BY ts, seq) AS end_time FROM a WHERE event = 'session_end' GROUP BY session_id)
"""
FOLD = _fold_ctes("fx_raw", ("ttfb", "cls"))


def _fold(select: str) -> str:
    return oracle(["fx_raw"], f"{FOLD.strip()}\n{select}")


def _device(ua: str, hint: str = "NULL") -> str:
    return f"""coalesce(nullif({hint}, ''), CASE WHEN {ua} IS NULL OR {ua} = '' THEN 'unknown'
        WHEN lower({ua}) LIKE '%mobile%' THEN 'mobile'
        WHEN lower({ua}) LIKE '%tablet%' OR lower({ua}) LIKE '%ipad%' THEN 'tablet' ELSE 'desktop' END)"""


def _float(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{FLOAT_PREFIX}', 1), '') AS DOUBLE)"


def _mixed(select: str) -> str:
    """The fold over the records of single and batch requests."""
    whole = 1 << 20
    of_batch = "PARTITION BY session_id, batch_no"

    def shared(column: str) -> str:
        return f"CASE WHEN in_batch = 1 THEN first_value({column}) OVER ({of_batch}, in_batch ORDER BY seq) ELSE {column} END AS {column}"

    context = ("user_agent", "forwarded_for", "remote_ip", "country", "city", "latitude", "longitude", "referrer", "device_hint")
    vitals = ("ttfb", "fcp", "cls")
    text = f"""sent AS (SELECT session_id, batch_no, in_batch, event, page, scroll_depth, element, time_sent, {", ".join(vitals)},
          CASE WHEN in_batch = 1 THEN min(seq) OVER ({of_batch}, in_batch) * {whole} + row_number() OVER ({of_batch}, in_batch ORDER BY seq) - 1
            ELSE seq * {whole} END AS seq,
          CASE WHEN in_batch = 1 THEN max(arrival) OVER ({of_batch}, in_batch) ELSE arrival END AS ts,
          {", ".join(shared(c) for c in context)} FROM fx_sent),
        mixed AS (SELECT session_id, seq, ts, event, page, scroll_depth, element,
          TRY_CAST(nullif(regexp_extract(time_sent, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS time_spent,
          {", ".join(f"{_float(v)} AS {v}" for v in vitals)}, user_agent,
          coalesce(nullif(trim(split_part(forwarded_for, ',', 1)), ''), nullif(remote_ip, ''), 'unknown') AS ip_address,
          coalesce(nullif(country, ''), 'Unknown') AS country, coalesce(nullif(city, ''), 'Unknown') AS city,
          {_float("latitude")} AS latitude, {_float("longitude")} AS longitude, referrer,
          {_device("user_agent", "device_hint")} AS device_type FROM sent),
        {_fold_ctes("mixed", vitals).strip()}
        {select}"""
    return oracle(["fx_sent"], text)


def _ingest() -> dict[str, str]:
    no_id = "(session_id IS NULL OR session_id = '')"
    folded = _site_sql(ALL_TIME)
    rename = {
        "fx_sessions": "folded_sessions", "fx_page_views": "views", "fx_events": "folded_events",
    }
    report = _report(folded)
    for old, new in rename.items():
        report = report.replace(old, new)
    batch = f"PARTITION BY session_id, seq // {C.BATCH_SIZE}"
    return {
        "ingest_normalize": oracle(
            ["fx_requests"],
            f"""SELECT session_id, seq, arrival AS ts, nullif(event, '') AS event, nullif(page, '') AS page,
            nullif(scroll_depth, '') AS scroll_depth, nullif(element, '') AS element,
            TRY_CAST(nullif(regexp_extract(time_spent, '{INT_PREFIX}', 1), '') AS BIGINT) AS time_spent,
            coalesce(nullif(trim(split_part(forwarded_for, ',', 1)), ''), nullif(remote_ip, ''), 'unknown') AS ip_address,
            coalesce(nullif(country, ''), 'Unknown') AS country, 'Unknown' AS city, {_float("latitude")} AS latitude,
            {_device("user_agent", "device_hint")} AS device_type, {_float("ttfb")} AS ttfb, {_float("cls")} AS cls
            FROM fx_requests""",
        ),
        "event_time": oracle(
            ["fx_requests"],
            "SELECT seq, CASE WHEN seq % 3 = 1 AND arrival <> 5 THEN arrival - 5 ELSE arrival END AS event_time FROM fx_requests",
        ),
        "ingest_explode_batch": oracle(
            ["fx_raw"],
            f"""SELECT session_id, seq // {C.BATCH_SIZE} AS batch_no,
            CAST(row_number() OVER ({batch} ORDER BY seq) - 1 AS INTEGER) AS pos, max(ts) OVER ({batch}) AS ts,
            min(user_agent) OVER ({batch}) AS user_agent, event, page, element, scroll_depth, time_spent, ttfb, cls
            FROM fx_raw WHERE session_id IS NOT NULL""",
        ),
        "ingest_explode_batch_refused": oracle(
            ["fx_raw"],
            f"""SELECT seq // {C.BATCH_SIZE} AS batch_no, max(ts) AS arrival, '{MISSING_SESSION}' AS reason
            FROM fx_raw WHERE session_id IS NULL GROUP BY seq // {C.BATCH_SIZE}""",
        ),
        "ingest_rejects": _fold(
            f"""SELECT session_id, seq, ts, '{MISSING_SESSION}' AS reason, 400 AS status FROM fx_raw WHERE {no_id}
            UNION ALL SELECT session_id, seq, ts, '{INVALID_SESSION}', 403 FROM g WHERE ok = 0"""
        ),
        "ingest_gate_known": _fold(
            f"""SELECT session_id, seq, (event = 'session_start' OR session_id IN (SELECT session_id FROM starts)) AS passed
            FROM fx_raw WHERE NOT {no_id}"""
        ),
        "requests_to_sessions": _mixed(
            """SELECT s.session_id, s.ts AS start_time, e.end_time, nullif(s.user_agent, '') AS user_agent, ip_address, referrer,
            device_type, country, city, nullif(latitude, 0) AS latitude, nullif(longitude, 0) AS longitude
            FROM starts s LEFT JOIN ends e ON s.session_id = e.session_id"""
        ),
        "requests_to_page_views": _mixed(
            """SELECT id, session_id, page, timestamp, time_spent, scroll_depth, ttfb, fcp, CAST(NULL AS DOUBLE) AS lcp, cls,
            CAST(NULL AS DOUBLE) AS fid FROM views"""
        ),
        "requests_to_events": _mixed(
            """SELECT seq AS id, session_id, event AS event_name, nullif(element, '') AS element, ts AS timestamp
            FROM a WHERE event NOT IN ('session_start', 'session_end')"""
        ),
        "requests_to_dead_letters": oracle(
            ["fx_sent"],
            """SELECT max(arrival) AS arrival, 'Missing required session ID' AS reason, 400 AS status FROM fx_sent
            WHERE in_batch = 1 AND session_id IS NULL GROUP BY batch_no
            UNION ALL SELECT NULL, 'Unreadable request', 500 FROM fx_sent WHERE seq % 40 = 0""",
        ),
        "ingest_two_logs_sessions": _fold(
            """SELECT s.session_id, s.ts AS start_time, e.end_time, nullif(s.user_agent, '') AS user_agent
            FROM starts s LEFT JOIN ends e ON s.session_id = e.session_id"""
        ),
        "ingest_two_logs_page_views": _fold(
            "SELECT id, session_id, page, timestamp, time_spent, scroll_depth, ttfb, cls FROM views"
        ),
        "ingest_two_logs_events": _fold(
            """SELECT seq AS id, session_id, event AS event_name, nullif(element, '') AS element, ts AS timestamp
            FROM a WHERE event NOT IN ('session_start', 'session_end')"""
        ),
        "ingest_two_logs_rejects": _fold(
            f"""SELECT session_id, seq, ts, event, '{MISSING_SESSION}' AS reason, 400 AS status FROM fx_raw WHERE {no_id}
            UNION ALL SELECT session_id, seq, ts, event, '{INVALID_SESSION}', 403 FROM g WHERE ok = 0"""
        ),
        "fold_sessions": _fold("SELECT session_id, ts AS start_time, nullif(user_agent, '') AS user_agent FROM starts"),
        "fold_session_end": _fold(
            "SELECT s.session_id, s.ts AS start_time, e.end_time FROM starts s LEFT JOIN ends e ON s.session_id = e.session_id"
        ),
        "fold_page_views": _fold("SELECT id, session_id, page, timestamp, scroll_depth FROM views"),
        "fold_time_spent": _fold("SELECT id, session_id, time_spent FROM views"),
        "fold_performance": _fold("SELECT id, session_id, ttfb, cls FROM views"),
        "fold_performance_keep_zero": _fold(
            "SELECT id, session_id, ttfb_keep AS ttfb, cls_keep AS cls FROM views"
        ),
        "fold_events": _fold(
            """SELECT seq AS id, session_id, event AS event_name, nullif(element, '') AS element, ts AS timestamp
            FROM a WHERE event NOT IN ('session_start', 'session_end')"""
        ),
        "ingest_stream": _fold(
            "SELECT id, session_id, page, timestamp, time_spent, scroll_depth, ttfb, cls FROM views"
        ),
        "raw_to_site_report": oracle(
            ["fx_raw"],
            f"""{FOLD.strip()},
            folded_sessions AS (SELECT session_id, ts AS start_time, {_device("user_agent")} AS device_type,
              CAST(NULL AS VARCHAR) AS country FROM starts),
            folded_events AS (SELECT seq AS id, session_id, event AS event_name, nullif(element, '') AS element
              FROM a WHERE event NOT IN ('session_start', 'session_end'))
            {report}""",
        ),
    }


# --- deployments ----------------------------------------------------------------


def _page_metrics(tf: Timeframe) -> str:
    return f"""SELECT count(DISTINCT session_id) AS total_sessions, count(*) AS total_pageviews,
        count(DISTINCT CASE WHEN time_spent > {ENGAGED_ABOVE} THEN session_id END) AS engaged_sessions,
        {fixed("avg(time_spent)", 4)} AS avg_time_spent, {fixed("avg(fcp)", 4)} AS avg_fcp,
        {fixed("avg(lcp)", 4)} AS avg_lcp, {fixed("avg(cls)", 4)} AS avg_cls
        FROM fx_page_views WHERE timestamp BETWEEN {tf.lo} AND {tf.hi}"""


def _bounced(tf: Timeframe) -> str:
    return f"""SELECT s.session_id FROM fx_sessions s LEFT JOIN fx_page_views pv ON s.session_id = pv.session_id
        WHERE s.start_time BETWEEN {tf.lo} AND {tf.hi} GROUP BY s.session_id HAVING count(pv.id) = 1"""


def _window(tf: Timeframe) -> str:
    return f"""SELECT *, {pct("bounced_sessions", "total_sessions")} AS bounce_rate,
        {pct("engaged_sessions", "total_sessions")} AS engagement_rate
        FROM (SELECT pm.*, (SELECT count(*) FROM ({_bounced(tf)}) b) AS bounced_sessions FROM ({_page_metrics(tf)}) pm) w"""


def _comparison() -> str:
    cur, prev = deploy_windows(C.DEPLOY_TIME)

    def change(column: str) -> str:
        diff = f"CAST(c.{column} AS DOUBLE) - CAST(p.{column} AS DOUBLE)"
        return f"CASE WHEN p.{column} = 0 THEN 0.0 ELSE {pct(diff, f'p.{column}')} END"

    def points(column: str) -> str:
        return fixed(f"coalesce(c.{column}, 0) - coalesce(p.{column}, 0)", 2)

    return f"""SELECT c.total_sessions, c.total_pageviews, c.bounce_rate, c.engagement_rate, c.avg_time_spent,
        c.avg_fcp, c.avg_lcp, c.avg_cls,
        {change("total_sessions")} AS sessions_change, {change("total_pageviews")} AS pageviews_change,
        {points("bounce_rate")} AS bounce_rate_change, {points("engagement_rate")} AS engagement_rate_change,
        CAST({cur.lo} AS BIGINT) AS metrics_start_time, CAST({cur.hi} AS BIGINT) AS metrics_end_time
        FROM ({_window(cur)}) c, ({_window(prev)}) p"""


def _literal_rollup(tf: Timeframe) -> str:
    w = lambda c: f"{c} >= {tf.lo} AND {c} <= {tf.hi}"
    visitors = "count(DISTINCT pv.session_id)"
    return f"""SELECT {visitors} AS total_visitors,
        coalesce({pct("sum(CASE WHEN sp.n = 1 THEN 1 ELSE 0 END)", visitors)}, 0) AS bounce_rate,
        coalesce({fixed("avg(CASE WHEN st.duration IS NOT NULL THEN st.duration ELSE 0 END) / 1000", 2)}, 0) AS avg_time_spent_seconds,
        coalesce({pct("count(DISTINCT CASE WHEN e.event_name = 'conversion' THEN pv.session_id END)", visitors)}, 0) AS conversion_rate
        FROM fx_page_views pv
        LEFT JOIN (SELECT session_id, count(*) AS n FROM fx_page_views WHERE {w("timestamp")} GROUP BY session_id) sp
          ON pv.session_id = sp.session_id
        LEFT JOIN (SELECT session_id, max(timestamp) - min(timestamp) AS duration FROM fx_page_views
          WHERE {w("timestamp")} GROUP BY session_id HAVING count(*) > 1) st ON pv.session_id = st.session_id
        LEFT JOIN fx_events e ON e.session_id = pv.session_id AND {w("e.timestamp")}
        WHERE {w("pv.timestamp")}"""


def _rollup(tf: Timeframe) -> str:
    w = lambda c: f"{c} >= {tf.lo} AND {c} <= {tf.hi}"
    return f"""SELECT count(*) AS total_visitors,
        coalesce({pct("sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)", "count(*)")}, 0) AS bounce_rate,
        coalesce({fixed("avg(span) / 1000", 2)}, 0) AS avg_time_spent_seconds,
        coalesce({pct("sum(CASE WHEN converted THEN 1 ELSE 0 END)", "count(*)")}, 0) AS conversion_rate
        FROM (SELECT v.*, v.session_id IN (SELECT session_id FROM fx_events
            WHERE event_name = 'conversion' AND {w("timestamp")}) AS converted
          FROM (SELECT session_id, count(*) AS n, max(timestamp) - min(timestamp) AS span FROM fx_page_views
            WHERE {w("timestamp")} GROUP BY session_id) v) t"""


def _rollup_all() -> str:
    lo = f"d.deploy_time * 1000 - {DAY_MS}"
    return f"""pv AS (SELECT d.id, v.session_id, count(*) AS n, max(v.timestamp) - min(v.timestamp) AS span
          FROM fx_deploys d JOIN fx_page_views v ON v.timestamp BETWEEN {lo} AND d.deploy_time * 1000
          GROUP BY d.id, v.session_id),
        cv AS (SELECT DISTINCT d.id, e.session_id FROM fx_deploys d JOIN fx_events e
          ON e.timestamp BETWEEN {lo} AND d.deploy_time * 1000 AND e.event_name = 'conversion')
        SELECT d.id, d.deploy_time, count(pv.session_id) AS total_visitors,
        coalesce({pct("count(CASE WHEN pv.n = 1 THEN 1 END)", "count(pv.session_id)")}, 0) AS bounce_rate,
        coalesce({fixed(ratio("sum(pv.span)", "count(pv.session_id)") + " / 1000", 2)}, 0) AS avg_time_spent_seconds,
        coalesce({pct("count(cv.session_id)", "count(pv.session_id)")}, 0) AS conversion_rate
        FROM fx_deploys d LEFT JOIN pv ON d.id = pv.id LEFT JOIN cv ON pv.id = cv.id AND pv.session_id = cv.session_id
        GROUP BY d.id, d.deploy_time"""


def _window_counts() -> str:
    def one(table: str, ts: str) -> str:
        return f"(SELECT count(*) FROM {table} f WHERE f.{ts} BETWEEN w.hi - {DAY_MS} AND w.hi)"

    return f"""w AS (SELECT id, 'current' AS period, deploy_time * 1000 AS hi FROM fx_deploys
          UNION ALL SELECT id, 'previous', deploy_time * 1000 - {DAY_MS} FROM fx_deploys)
        SELECT id, period, {one("fx_page_views", "timestamp")} AS page_views_in_range,
        {one("fx_events", "timestamp")} AS events_in_range, {one("fx_sessions", "start_time")} AS sessions_in_range FROM w"""


def _deploy() -> dict[str, str]:
    spv, all3 = ["fx_sessions", "fx_page_views"], ["fx_sessions", "fx_page_views", "fx_events"]
    d, tf = C.DAY, C.WEEK
    return {
        "stored_sessions": oracle(
            ["fx_sessions"],
            "SELECT session_id, start_time, end_time, device_type, country, CAST(NULL AS VARCHAR) AS city FROM fx_sessions",
        ),
        "stored_page_views": oracle(["fx_page_views"], "SELECT * FROM fx_page_views"),
        "stored_events": oracle(["fx_events"], "SELECT * FROM fx_events"),
        "stored_window_metrics": oracle(spv, _window(d)),
        "ensured_table": oracle(
            ["fx_deploy_history"],
            """SELECT id, deploy_time, environment, commit_sha, total_visitors, CAST(NULL AS BIGINT) AS total_sessions
            FROM fx_deploy_history""",
        ),
        "deployments_evolved": oracle(
            ["fx_deploys", "fx_deploy_history"],
            """SELECT id, deploy_time, deploy_time - build_time AS deployment_duration, status, environment, commit_sha,
            CAST(NULL AS BIGINT) AS total_visitors, CAST(NULL AS BIGINT) AS total_sessions,
            CAST(NULL AS DOUBLE) AS bounce_rate, CAST(NULL AS DOUBLE) AS avg_fcp FROM fx_deploys
            UNION ALL SELECT id, deploy_time, NULL, NULL, environment, commit_sha, total_visitors, total_visitors,
            bounce_rate, NULL FROM fx_deploy_history""",
        ),
        "page_window_metrics": oracle(["fx_page_views"], _page_metrics(d)),
        "bounced_sessions": oracle(spv, f"SELECT count(*) AS bounced_sessions FROM ({_bounced(d)}) b"),
        "window_metrics": oracle(spv, _window(d)),
        "window_metrics_literal": oracle(
            spv,
            f"""SELECT *, {pct("bounced_sessions", "total_sessions")} AS bounce_rate,
            {pct("engaged_sessions", "total_sessions")} AS engagement_rate
            FROM (SELECT pm.*, CAST(1 AS BIGINT) AS bounced_sessions FROM ({_page_metrics(d)}) pm, ({_bounced(d)}) bm) w""",
        ),
        "window_comparison": oracle(spv, _comparison()),
        "deployment_record": oracle(
            ["fx_deploys", *spv],
            f"""SELECT d.deploy_time, d.build_time, d.deploy_time - d.build_time AS deployment_duration, d.status,
            d.environment, d.commit_sha, d.branch, m.* FROM fx_deploys d, ({_comparison()}) m
            WHERE d.deploy_time = {C.DEPLOY_TIME}""",
        ),
        "deployment_record_rollup": oracle(
            ["fx_deploys", *all3[1:]],
            f"""SELECT d.deploy_time, d.build_time, d.deploy_time - d.build_time AS deployment_duration, d.status,
            d.environment, d.commit_sha, d.branch, m.*, CAST({C.DAY.lo} AS BIGINT) AS metrics_start_time,
            CAST({C.DAY.hi} AS BIGINT) AS metrics_end_time FROM fx_deploys d, ({_rollup(C.DAY)}) m
            WHERE d.deploy_time = {C.DEPLOY_TIME}""",
        ),
        "data_availability": oracle(
            all3,
            f"""SELECT count(*) AS page_views_in_range,
            (SELECT count(*) FROM fx_events WHERE timestamp BETWEEN {d.lo} AND {d.hi}) AS events_in_range,
            (SELECT count(*) FROM fx_sessions WHERE start_time BETWEEN {d.lo} AND {d.hi}) AS sessions_in_range
            FROM fx_page_views WHERE timestamp BETWEEN {d.lo} AND {d.hi}""",
        ),
        "deployment_rollup": oracle(all3[1:], _rollup(tf)),
        "deployment_rollup_empty": oracle(all3[1:], _rollup(Timeframe(1, 2))),
        "deployment_rollup_literal": oracle(all3[1:], _literal_rollup(tf)),
        "range_join_deployments": oracle([*all3, "fx_deploys"], _window_counts()),
        "rollup_all_deployments": oracle([*all3[1:], "fx_deploys"], _rollup_all()),
    }


# --- history --------------------------------------------------------------------

HISTORY = """
cur AS (SELECT * FROM fx_deploy_history WHERE environment = 'production' ORDER BY deploy_time DESC, id DESC LIMIT 1),
prev AS (SELECT * FROM fx_deploy_history WHERE environment = 'production'
  AND deploy_time < (SELECT deploy_time FROM cur) ORDER BY deploy_time DESC, id DESC LIMIT 10),
last3 AS (SELECT * FROM fx_deploy_history ORDER BY deploy_time DESC, id DESC LIMIT 3)
"""


def _hist(select: str) -> str:
    return oracle(["fx_deploy_history"], f"{HISTORY.strip()}\n{select}")


def _deltas(source: str, partition: str, extra: str = "") -> str:
    def delta(column: str, alias: str) -> str:
        return f"coalesce({column}, 0) - coalesce(lead({column}) OVER w, 0) AS {alias}"

    return f"""SELECT {extra}id, deploy_time, commit_sha, bounce_rate_change, avg_time_change, visitors_change, conversion_change
        FROM (SELECT *, lead(id) OVER w AS older, {delta("bounce_rate", "bounce_rate_change")},
          {delta("avg_time_spent_seconds", "avg_time_change")}, {delta("total_visitors", "visitors_change")},
          {delta("conversion_rate", "conversion_change")} FROM {source}
          WINDOW w AS ({partition} ORDER BY deploy_time DESC, id DESC)) q WHERE older IS NOT NULL"""


def _history() -> dict[str, str]:
    shaped = lambda role, source: f"""SELECT '{role}' AS role, id AS "deploymentId",
        strftime(make_timestamp(deploy_time * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS "deploymentDate",
        total_visitors AS "totalVisitors", bounce_rate AS "bounceRate", avg_time_spent_seconds AS "avgTimeSpentSeconds",
        conversion_rate AS "conversionRate", 0 AS ttfb, 0 AS fcp, 0 AS lcp, 0 AS cls, 0 AS fid FROM {source}"""
    both = f"{shaped('current', 'cur')} UNION ALL {shaped('previous', 'prev')}"
    metrics = ("total_visitors", "bounce_rate", "avg_time_spent_seconds", "conversion_rate")
    rows = " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, coalesce(CAST((SELECT {m} FROM cur) AS DOUBLE), 0) AS current,
        coalesce((SELECT {ratio(f"sum(coalesce({m}, 0))", "count(*)")} FROM prev), 0) AS mean"""
        for m in metrics
    )
    return {
        "current_deployment": _hist("SELECT * FROM cur"),
        "previous_deployments": _hist("SELECT * FROM prev"),
        "history_view": _hist(both),
        "history_labels": _hist(
            f"""SELECT role, "deploymentId", "deploymentDate", CAST("totalVisitors" AS VARCHAR) AS visitors,
            concat({_label('"bounceRate"')}, '%') AS bounce,
            concat(CAST(CAST(floor("avgTimeSpentSeconds" + 0.5) AS BIGINT) AS VARCHAR), 's') AS avg_time,
            CASE WHEN "conversionRate" IS NULL THEN '0%' ELSE concat({_label('"conversionRate"')}, '%') END AS conversion
            FROM ({both}) h"""
        ),
        "change_vs_previous_mean": _hist(
            f"""SELECT metric, current, {fixed("mean", 4)} AS previous_mean, {fixed("abs(change)", 1)} AS change,
            CASE WHEN change >= 0 THEN 'up' WHEN change < 0 THEN 'down' END AS direction,
            CASE WHEN change IS NULL THEN NULL WHEN (change >= 0) <> (metric = 'bounce_rate') THEN 'good' ELSE 'bad' END AS tone
            FROM (SELECT *, {ratio("current - mean", "mean")} * 100 AS change FROM ({rows}) r) c"""
        ),
        "last_deployments": _hist("SELECT * FROM last3"),
        "last_deployment_deltas": _hist(_deltas("last3", "")),
        "deployment_deltas": _hist(_deltas("fx_deploy_history", "PARTITION BY environment", "environment, ")),
    }


# --- behavior -------------------------------------------------------------------


def _sessionize(gap_ms: int) -> str:
    return oracle(
        ["fx_base"],
        f"""f AS (SELECT event_id, user_id, ms, CASE WHEN ms - lag(ms) OVER w <= {gap_ms} THEN 0 ELSE 1 END AS fresh
            FROM fx_base WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS no FROM f)
        SELECT event_id, user_id, ms, min(ms) OVER (PARTITION BY user_id, no) AS session_start,
        concat(CAST(user_id AS VARCHAR), '-', CAST(min(ms) OVER (PARTITION BY user_id, no) AS VARCHAR)) AS session_id FROM n""",
    )


ENGAGEMENT = """
p AS (SELECT *, kind IN ('scroll', 'signal') AS is_signal, min(ts) OVER (PARTITION BY view_id) AS start,
    max(ts) OVER (PARTITION BY view_id) AS fin,
    max(scroll_pct) OVER (PARTITION BY view_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS deepest,
    sum(CASE WHEN kind IN ('scroll', 'signal') THEN 1 ELSE 0 END) OVER
      (PARTITION BY view_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM fx_interactions),
e AS (SELECT view_id, start, fin AS "end", count(CASE WHEN is_signal THEN 1 END) AS interactions,
    coalesce(max(scroll_pct), 0) AS max_scroll,
    min(CASE WHEN is_signal AND (ts - start >= 10000 OR deepest >= 25 OR before > 0) THEN ts END) AS engaged_at
  FROM p GROUP BY view_id, start, fin)
"""


def _bursts(wait: int) -> str:
    fields = ("ttfb", "fcp", "lcp", "cls", "fid")
    picks = ", ".join(
        f"{fixed(f'last({f} ORDER BY ts, seq) FILTER (WHERE {f} IS NOT NULL)', 4)} AS {f}" for f in fields
    )
    return oracle(
        ["fx_perf_entries"],
        f"""s AS (SELECT view_id, seq, ts, CASE WHEN entry_type = 'navigation' THEN response_start - request_start END AS ttfb,
          CASE WHEN name = 'first-contentful-paint' THEN start_time END AS fcp,
          CASE WHEN entry_type = 'largest-contentful-paint' THEN start_time END AS lcp,
          CASE WHEN entry_type = 'layout-shift' THEN shift_value END AS cls,
          CASE WHEN entry_type = 'first-input' THEN processing_start - start_time END AS fid,
          CASE WHEN ts - lag(ts) OVER w < {wait} THEN 0 ELSE 1 END AS fresh
          FROM fx_perf_entries WINDOW w AS (PARTITION BY view_id ORDER BY ts, seq)),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY view_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM s)
        SELECT view_id, min(ts) AS first_ts, max(ts) AS ts, last(seq ORDER BY ts, seq) AS seq, count(*) AS n_rows, {picks}
        FROM n GROUP BY view_id, no""",
    )


def _z(level: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in Z.items())
    return f"CASE CAST({level} AS DOUBLE) {cases} ELSE {OTHER_Z} END"


def _erf(x: str) -> str:
    t = f"(1 / (1 + {ERF_T}::DOUBLE * abs({x})))"
    terms = " + ".join(f"({a}::DOUBLE) * pow({t}, {i + 1})" for i, a in enumerate(ERF))
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1 - ({terms}) * exp(-({x}) * ({x}))))"


def _sample_size(base: str, lift: str, z: str, z_power: str) -> str:
    lifted = f"({base} * (1 + {lift}))"
    mean = f"(({base} + {lifted}) / 2)"
    spread = f"(({z} + {z_power}) / nullif({lifted} - {base}, 0))"
    return f"CAST(ceil(2 * {mean} * (1 - {mean}) * {spread} * {spread}) AS BIGINT)"


def _ab_test() -> str:
    return oracle(
        ["fx_ab"],
        f"""n AS (SELECT segment, variant, count(*) AS visitors, CAST(sum(converted) AS BIGINT) AS conversions
          FROM fx_ab GROUP BY segment, variant),
        r AS (SELECT t.segment, t.variant, t.visitors, t.conversions, c.visitors AS control_visitors,
          c.conversions AS control_conversions, {ratio("t.conversions", "t.visitors")} AS ra,
          {ratio("c.conversions", "c.visitors")} AS rb FROM n t JOIN n c ON t.segment = c.segment
          WHERE t.variant <> '{C.CONTROL}' AND c.variant = '{C.CONTROL}'),
        s AS (SELECT *, sqrt(ra * (1 - ra) / visitors + rb * (1 - rb) / control_visitors) AS se FROM r),
        z AS (SELECT *, abs(ra - rb) / nullif(se, 0) / sqrt(2.0) AS zz FROM s)
        SELECT segment, variant, visitors, conversions, control_visitors, control_conversions,
        {fixed("ra", 6)} AS rate, {fixed("rb", 6)} AS control_rate,
        {fixed(f"CASE WHEN ra = rb THEN 0 WHEN se = 0 THEN 0.9999 ELSE least(0.9999, (1 + {_erf('zz')}) / 2) END", 6)} AS confidence,
        {_sample_size("rb", "CAST(0.1 AS DOUBLE)", "1.96", "1.28")} AS sample_size FROM z""",
    )


def _sizes() -> str:
    levels = " UNION ALL ".join(
        f"SELECT CAST({l} AS DOUBLE) AS lift, CAST({c} AS DOUBLE) AS confidence, CAST({p} AS DOUBLE) AS power"
        for l, c, p in C.SIZE_LEVELS
    )
    return oracle(
        ["fx_ab"],
        f"""b AS (SELECT segment, {ratio("sum(converted)", "count(*)")} AS base FROM fx_ab GROUP BY segment),
        l AS ({levels})
        SELECT segment, lift, confidence, power, {_sample_size("base", "lift", _z("confidence"), _z("power"))} AS sample_size
        FROM b, l""",
    )


def _behavior() -> dict[str, str]:
    i, p = ["fx_interactions"], ["fx_perf_entries"]
    percent = "CAST(floor((scroll_pct * 7.5 + value) / 900.0 * 100 + 0.5) AS INTEGER)"
    bucket = lambda x: f"""CASE WHEN {x} >= 25 AND {x} < 50 THEN 25 WHEN {x} >= 50 AND {x} < 75 THEN 50
        WHEN {x} >= 75 AND {x} < 100 THEN 75 WHEN {x} = 100 THEN 100 END"""
    first = lambda cond, value: f"first({value} ORDER BY ts, seq) FILTER (WHERE {cond})"
    return {
        "sessionize": _sessionize(1_800_000),
        "sessionize_6h": _sessionize(21_600_000),
        "engagement": oracle(i, f"{ENGAGEMENT.strip()} SELECT *, engaged_at IS NOT NULL AS engaged FROM e"),
        "bounce_or_end": oracle(
            i,
            f"""{ENGAGEMENT.strip()} SELECT view_id,
            ((engaged_at IS NULL OR engaged_at > start + 30000) AND "end" - start >= 30000) AS timer_bounce,
            CASE WHEN engaged_at IS NULL THEN 'bounce' ELSE 'session_end' END AS final_event, "end" - start AS time_on_page FROM e""",
        ),
        "scroll_bucket": oracle(
            i,
            f"""SELECT view_id, bucket, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, {bucket("scroll_pct")} AS bucket
            FROM fx_interactions WHERE kind = 'scroll') b WHERE bucket IS NOT NULL GROUP BY view_id, bucket""",
        ),
        "scroll_percent": oracle(
            i,
            f"""SELECT seq, percent, {bucket("percent")} AS bucket FROM (SELECT seq, {percent} AS percent
            FROM fx_interactions WHERE kind = 'scroll') b""",
        ),
        "max_scroll": oracle(
            i,
            """SELECT view_id, seq, ts, scroll_pct, max(scroll_pct) OVER (PARTITION BY view_id ORDER BY ts, seq
            ROWS UNBOUNDED PRECEDING) AS max_scroll FROM fx_interactions WHERE kind = 'scroll'""",
        ),
        "web_vitals": oracle(
            p,
            f"""SELECT view_id, {fixed(first("entry_type = 'navigation'", "response_start - request_start"), 4)} AS ttfb,
            {fixed(first("name = 'first-contentful-paint'", "start_time"), 4)} AS fcp,
            {fixed(first("entry_type = 'largest-contentful-paint'", "start_time").replace("first(", "last("), 4)} AS lcp,
            {fixed("sum(CASE WHEN entry_type = 'layout-shift' AND NOT had_recent_input THEN shift_value END)", 4)} AS cls,
            {fixed(first("entry_type = 'first-input'", "processing_start - start_time"), 4)} AS fid
            FROM fx_perf_entries GROUP BY view_id""",
        ),
        "compact_bursts": _bursts(1000),
        "compact_bursts_2s": _bursts(2000),
        "section_dwell": oracle(
            i,
            """SELECT view_id, section, seq, before_ts AS entered_at, ts AS left_at, ts - before_ts AS dwell_ms FROM (
            SELECT *, lag(kind) OVER w AS before_kind, lag(ts) OVER w AS before_ts FROM fx_interactions
            WHERE kind IN ('enter', 'leave') AND section IS NOT NULL
            WINDOW w AS (PARTITION BY view_id, section ORDER BY ts, seq)) q WHERE kind = 'leave' AND before_kind = 'enter'""",
        ),
        "events_with_latest_view": oracle(
            ["fx_events", "fx_page_views"],
            f"""SELECT id, session_id, event_name, page, view_id FROM (
            SELECT e.id, e.session_id, e.event_name, v.page, v.id AS view_id,
              row_number() OVER (PARTITION BY e.id ORDER BY v.timestamp DESC NULLS LAST, v.id DESC) AS rn
            FROM fx_events e LEFT JOIN fx_page_views v ON v.session_id = e.session_id
              AND v.timestamp <= e.timestamp AND e.timestamp - v.timestamp <= {C.HOUR_MS}) q WHERE rn = 1""",
        ),
        "time_on_page": oracle(
            i, "SELECT view_id, min(ts) AS start, max(ts) - min(ts) AS time_on_page FROM fx_interactions GROUP BY view_id"
        ),
        "over_quota": oracle(
            ["fx_base"],
            f"""SELECT event_id, user_id, ms, window_start,
            CASE WHEN row_number() OVER (PARTITION BY user_id, window_start ORDER BY ms, event_id) > {C.QUOTA_LIMIT}
            THEN 'RATE_LIMIT_EXCEEDED' END AS code FROM (SELECT event_id, user_id, ms,
            ms - ms % {C.QUOTA_INTERVAL_MS} AS window_start FROM fx_base) q""",
        ),
        "ab_test": _ab_test(),
        "standard_error": oracle(
            ["fx_ab"],
            f"""SELECT segment, variant, visitors, {fixed("sqrt(rate * (1 - rate) / visitors)", 6)} AS standard_error FROM (
            SELECT segment, variant, count(*) AS visitors, CAST(sum(converted) AS DOUBLE) / count(*) AS rate
            FROM fx_ab GROUP BY segment, variant) q""",
        ),
        "sample_size": _sizes(),
    }


# --- text -----------------------------------------------------------------------

IMPORTS = IMPORT_LINE.replace("'", "''")
PAGE = """(path LIKE '%/pages/%' OR path LIKE '%/app/%' OR path LIKE '%/views/%' OR path LIKE '%/routes/%')
  AND path NOT LIKE '%/\\_%' ESCAPE '\\'"""
# Import targets of every file. A resolved path drops the file name and one folder per
# "..", then appends what is left of the target.
TARGETS = f"""
t AS (SELECT path, list_filter(regexp_extract_all(content, '{IMPORTS}', 1), lambda x: starts_with(x, '.')) AS targets
  FROM fx_repo_files),
x AS (SELECT path, unnest(targets) AS target, CAST(generate_subscripts(targets, 1) - 1 AS INTEGER) AS pos FROM t),
y AS (SELECT *, string_split(path, '/') AS folders, string_split(target, '/') AS parts FROM x),
z AS (SELECT path, pos, target, array_to_string(list_concat(
    folders[1:len(folders) - 1 - len(list_filter(parts, lambda q: q = '..'))],
    list_filter(parts, lambda q: q <> '..' AND q <> '.')), '/') AS joined, parts[len(parts)] AS tail FROM y),
imports AS (SELECT path, pos, target, CASE WHEN contains(tail, '.') THEN joined ELSE joined || '.tsx' END AS resolved FROM z)
"""
RECENT = "recent AS (SELECT * FROM fx_commits ORDER BY ts DESC, seq DESC LIMIT 3)"
CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '```json\\s*|\\s*```', '', 'g'), "
    "'^[^{]*(\\{[\\s\\S]*\\})[^}]*$', '\\1')"
)
# Every reply is either refused or holds one change with one modification per entry.
REPLIES = f"""
c AS (SELECT reply_id, raw, {CLEAN} AS cleaned FROM fx_replies),
j AS (SELECT reply_id, raw, cleaned, CASE WHEN json_valid(cleaned) AND json_type(cleaned, '$.changes') = 'ARRAY'
    THEN json_extract(cleaned, '$.changes[*]') END AS changes FROM c),
ch AS (SELECT reply_id, CAST(generate_subscripts(changes, 1) - 1 AS INTEGER) AS pos, unnest(changes) AS change FROM j
  WHERE changes IS NOT NULL),
cc AS (SELECT reply_id, pos, coalesce(json_extract_string(change, '$.filePath'), '') AS file_path,
    coalesce(nullif(TRY_CAST(json_extract_string(change, '$.confidence_score') AS DOUBLE), 0), 0.5) AS confidence_score,
    coalesce(nullif(json_extract_string(change, '$.reasoning'), ''), 'No reasoning provided') AS reasoning,
    CASE WHEN json_type(change, '$.modifications') = 'ARRAY' THEN json_extract(change, '$.modifications[*]') ELSE [] END AS mods
  FROM ch),
m AS (SELECT reply_id, pos, CAST(generate_subscripts(mods, 1) - 1 AS INTEGER) AS mod_pos, unnest(mods) AS modification FROM cc),
mm AS (SELECT reply_id, pos, mod_pos, json_extract_string(modification, '$.type') AS type,
    TRY_CAST(json_extract_string(modification, '$.lineNumber') AS DOUBLE) AS line_number,
    nullif(json_extract_string(modification, '$.content'), '') AS content,
    coalesce(json_extract_string(modification, '$.reasoning'), 'undefined') AS mod_reasoning FROM m)
"""


def _components(pages: str) -> str:
    return f"""{TARGETS.strip()},
        pages AS (SELECT path, content FROM fx_repo_files WHERE {pages}),
        found AS (SELECT i.path, i.resolved, min(i.pos) AS pos, f.content FROM imports i
          JOIN pages p ON p.path = i.path JOIN fx_repo_files f ON f.path = i.resolved
          GROUP BY i.path, i.resolved, f.content)"""


def _context() -> str:
    obj = """'{"id":' || id || ',"deploy_time":' || deploy_time || ',"environment":"' || environment || '","commit_sha":"' ||
        commit_sha || '","total_visitors":' || coalesce(CAST(total_visitors AS VARCHAR), 'null') || ',"bounce_rate":' || bounce_rate ||
        ',"avg_time_spent_seconds":' || avg_time_spent_seconds || ',"conversion_rate":' ||
        coalesce(CAST(conversion_rate AS VARCHAR), 'null') || '}'"""
    delta = """'{"deploy_time":' || deploy_time || ',"commit_sha":"' || commit_sha || '","bounce_rate_change":' || bounce_rate_change ||
        ',"avg_time_change":' || avg_time_change || ',"visitors_change":' || visitors_change || ',"conversion_change":' ||
        conversion_change || '}'"""
    change = """'{"file":"' || sha || '","changes":["' || replace(message, chr(10), '","') || '"]}'"""
    return oracle(
        ["fx_repo_files", "fx_commits", "fx_deploy_history"],
        f"""{_components(f"{PAGE} AND path LIKE '%page.tsx'")}, {RECENT}, {HISTORY.strip()},
        d AS ({_deltas("last3", "")}),
        h AS (SELECT '[' || string_agg({obj}, ',' ORDER BY deploy_time DESC, id DESC) || ']' AS history FROM last3),
        dd AS (SELECT '[' || string_agg({delta}, ',' ORDER BY deploy_time DESC, id DESC) || ']' AS deltas FROM d),
        blocks AS (SELECT path, string_agg('--- ' || resolved || ' ---' || chr(10) || content, chr(10) ORDER BY pos) AS files
          FROM found WHERE resolved <> path GROUP BY path),
        targets AS (SELECT path, string_agg(target, ', ' ORDER BY pos) AS components FROM imports GROUP BY path),
        needles AS (SELECT path, path AS needle FROM pages UNION SELECT path, target FROM imports),
        hits AS (SELECT path, '[' || string_agg({change}, ',' ORDER BY ts DESC, seq DESC) || ']' AS changes FROM (
          SELECT DISTINCT n.path, r.sha, r.message, r.ts, r.seq FROM needles n JOIN recent r ON contains(r.message, n.needle)) q
          GROUP BY path)
        SELECT p.path AS main_file, 'Main File: ' || p.path || chr(10) || 'Component Files: ' || coalesce(t2.components, '') ||
        chr(10) || chr(10) || 'FILE CONTENTS:' || chr(10) || '--- ' || p.path || ' ---' || chr(10) || p.content ||
        coalesce(chr(10) || b.files, '') || chr(10) || chr(10) || 'METRICS HISTORY:' || chr(10) || h.history ||
        chr(10) || chr(10) || 'METRIC CHANGES AFTER DEPLOYMENTS:' || chr(10) || dd.deltas ||
        chr(10) || chr(10) || 'RECENT CHANGES TO THIS PAGE:' || chr(10) || coalesce(k.changes, '[]') AS context
        FROM pages p LEFT JOIN targets t2 ON p.path = t2.path LEFT JOIN blocks b ON p.path = b.path
        LEFT JOIN hits k ON p.path = k.path, h, dd""",
    )


def _text() -> dict[str, str]:
    files, replies = ["fx_repo_files"], ["fx_replies"]
    code = CODE_START.replace("'", "''")
    return {
        "page_files": oracle(files, f"SELECT path FROM fx_repo_files WHERE {PAGE}"),
        "page_files_suffix": oracle(files, f"SELECT path FROM fx_repo_files WHERE {PAGE} AND path LIKE '%page.tsx'"),
        "relative_imports": oracle(files, f"{TARGETS.strip()} SELECT path, pos, target FROM imports"),
        "resolve_import": oracle(files, f"{TARGETS.strip()} SELECT path, pos, resolved FROM imports"),
        "page_components": oracle(
            files,
            f"""{_components(PAGE)},
            names AS (SELECT path, string_agg(target, ',' ORDER BY pos) AS components FROM imports GROUP BY path),
            entries AS (SELECT path AS main_file, path, content FROM pages
              UNION ALL SELECT path, resolved, content FROM found WHERE resolved <> path)
            SELECT e.main_file, coalesce(n.components, '') AS components, e.path, e.content
            FROM entries e LEFT JOIN names n ON n.path = e.main_file""",
        ),
        "recent_changes": oracle(
            ["fx_commits"],
            f"""{RECENT} SELECT sha, CAST(generate_subscripts(string_split(message, chr(10)), 1) - 1 AS INTEGER) AS line_no,
            unnest(string_split(message, chr(10))) AS line FROM recent""",
        ),
        "relevant_changes": oracle(
            [*files, "fx_commits"],
            f"""{TARGETS.strip()}, {RECENT},
            pages AS (SELECT path FROM fx_repo_files WHERE {PAGE}),
            needles AS (SELECT path, path AS needle FROM pages UNION ALL SELECT i.path, i.target FROM imports i JOIN pages p ON p.path = i.path),
            hits AS (SELECT DISTINCT n.path, r.sha, r.message, r.ts, r.seq FROM needles n JOIN recent r ON contains(r.message, n.needle))
            SELECT path AS main_file, CAST(row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) - 1 AS INTEGER) AS rank,
            sha, message FROM hits""",
        ),
        "relevant_changes_all": oracle(
            [*files, "fx_commits"],
            f"""{TARGETS.strip()},
            pages AS (SELECT path FROM fx_repo_files WHERE {PAGE}),
            needles AS (SELECT path, path AS needle FROM pages UNION ALL SELECT i.path, i.target FROM imports i JOIN pages p ON p.path = i.path)
            SELECT DISTINCT n.path AS main_file, c.sha, c.ts FROM needles n JOIN fx_commits c ON contains(c.message, n.needle)""",
        ),
        "clean_reply": oracle(replies, f"{REPLIES.strip()} SELECT reply_id, cleaned FROM c"),
        "parse_reply": oracle(
            replies,
            f"""{REPLIES.strip()} SELECT cc.reply_id, cc.pos, file_path, confidence_score, reasoning, mod_pos, type, line_number,
            content, mod_reasoning FROM cc LEFT JOIN mm ON cc.reply_id = mm.reply_id AND cc.pos = mm.pos""",
        ),
        "rejected_replies": oracle(replies, f"{REPLIES.strip()} SELECT reply_id, raw FROM j WHERE changes IS NULL"),
        "changes_by_file": oracle(
            replies,
            f"""{REPLIES.strip()} SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY reply_id, pos) AS change_no,
            reply_id, pos, CAST(len(mods) AS INTEGER) AS n_modifications FROM cc""",
        ),
        "digest_markdown": oracle(
            replies,
            f"""{REPLIES.strip()}, bullets AS (SELECT reply_id, pos, string_agg('- ' || coalesce(type, 'undefined') || ': ' ||
              mod_reasoning, chr(10) ORDER BY mod_pos) AS list FROM mm GROUP BY reply_id, pos)
            SELECT cc.reply_id, string_agg('## ' || file_path || chr(10) || chr(10) || reasoning || chr(10) || chr(10) ||
            coalesce(list, ''), chr(10) || chr(10) ORDER BY cc.pos) AS digest
            FROM cc LEFT JOIN bullets b ON cc.reply_id = b.reply_id AND cc.pos = b.pos GROUP BY cc.reply_id""",
        ),
        "clean_code": oracle(
            ["fx_code_replies"],
            f"""SELECT path, code FROM (SELECT path, nullif(regexp_replace(regexp_replace(
            coalesce(nullif(regexp_extract(answer, '{code}', 1), ''), answer), '```[\\w]*\\n?|\\n?```', '', 'g'),
            '^\\s+|\\s+$', '', 'g'), '') AS code FROM fx_code_replies) q WHERE code IS NOT NULL""",
        ),
        "page_context": _context(),
    }


# --- streams --------------------------------------------------------------------


def _streams() -> dict[str, str]:
    """Streams give what one batch over all rows gives."""
    behavior, q = _behavior(), streams.QUOTA_INTERVAL_MS
    same = ("engagement", "bounce_or_end", "section_dwell", "web_vitals", "compact_bursts")
    return {f"{name}_stream": behavior[name] for name in same} | {
        "sessionize_stream": oracle(
            ["fx_base"],
            """f AS (SELECT user_id, ms, event_id, CASE WHEN ms - lag(ms) OVER w <= 1800000 THEN 0 ELSE 1 END AS fresh
              FROM fx_base WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
            n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS no FROM f)
            SELECT user_id, min(ms) AS session_start, max(ms) AS last_activity, count(*) AS n_events,
              max(ms) + 1800000 >= (SELECT max(ms) FROM fx_base) AS is_open FROM n GROUP BY user_id, no""",
        ),
        "over_quota_stream": oracle(
            ["fx_base"],
            f"""SELECT user_id, window_start, hits, 'RATE_LIMIT_EXCEEDED' AS code FROM (
            SELECT user_id, ms - ms % {q} AS window_start, count(*) AS hits FROM fx_base GROUP BY user_id, ms - ms % {q}) w
            WHERE hits > {streams.QUOTA_LIMIT}""",
        ),
        "time_on_page_stream": oracle(
            ["fx_interactions"],
            """SELECT view_id, min(ts) AS start, max(ts) - min(ts) AS time_on_page, coalesce(max(scroll_pct), 0) AS max_scroll
            FROM fx_interactions GROUP BY view_id""",
        ),
    }


def all_oracles() -> dict[str, str]:
    return _site() | _ingest() | _deploy() | _history() | _behavior() | _text() | _streams()
