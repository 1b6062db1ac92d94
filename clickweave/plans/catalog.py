"""Registered queries: every operator applied to the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave import schemas
from clickweave.functions import scalars as S
from clickweave.functions import stats
from clickweave.operators import asof, behavior, daily, deploy, experiments, history, ingest, quota, site, textjobs
from clickweave.operators.timeframe import ALL_TIME, Timeframe, deploy_windows, preset_timeframe
from clickweave.session import scratch_dir
from clickweave.plans import jobs
from clickweave.sources import tables
from clickweave.sources.fixtures import view
from clickweave.streaming import ingest as stream_ingest
from clickweave.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries: one week, one deployment, one day, quotas.
WEEK = Timeframe(1_704_844_800_000, 1_705_449_600_000)
DEPLOY_TIME = 1_705_276_800
DAY = deploy_windows(DEPLOY_TIME)[0]
QUOTA_LIMIT, QUOTA_INTERVAL_MS = 2, 86_400_000
CONTROL = "A"
SIZE_LEVELS = [(0.1, 0.95, 0.8), (0.2, 0.9, 0.85), (0.05, 0.99, 0.9), (0.5, 0.7, 0.999)]
BATCH_SIZE = 50
MIDWAY = 1_705_276_800_000 + 3_600_000  # where the log is cut in two, within a session's week
# The interaction views compress a week into two minutes, so chunks shrink as well.
CHUNK = 1_000
HOUR_MS = 3_600_000
NOW = 1_705_363_200_000
VITAL_FIELDS = ["ttfb", "fcp", "lcp", "cls", "fid"]


def _on(*names: str):
    """Bind an operator to derived views: ``f(*views)`` becomes ``f(spark, sf_dir)``."""

    def bind(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*[view(spark, sf_dir, n) for n in names])

    return bind


SPE = ("fx_sessions", "fx_page_views", "fx_events")


def _from_partials(tf: Timeframe) -> Query:
    """The report from daily partials that were stored before."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_dir(spark, "daily")
        daily.write_daily(daily.daily_partials(*[view(spark, sf_dir, n) for n in SPE]), root)
        return daily.site_report_from_partials(daily.read_daily(spark, root), tf)

    return run


def _site() -> dict[str, Query]:
    out: dict[str, Query] = {
        "site_report_from_partials": _from_partials(WEEK),
        "site_report_from_partials_all": _from_partials(ALL_TIME),
        "site_total_visitors_7d": _on("fx_sessions")(lambda s: site.total_visitors(s, preset_timeframe("7d", NOW))),
        "site_report_nested": _on(*SPE)(
            lambda s, v, e: site.site_report_nested(site.site_report(s, v, e, WEEK)).select(
                "total_visitors", "bounce_rate", "conversion_rate", F.size("country_breakdown").alias("n_countries"),
                F.inline("top_pages"),
            )
        ),
    }
    for suffix, tf in (("", ALL_TIME), ("_window", WEEK)):
        out |= {
            f"site_total_visitors{suffix}": _on("fx_sessions")(lambda s, tf=tf: site.total_visitors(s, tf)),
            f"site_bounce_rate{suffix}": _on("fx_sessions", "fx_page_views")(
                lambda s, v, tf=tf: site.bounce_rate(s, v, tf)
            ),
            f"site_avg_time{suffix}": _on("fx_page_views")(lambda v, tf=tf: site.avg_time_spent_seconds(v, tf)),
            f"site_top_pages{suffix}": _on("fx_page_views")(lambda v, tf=tf: site.top_pages(v, tf)),
            f"site_ctr{suffix}": _on("fx_sessions", "fx_events")(
                lambda s, e, tf=tf: site.click_through_rates(s, e, tf)
            ),
            f"site_device_breakdown{suffix}": _on("fx_sessions")(lambda s, tf=tf: site.device_breakdown(s, tf)),
            f"site_country_breakdown{suffix}": _on("fx_sessions")(lambda s, tf=tf: site.country_breakdown(s, tf)),
            f"site_conversion_rate{suffix}": _on("fx_sessions", "fx_events")(
                lambda s, e, tf=tf: site.conversion_rate(s, e, tf)
            ),
            f"site_report_long{suffix}": _on(*SPE)(lambda s, v, e, tf=tf: site.site_report(s, v, e, tf)),
        }
    out["display_kpis"] = _on(*SPE)(lambda s, v, e: site.display_kpis(site.site_report(s, v, e, WEEK)))
    return out


def _envelopes(raw: DataFrame) -> DataFrame:
    """Client batches of at most ``BATCH_SIZE`` records with one shared header."""
    record = F.struct(
        "seq", "event", "page", "element",
        F.col("scroll_depth").alias("scrollDepth"), F.col("time_spent").alias("timeSpent"), "ttfb", "cls",
    )
    batches = raw.groupBy("session_id", F.floor(F.col("seq") / BATCH_SIZE).alias("batch_no")).agg(
        F.max("ts").alias("arrival"),
        F.min("user_agent").alias("user_agent"),
        F.sort_array(F.collect_list(record)).alias("events"),
    )
    return batches.withColumn("body", F.to_json(F.struct("events"))).drop("events")


def _explode_batch(raw: DataFrame) -> DataFrame:
    records, _ = ingest.explode_batch(_envelopes(raw))
    return records.select(
        "session_id", "batch_no", "pos", "ts", "user_agent", "event", "page", "element",
        "scroll_depth", "time_spent", "ttfb", "cls",
    )


def _explode_batch_refused(raw: DataFrame) -> DataFrame:
    _, refused = ingest.explode_batch(_envelopes(raw))
    return refused.select("batch_no", "arrival", "reason")


def _gate_known(raw: DataFrame) -> DataFrame:
    known = ingest.fold_sessions(raw)
    with_id = raw.filter(S.present(F.coalesce("session_id", F.lit(""))))
    passed, refused = ingest.gate_against(with_id, known)
    both = passed.withColumn("passed", F.lit(True)).unionByName(refused.withColumn("passed", F.lit(False)))
    return both.select("session_id", "seq", "passed")


def _raw_to_site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the raw log over the stored tables to the site report."""
    root = scratch_dir(spark, "folded")
    jobs.ingest_log(view(spark, sf_dir, "fx_raw"), root, buckets=streams.BUCKETS)
    return site.site_report(
        jobs.with_device(tables.read_sessions(spark, root)),
        tables.read_page_views(spark, root),
        tables.read_events(spark, root),
    )


def _two_logs(read: Callable[[SparkSession, str], DataFrame], *columns: str) -> Query:
    """One of the tables after two logs, the second one later than the first, and a run repeated."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_dir(spark, "two-logs")
        raw = view(spark, sf_dir, "fx_raw")
        for name, part in (("first", F.col("ts") < MIDWAY), ("second", F.col("ts") >= MIDWAY)):
            jobs.ingest_log(raw.filter(part), root, name, buckets=streams.BUCKETS)
        jobs.ingest_log(raw.filter(F.col("ts") < MIDWAY), root, "first", buckets=streams.BUCKETS)
        return read(spark, root).select(*columns)

    return run


_SENT_CONTEXT = ("user_agent", "forwarded_for", "remote_ip", "country", "city", "latitude", "longitude", "referrer", "device_hint")


def _request_lines(sent: DataFrame) -> DataFrame:
    """Requests as a server logs them, one line of JSON each: single ones, batches with one header, and
    every 40th request cut off in the middle."""
    own = ("event", "page", "scroll_depth", "element", "ttfb", "fcp", "cls")
    single = F.struct("seq", "arrival", "session_id", *own, F.col("time_sent").alias("time_spent"), *_SENT_CONTEXT)
    singles = sent.filter("in_batch = 0").select(F.to_json(single).alias("value"))
    record = F.to_json(F.struct(*own[:2], F.col("scroll_depth").alias("scrollDepth"), *own[3:], F.col("time_sent").alias("timeSpent")))
    # Some clients write numbers, others text.
    bare = F.regexp_replace(record, '"timeSpent":"([0-9.]+)"', '"timeSpent":$1')
    record = F.when(F.col("seq") % 4 < 2, bare).otherwise(record)
    header = [F.min_by(c, "seq").alias(c) for c in _SENT_CONTEXT]
    batches = (
        sent.filter("in_batch = 1").groupBy("session_id", "batch_no")
        .agg(F.min("seq").alias("seq"), F.max("arrival").alias("arrival"), *header, F.sort_array(F.collect_list(F.struct("seq", record.alias("r")))).alias("e"))
        .withColumn("body", F.concat(F.lit('{"events":['), F.array_join("e.r", ","), F.lit("]}")))
        .select(F.to_json(F.struct("seq", "arrival", "session_id", *_SENT_CONTEXT, "body")).alias("value"))
    )
    broken = sent.filter("seq % 40 = 0").select(F.substring(F.to_json(single), 1, 30).alias("value"))
    return singles.unionByName(batches).unionByName(broken)


def _requests_to(read: Callable[[SparkSession, str], DataFrame], *columns: str) -> Query:
    """One of the tables after mixed requests were streamed as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_dir(spark, "requests")
        view(spark, sf_dir, "fx_sent").write.parquet(f"{root}/sent")
        _request_lines(spark.read.parquet(f"{root}/sent")).write.text(f"{root}/lines")
        lines = tables.read_request_lines(spark, f"{root}/lines", stream=True)
        query = stream_ingest.start_requests(lines, f"{root}/tables", f"{root}/checkpoint", buckets=streams.BUCKETS)
        query.awaitTermination()
        return read(spark, f"{root}/tables").select(*columns)

    return run


def _ingest() -> dict[str, Query]:
    raw = _on("fx_raw")
    return {
        "ingest_normalize": _on("fx_requests")(
            lambda r: ingest.normalize(r).select(
                "session_id", "seq", "ts", "event", "page", "scroll_depth", "element", "time_spent",
                "ip_address", "country", "city", "latitude", "device_type", "ttfb", "cls",
            )
        ),
        "event_time": _on("fx_requests")(_event_time),
        "ingest_explode_batch": raw(_explode_batch),
        "ingest_explode_batch_refused": raw(_explode_batch_refused),
        "ingest_rejects": raw(lambda r: ingest.rejects(r).select("session_id", "seq", "ts", "reason", "status")),
        "ingest_gate_known": raw(_gate_known),
        "fold_sessions": raw(lambda r: ingest.fold_sessions(r).select("session_id", "start_time", "user_agent")),
        "fold_session_end": raw(lambda r: ingest.fold_sessions(r).select("session_id", "start_time", "end_time")),
        "fold_page_views": raw(
            lambda r: ingest.fold_page_views(r).select("id", "session_id", "page", "timestamp", "scroll_depth")
        ),
        "fold_time_spent": raw(lambda r: ingest.fold_page_views(r).select("id", "session_id", "time_spent")),
        "fold_performance": raw(lambda r: ingest.fold_page_views(r).select("id", "session_id", "ttfb", "cls")),
        "fold_performance_keep_zero": raw(
            lambda r: ingest.fold_page_views(r, zero_is_null=False).select("id", "session_id", "ttfb", "cls")
        ),
        "fold_events": raw(
            lambda r: ingest.fold_events(r).select("id", "session_id", "event_name", "element", "timestamp")
        ),
        "raw_to_site_report": _raw_to_site_report,
        "requests_to_sessions": _requests_to(
            tables.read_sessions, "session_id", "start_time", "end_time", "user_agent", "ip_address", "referrer", "device_type",
            "country", "city", "latitude", "longitude",
        ),
        "requests_to_page_views": _requests_to(
            tables.read_page_views, "id", "session_id", "page", "timestamp", "time_spent", "scroll_depth", *schemas.VITALS
        ),
        "requests_to_events": _requests_to(tables.read_events, "id", "session_id", "event_name", "element", "timestamp"),
        "requests_to_dead_letters": _requests_to(tables.read_dead_letters, "arrival", "reason", "status"),
        "ingest_two_logs_sessions": _two_logs(tables.read_sessions, "session_id", "start_time", "end_time", "user_agent"),
        "ingest_two_logs_page_views": _two_logs(
            tables.read_page_views, "id", "session_id", "page", "timestamp", "time_spent", "scroll_depth", "ttfb", "cls"
        ),
        "ingest_two_logs_events": _two_logs(tables.read_events, "id", "session_id", "event_name", "element", "timestamp"),
        "ingest_two_logs_rejects": _two_logs(tables.read_rejects, "session_id", "seq", "ts", "event", "reason", "status"),
    }


def _stored(table: str) -> Query:
    """Append a view to the stored table and read the table back."""
    append = {"sessions": tables.append_sessions, "page_views": tables.append_page_views, "events": tables.append_events}
    read = {"sessions": tables.read_sessions, "page_views": tables.read_page_views, "events": tables.read_events}
    columns = {
        "sessions": ["session_id", "start_time", "end_time", "device_type", "country", "city"],
        "page_views": schemas.PAGE_VIEWS.fieldNames(),
        "events": schemas.EVENTS.fieldNames(),
    }

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_dir(spark, f"stored-{table}")
        append[table](view(spark, sf_dir, f"fx_{table}"), root)
        return read[table](spark, root).select(*columns[table])

    return run


def _stored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window metrics over stored, date-partitioned tables."""
    root = scratch_dir(spark, "stored-window")
    tables.append_sessions(view(spark, sf_dir, "fx_sessions"), root)
    tables.append_page_views(view(spark, sf_dir, "fx_page_views"), root)
    return deploy.window_metrics(tables.read_sessions(spark, root), tables.read_page_views(spark, root), DAY)


def _deployments_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the old and of the new form in one history."""
    root = scratch_dir(spark, "deployments")
    old = view(spark, sf_dir, "fx_deploys").withColumn(
        "deployment_duration", F.col("deploy_time") - F.col("build_time")
    )
    tables.append_deployments(old, root)
    new = view(spark, sf_dir, "fx_deploy_history").withColumn("total_sessions", F.col("total_visitors"))
    tables.append_deployments(new, root)
    return tables.read_deployments(spark, root).select(
        "id", "deploy_time", "deployment_duration", "status", "environment", "commit_sha",
        "total_visitors", "total_sessions", "bounce_rate", "avg_fcp",
    )


def _ensured_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is created if absent, asked for twice, with rows appended to its folder."""
    root = scratch_dir(spark, "ensured")
    name = f"deployment_metrics_{root.rsplit('-', 1)[1]}"
    for _ in range(2):
        tables.ensure_table(spark, name, schemas.DEPLOYMENTS, f"{root}/deployment_metrics")
    tables.append_deployments(view(spark, sf_dir, "fx_deploy_history"), root)
    spark.catalog.refreshTable(name)
    return spark.table(name).select("id", "deploy_time", "environment", "commit_sha", "total_visitors", "total_sessions")


def _event_time(requests: DataFrame) -> DataFrame:
    """The time of a record whose client may have stamped it."""
    stamp = F.when(F.col("seq") % 3 == 0, F.lit(0)).when(F.col("seq") % 3 == 1, F.col("arrival") - 5).cast("bigint")
    return requests.select("seq", S.event_time(stamp, F.col("arrival")).alias("event_time"))


def _standard_errors(sessions: DataFrame) -> DataFrame:
    rates = experiments.variant_counts(sessions).withColumn("rate", S.ratio(F.col("conversions"), F.col("visitors")))
    se = stats.standard_error(F.col("rate"), F.col("visitors"))
    return rates.select("segment", "variant", "visitors", S.fixed(se, 6).alias("standard_error"))


def _deployment_record(deploys: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    one = deploys.filter(F.col("deploy_time") == DEPLOY_TIME)
    return deploy.deployment_record(one, deploy.window_comparison(s, v, DEPLOY_TIME))


def _deployment_record_rollup(deploys: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    one = deploys.filter(F.col("deploy_time") == DEPLOY_TIME)
    return deploy.deployment_record(one, deploy.stamped(deploy.deployment_rollup(v, e, DAY), DAY))


def _deploy() -> dict[str, Query]:
    sv, ve, v = _on("fx_sessions", "fx_page_views"), _on("fx_page_views", "fx_events"), _on("fx_page_views")
    return {
        "stored_sessions": _stored("sessions"),
        "stored_page_views": _stored("page_views"),
        "stored_events": _stored("events"),
        "stored_window_metrics": _stored_window,
        "deployments_evolved": _deployments_evolved,
        "ensured_table": _ensured_table,
        "page_window_metrics": v(lambda v: deploy.page_window_metrics(v, DAY)),
        "bounced_sessions": sv(lambda s, v: deploy.bounced_sessions(s, v, DAY)),
        "window_metrics": sv(lambda s, v: deploy.window_metrics(s, v, DAY)),
        "window_metrics_literal": sv(lambda s, v: deploy.window_metrics_literal(s, v, DAY)),
        "window_comparison": sv(lambda s, v: deploy.window_comparison(s, v, DEPLOY_TIME)),
        "deployment_record": _on("fx_deploys", "fx_sessions", "fx_page_views")(_deployment_record),
        "deployment_record_rollup": _on("fx_deploys", "fx_page_views", "fx_events")(_deployment_record_rollup),
        "data_availability": _on(*SPE)(lambda s, v, e: deploy.data_availability(s, v, e, DAY)),
        "deployment_rollup": ve(lambda v, e: deploy.deployment_rollup(v, e, WEEK)),
        "deployment_rollup_empty": ve(lambda v, e: deploy.deployment_rollup(v, e, Timeframe(1, 2))),
        "deployment_rollup_literal": ve(lambda v, e: deploy.deployment_rollup_literal(v, e, WEEK)),
        "range_join_deployments": _on(*SPE, "fx_deploys")(deploy.window_counts_all),
        "rollup_all_deployments": _on("fx_page_views", "fx_events", "fx_deploys")(deploy.rollup_all_deployments),
    }


def _history() -> dict[str, Query]:
    h = _on("fx_deploy_history")
    return {
        "current_deployment": h(history.current_deployment),
        "previous_deployments": h(history.previous_deployments),
        "history_view": h(lambda d: history.history_view(d).select("*", "performanceScore.*").drop("performanceScore")),
        "history_labels": h(lambda d: history.history_labels(history.history_view(d))),
        "change_vs_previous_mean": h(history.change_vs_previous_mean),
        "last_deployments": h(history.last_deployments),
        "last_deployment_deltas": h(lambda d: history.deployment_deltas(history.last_deployments(d))),
        "deployment_deltas": h(lambda d: history.deployment_deltas(d, ["environment"])),
    }


def _sessionize(gap_ms: int) -> Query:
    return _on("fx_base")(
        lambda b: behavior.sessionize(b.select("event_id", "user_id", "ms"), "user_id", "ms", "event_id", gap_ms)
    )


def _scroll_geometry(i: DataFrame) -> DataFrame:
    """Scroll position and page height into percent and bucket."""
    percent = S.scroll_percent(F.col("scroll_pct") * 7.5 + F.col("value"), F.lit(900.0))
    rows = i.filter("kind = 'scroll'").select("seq", percent.alias("percent"))
    return rows.withColumn("bucket", S.scroll_bucket(F.col("percent")))


def _behavior() -> dict[str, Query]:
    i, p = _on("fx_interactions"), _on("fx_perf_entries")
    def bursts(wait: int) -> Query:
        return p(
            lambda e: behavior.compact_bursts(behavior.vital_samples(e), "view_id", wait, VITAL_FIELDS, CHUNK).select(
                "view_id", "first_ts", "ts", "seq", "n_rows", *[S.fixed(F.col(f), 4).alias(f) for f in VITAL_FIELDS]
            )
        )

    return {
        "sessionize": _sessionize(behavior.SESSION_GAP_MS),
        "sessionize_6h": _sessionize(6 * 3_600_000),
        "engagement": i(lambda x: behavior.engagement(x, CHUNK)),
        "bounce_or_end": i(lambda x: behavior.bounce_or_end(x, CHUNK)),
        "scroll_bucket": i(behavior.scroll_buckets),
        "scroll_percent": i(_scroll_geometry),
        "max_scroll": i(lambda x: behavior.running_max_scroll(x, CHUNK)),
        "web_vitals": p(behavior.web_vitals),
        "compact_bursts": bursts(behavior.MERGE_WAIT_MS),
        "compact_bursts_2s": bursts(behavior.SEND_WAIT_MS),
        "section_dwell": i(lambda x: behavior.section_dwell(x, CHUNK)),
        "time_on_page": i(behavior.time_on_page),
        "events_with_latest_view": _on("fx_events", "fx_page_views")(
            lambda e, v: asof.asof_join(
                e, v.select("id", "session_id", "page", "timestamp"), ["session_id"], "timestamp", "timestamp", "id", "view", HOUR_MS
            ).select("id", "session_id", "event_name", "view.page", F.col("view.id").alias("view_id"))
        ),
        "over_quota": _on("fx_base")(
            lambda b: quota.flag_over_quota(
                b.select("event_id", "user_id", "ms"), "user_id", "ms", "event_id", QUOTA_LIMIT, QUOTA_INTERVAL_MS
            )
        ),
        "ab_test": _on("fx_ab")(lambda a: experiments.ab_test(a, CONTROL)),
        "standard_error": _on("fx_ab")(_standard_errors),
        "sample_size": _on("fx_ab")(lambda a: experiments.sample_sizes(a, SIZE_LEVELS)),
    }


def _page_components(files: DataFrame) -> DataFrame:
    c = textjobs.page_components(textjobs.page_files(files), files)
    return c.select(
        "main_file",
        F.array_join("components", ",").alias("components"),
        F.explode("contents").alias("path", "content"),
    )


def _text() -> dict[str, Query]:
    files, replies = _on("fx_repo_files"), _on("fx_replies")
    return {
        "page_files": files(lambda f: textjobs.page_files(f).select("path")),
        "page_files_suffix": files(lambda f: textjobs.page_files(f, "page.tsx").select("path")),
        "relative_imports": files(lambda f: textjobs.relative_imports(f).select("path", "pos", "target")),
        "resolve_import": files(lambda f: textjobs.relative_imports(f).select("path", "pos", "resolved")),
        "page_components": files(_page_components),
        "recent_changes": _on("fx_commits")(
            lambda c: textjobs.recent_changes(c).select(
                F.col("file").alias("sha"), F.posexplode("changes").alias("line_no", "line")
            )
        ),
        "relevant_changes": _on("fx_repo_files", "fx_commits")(
            lambda f, c: textjobs.relevant_changes(textjobs.page_files(f), c)
        ),
        "relevant_changes_all": _on("fx_repo_files", "fx_commits")(
            lambda f, c: textjobs.relevant_changes_all(textjobs.page_files(f), c)
        ),
        "clean_reply": replies(lambda r: textjobs.clean_replies(r).select("reply_id", "cleaned")),
        "parse_reply": replies(textjobs.parse_reply),
        "rejected_replies": replies(lambda r: textjobs.rejected_replies(r).select("reply_id", "raw")),
        "changes_by_file": replies(textjobs.changes_by_file),
        "digest_markdown": replies(textjobs.digest_markdown),
        "clean_code": _on("fx_code_replies")(textjobs.clean_code),
        "page_context": _on("fx_repo_files", "fx_commits", "fx_deploy_history")(
            lambda f, c, d: textjobs.page_context(textjobs.page_files(f, "page.tsx"), f, c, d)
        ),
    }


def _streams() -> dict[str, Query]:
    return {
        "sessionize_stream": streams.run_sessions,
        "over_quota_stream": streams.run_over_quota,
        "compact_bursts_stream": streams.run_bursts,
        "engagement_stream": streams.run_engagement,
        "bounce_or_end_stream": streams.run_bounce_or_end,
        "time_on_page_stream": streams.run_time_on_page,
        "section_dwell_stream": streams.run_section_dwell,
        "web_vitals_stream": streams.run_web_vitals,
        "ingest_stream": streams.run_ingest,
    }


def all_queries() -> dict[str, Query]:
    return _site() | _ingest() | _deploy() | _history() | _behavior() | _text() | _streams()
