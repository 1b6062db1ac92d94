from pyspark.sql import functions as F

from clickweave import schemas
from clickweave.operators import site
from clickweave.operators.timeframe import DAY_MS, Timeframe, in_timeframe
from clickweave.plans import jobs
from clickweave.session import scratch_dir
from clickweave.sources import tables


def test_time_filter_prunes_partitions(spark, table):
    root = scratch_dir(spark, "t")
    rows = [(f"s{i}", i * DAY_MS + 5) for i in range(6)]
    tables.append_sessions(table("session_id string, start_time long", *rows), root)
    df = in_timeframe(tables.read_sessions(spark, root), "start_time", Timeframe(2 * DAY_MS, 3 * DAY_MS + 10))
    assert sorted(r.session_id for r in df.collect()) == ["s2", "s3"]
    assert len(df.inputFiles()) == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(start_time), GreaterThanOrEqual(start_time" in plan
    counted = df.select("session_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<session_id:string,start_time:bigint>" in counted


def test_append_twice(spark, table):
    root = scratch_dir(spark, "t")
    for i in range(2):
        tables.append_events(table("id long, session_id string, timestamp long", (i, "a", i)), root)
    assert sorted(r.id for r in tables.read_events(spark, root).collect()) == [0, 1]


def test_deployments_of_both_forms(spark, table):
    root = scratch_dir(spark, "t")
    tables.append_deployments(table("deploy_time long, total_visitors int", (1, 5)), root)
    tables.append_deployments(table("deploy_time long, total_sessions long, created_at long", (2, 7, 42)), root)
    got = {r.deploy_time: r for r in tables.read_deployments(spark, root).collect()}
    assert (got[1].total_visitors, got[1].total_sessions) == (5, None)
    assert got[1].created_at > 1_600_000_000 and got[2].created_at == 42


def test_files_of_the_first_form_are_read(spark, table):
    root = scratch_dir(spark, "t")
    old = tables.evolve_schema(table("id long, deploy_time long", (1, 9)), schemas.DEPLOYMENTS_V1)
    old.select(*schemas.DEPLOYMENTS_V1.fieldNames()).write.parquet(f"{root}/deployment_metrics")
    row = tables.read_deployments(spark, root).collect()[0]
    assert (row.deploy_time, row.total_sessions, row.engagement_rate_change) == (9, None, None)


def test_ensure_table(spark):
    root = scratch_dir(spark, "t")
    for _ in range(2):
        tables.ensure_table(spark, "deployment_metrics_t", schemas.DEPLOYMENTS, root)
    assert spark.table("deployment_metrics_t").columns == schemas.DEPLOYMENTS.fieldNames()
    spark.sql("DROP TABLE deployment_metrics_t")


def test_requests_as_json(spark, table):
    root = scratch_dir(spark, "t")
    table("seq long, session_id string, time_spent string", (1, "a", "5s")).write.json(root)
    row = tables.read_requests(spark, root).collect()[0]
    assert (row.seq, row.time_spent, row.page) == (1, "5s", None)
    assert tables.read_requests(spark, root, stream=True).isStreaming


def test_log_to_report_and_deployment(spark, raw, table):
    root = scratch_dir(spark, "t")
    log = raw(
        ("a", 1, 1000, "session_start", {"user_agent": "Mobile"}), ("a", 2, 2000, "pageview", {"page": "/"}),
        ("a", 3, 3000, "conversion"), ("b", 4, 1000, "session_start"), ("b", 5, 1500, "pageview", {"page": "/"}),
        ("b", 6, 2500, "pageview", {"page": "/x"}), ("c", 7, 1, "click"),
    )
    jobs.ingest_log(log, root)
    sessions = jobs.with_device(tables.read_sessions(spark, root))
    report = site.site_report(sessions, tables.read_page_views(spark, root), tables.read_events(spark, root))
    got = {(r.section, r.key): r.value for r in report.collect()}
    assert got["total_visitors", None] == 2 and got["bounce_rate", None] == 50 and got["conversion_rate", None] == 50
    assert got["device_breakdown", "mobile"] == 1 and got["device_breakdown", "unknown"] == 1
    info = table(
        "deploy_time long, build_time long, status string, environment string, commit_sha string, branch string",
        (86_400, 86_000, "success", "production", "c", "main"),
    )
    jobs.record_deployment(info, 86_400, root)
    row = tables.read_deployments(spark, root).collect()[0]
    assert (row.deployment_duration, row.total_visitors, row.bounce_rate, row.conversion_rate) == (400, 2, 50.0, 50.0)
    assert (row.metrics_start_time, row.metrics_end_time) == (0, DAY_MS)
    assert report.filter(F.col("section") == "top_pages").count() == 2
