"""Values and settings that must not lose rows or end a job."""

import tempfile

import pytest
from pyspark.sql import functions as F

from clickweave.functions import scalars as S
from clickweave.functions import texts as X
from clickweave.operators import behavior, textjobs
from clickweave.operators.timeframe import Timeframe, in_timeframe
from clickweave.sources import tables

HOUR = 3_600_000
MIDNIGHT = 1_704_844_800_000  # 2024-01-10T00:00Z


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_stored_days_are_utc_days(spark, table, new_york):
    root = tempfile.mkdtemp(prefix="clickweave-")
    views = table("id string, session_id string, page string, timestamp long", ("a", "s", "/", MIDNIGHT + HOUR))
    tables.append_page_views(views, root)
    stored = tables.read_page_views(spark, root)
    assert in_timeframe(stored, "timestamp", Timeframe(MIDNIGHT, MIDNIGHT + 24 * HOUR)).count() == 1


def test_iso_time_is_utc(table, new_york):
    got = table("t long", (MIDNIGHT // 1000,), (-1,), (None,)).select(S.iso_time(F.col("t"))).collect()
    assert [r[0] for r in got] == ["2024-01-10T00:00:00.000Z", "1969-12-31T23:59:59.000Z", None]


def test_huge_values_are_rounded(table):
    got = table("x double", (1e13,), (float("inf"),), (1.005,), (None,)).select(S.fixed(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [1e13, float("inf"), 1.01, None]
    assert table("x double", (1e13,)).select(S.one_decimal(F.col("x"))).first()[0] is not None


def test_import_beyond_the_root(table):
    got = table("p string, t string", ("src/page.tsx", ".."), ("src/page.tsx", "../a")).select(
        X.resolve_import(F.col("p"), F.col("t"))
    )
    first, second = (r[0] for r in got.collect())
    assert first is None and second.startswith("a")


def test_a_path_listed_twice(table):
    files = table(
        "path string, content string",
        ("src/page.tsx", "import A from './a.tsx'"), ("src/a.tsx", "one"), ("src/a.tsx", "two"),
    )
    got = textjobs.page_components(files.filter("path = 'src/page.tsx'"), files).collect()
    assert [r.contents["src/a.tsx"] for r in got] == ["two"]


def test_rows_without_a_user_have_no_session_id(table):
    rows = table("u string, ts long, n long", (None, 1, 1), (None, 2, 2), ("a", 3, 3))
    got = behavior.sessionize(rows, "u", "ts", "n").collect()
    assert {(r.n, r.session_id is None) for r in got} == {(1, True), (2, True), (3, False)}


def test_deployment_ids_are_kept_on_a_rerun(spark, table):
    root = tempfile.mkdtemp(prefix="clickweave-")
    rows = table("deploy_time long, environment string, commit_sha string", (1, "p", "x"), (2, "p", "y"))
    tables.append_deployments(rows, root)
    tables.append_deployments(rows, root)
    ids = [r.id for r in tables.read_deployments(spark, root).collect()]
    assert None not in ids and len(ids) == 2 and len(set(ids)) == 2
    tables.append_deployments(table("deploy_time long, environment string, commit_sha string", (3, "p", "z"), (1, "p", "x")), root)
    assert tables.read_deployments(spark, root).count() == 3
