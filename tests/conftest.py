import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from clickweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(params=["ordinary", "hot"])
def both_ways(request, spark):
    """Run a test with all keys treated as ordinary, then with all of them as hot."""
    spark.conf.set("spark.clickweave.hotKeyRows", "1" if request.param == "hot" else "1000000")
    yield request.param
    spark.conf.unset("spark.clickweave.hotKeyRows")


@pytest.fixture
def table(spark):
    """Rows with a DDL schema as a DataFrame."""
    return lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)


@pytest.fixture
def raw(table):
    """Tracking records given as (session, seq, ts, event, more fields)."""
    from clickweave import schemas
    from clickweave.sources.tables import evolve_schema

    ddl = (
        "session_id string, seq long, ts long, event string, page string, scroll_depth string, "
        "time_spent long, ttfb double, fcp double, lcp double, cls double, element string, user_agent string, "
        "latitude double"
    )
    fields = [f.split()[0] for f in ddl.split(", ")]

    def make(*records):
        rows = []
        for session, seq, ts, event, *more in records:
            values = {"session_id": session, "seq": seq, "ts": ts, "event": event} | (more[0] if more else {})
            rows.append(tuple(values.get(f) for f in fields))
        return evolve_schema(table(ddl, *rows), schemas.TRACKING)

    return make
