import random

import pytest
from pyspark.sql import functions as F

from clickweave.operators import behavior
from clickweave.operators import ingest as batch
from clickweave.plans import jobs
from clickweave.session import scratch_dir
from clickweave.sources.fixtures import view
from clickweave.sources import tables
from clickweave.sources.store import Run, Store
from clickweave.sources.tables import read_tracking
from clickweave.streaming import ingest, partials, queries

SF = "/root/testdata/sf0.001"


def text(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same_as_batch(spark, log, root):
    undated = lambda df: df.drop("event_date")
    assert text(undated(tables.read_page_views(spark, root))) == text(batch.fold_page_views(log))
    assert text(undated(tables.read_sessions(spark, root))) == text(batch.fold_sessions(log))
    assert text(undated(tables.read_events(spark, root))) == text(batch.fold_events(log))
    columns = ["session_id", "seq", "ts", "event", "page", "reason", "status"]
    assert text(tables.read_rejects(spark, root).select(*columns)) == text(batch.rejects(log).select(*columns))


@pytest.fixture(scope="module")
def log(spark):
    return view(spark, SF, "fx_raw").drop("forwarded_for").cache()


def slices(log, parts):
    low, high = log.agg(F.min("ts"), F.max("ts")).collect()[0]
    step = (high - low) // parts + 1
    return [log.filter((F.col("ts") >= low + i * step) & (F.col("ts") < low + (i + 1) * step)) for i in range(parts)]


@pytest.mark.parametrize("parts", [1, 3])
def test_micro_batches_equal_the_batch_fold(spark, log, parts, both_ways):
    """One file per trigger, files in order of arrival; sessions span several batches."""
    root = scratch_dir(spark, "stream")
    query_dir = f"{root}/log"
    for part in slices(log, parts):
        part.coalesce(1).write.mode("append").json(query_dir)
        records = read_tracking(spark, query_dir, stream=True)
        ingest.start(records, f"{root}/tables", f"{root}/cp", buckets=2).awaitTermination()
    assert len(Store(spark, f"{root}/tables").runs) == parts
    same_as_batch(spark, log, f"{root}/tables")


def test_a_batch_reads_few_runs(spark, log):
    """However many micro-batches came before, a bucket and a day are made up of a few runs a level."""
    root = scratch_dir(spark, "levels")
    for n, part in enumerate(slices(log, 10)):
        ingest.fold_batch(part, n, root, fan_in=3, buckets=2)
        store = Store(spark, root)
        # Two runs at most wait on each level.
        for table in (jobs.STATE, "page_views", "sessions"):
            assert max(len([e for e in runs if e[2]]) for runs in store.parts(table).values()) <= 6
    same_as_batch(spark, log, root)


def test_repeated_batch_changes_nothing(spark, log):
    root = scratch_dir(spark, "repeat")
    first, second = slices(log, 2)
    for n, part in ((0, first), (1, second), (1, second), (0, first)):
        ingest.fold_batch(part, n, root, buckets=2)
    same_as_batch(spark, log, root)


@pytest.mark.parametrize("fan_in", [1, 4])
def test_a_job_stopped_between_two_writes(spark, log, monkeypatch, fan_in):
    """Nothing of the stopped run is seen; run again, it gives the tables of the single fold."""
    root = scratch_dir(spark, "stopped")
    first, second = slices(log, 2)
    jobs.ingest_log(first, root, "first", fan_in, 2)
    before = text(tables.read_page_views(spark, root))
    whole = Run.add

    def stops(self, df, table, *more):
        if table == "rejects":
            raise OSError("lost")
        whole(self, df, table, *more)

    monkeypatch.setattr(Run, "add", stops)
    with pytest.raises(OSError):
        jobs.ingest_log(second, root, "second", fan_in, 2)
    monkeypatch.undo()
    assert text(tables.read_page_views(spark, root)) == before
    jobs.ingest_log(second, root, "second", fan_in, 2)
    same_as_batch(spark, log, root)


def test_two_writers_conflict(spark, log):
    root = scratch_dir(spark, "conflict")
    one, other = Store(spark, root).begin("one"), Store(spark, root).begin("other")
    one.commit()
    with pytest.raises(RuntimeError):
        other.commit()
    assert Store(spark, root).runs == ["one"]


def test_copy_on_write_touches_corrected_days_only(spark, raw):
    root, day = scratch_dir(spark, "days"), 86_400_000
    jobs.ingest_log(
        raw(("a", 1, 10, "session_start"), ("a", 2, 20, "pageview", {"page": "/"}), ("b", 3, day + 10, "session_start"),
            ("b", 4, day + 20, "pageview", {"page": "/b"})), root, "one",
    )
    jobs.ingest_log(raw(("b", 5, 2 * day, "session_end", {"time_spent": 9}), ("b", 6, 2 * day + 1, "pageview", {"page": "/c"})), root, "two")
    parts = Store(spark, root).parts("page_views")
    runs = {p: [r for r, *_ in e] for p, e in parts.items()}
    assert runs == {"1970-01-01": ["one"], "1970-01-02": ["two"], "1970-01-03": ["two"]}
    got = {r.page: r.time_spent for r in tables.read_page_views(spark, root).collect()}
    assert got == {"/": None, "/b": 9, "/c": None}
    assert {r.session_id: r.end_time for r in tables.read_sessions(spark, root).collect()} == {"a": None, "b": 2 * day}


def test_late_batch_updates_the_latest_view(spark, raw, both_ways):
    """A record stamped earlier but arriving later still concerns the newest view."""
    root = scratch_dir(spark, "late")
    ingest.fold_batch(raw(("a", 1, 10, "session_start"), ("a", 2, 100, "pageview", {"page": "/"})), 0, root)
    ingest.fold_batch(raw(("a", 3, 50, "session_end", {"time_spent": 7}), ("b", 4, 1, "click")), 1, root)
    assert [(r.page, r.time_spent) for r in tables.read_page_views(spark, root).collect()] == [("/", 7)]
    assert [r.seq for r in tables.read_rejects(spark, root).collect()] == [4]


# --- partial results ----------------------------------------------------------


def fed(spark, kind, schema, batches, fan_in=2):
    """Results after each batch was added, then after the last one was added again."""
    root = scratch_dir(spark, "fed")
    frames = [spark.createDataFrame(list(rows), schema) for rows in batches]
    for n, df in enumerate([*frames, frames[-1]]):
        partials.add_batch(df, min(n, len(frames) - 1), root, kind, buckets=2, fan_in=fan_in)
    return partials.results(spark, root, kind, partials.partial_schema(frames[0], kind))


def test_a_late_row_bridges_two_sessions(spark, both_ways):
    gap = 1_800_000
    kind = partials.sessions("u", "ms")
    got = fed(spark, kind, "u string, ms long", [[("a", 2 * gap)], [("a", 0), (None, 1), ("b", 9 * gap)], [("a", gap)], [("a", 4 * gap)]])
    assert sorted((r.u or "", r.session_start, r.last_activity, r.n_events, r.is_open) for r in got.collect()) == [
        ("", 1, 1, 1, False), ("a", 0, 2 * gap, 3, False), ("a", 4 * gap, 4 * gap, 1, False), ("b", 9 * gap, 9 * gap, 1, True),
    ]


def rows_of_views(seed, n):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choice(["scroll", "signal", "enter", "leave", "start"])
        at = rng.choice([rng.randint(0, 60_000), 10_000, 0])
        section = rng.choice(["s", "t", None]) if kind in ("enter", "leave") else None
        rows.append((f"v{rng.randint(0, 5)}", seq, at, kind, section, rng.randint(0, 100) if kind == "scroll" else None))
    return rows


INTERACTIONS = "view_id string, seq long, ts long, kind string, section string, scroll_pct int"


@pytest.mark.parametrize("seed", [1, 2])
def test_views_in_any_order_equal_the_batch_form(spark, seed):
    rows = rows_of_views(seed, 90)
    whole = spark.createDataFrame(rows, INTERACTIONS)
    random.Random(seed).shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    for kind, form in (
        (partials.engagement(), behavior.engagement), (partials.bounce_or_end(), behavior.bounce_or_end),
        (partials.section_dwell(), behavior.section_dwell),
    ):
        assert text(fed(spark, kind, INTERACTIONS, batches)) == text(form(whole))


def test_an_enter_and_its_leave_in_different_batches(spark):
    moves = [[("v", 2, 50, "leave", "s", None)], [("v", 1, 10, "enter", "s", None)], [("v", 3, 20, "enter", "s", None)]]
    got = fed(spark, partials.section_dwell(), INTERACTIONS, moves).collect()
    assert [(r.entered_at, r.left_at, r.dwell_ms) for r in got] == [(20, 50, 30)]


def test_quota_and_bursts_of_several_batches(spark):
    kind = partials.over_quota("u", "ms", 2, 1000)
    got = fed(spark, kind, "u string, ms long", [[("a", 0), ("b", 0)], [("a", 999), ("a", 1000)], [("a", 20)]])
    assert [(r.u, r.window_start, r.hits) for r in got.collect()] == [("a", 0, 3)]
    rows = [[("a", 999, 2, None)], [("a", 1999, 3, 6), ("z", 5, 4, 1)], [("a", 0, 1, 5)]]
    got = fed(spark, partials.bursts("k", 1000, ["x"]), "k string, ts long, seq long, x int", rows).collect()
    assert sorted((r.k, r.first_ts, r.ts, r.seq, r.n_rows, r.x) for r in got) == [
        ("a", 0, 999, 2, 2, 5), ("a", 1999, 1999, 3, 1, 6), ("z", 5, 5, 4, 1, 1),
    ]


def test_partials_of_many_batches_stay_in_few_files(spark):
    root, kind = scratch_dir(spark, "many"), partials.over_quota("u", "ms", 0, 1000)
    for n in range(12):
        partials.add_batch(spark.createDataFrame([("a", n), ("b", n)], "u string, ms long"), n, root, kind, buckets=1, fan_in=3)
    runs = Store(spark, root).parts("quota")["0"]
    assert len(runs) <= 4 and {e[1] for e in runs} <= {0, 1, 2}
    df = spark.createDataFrame([], "u string, ms long")
    got = partials.results(spark, root, kind, partials.partial_schema(df, kind)).collect()
    assert sorted((r.u, r.hits) for r in got) == [("a", 12), ("b", 12)]


def test_large_parts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A replayed table is dealt to a few parts; how many tasks write them follows its size."""
    rows = spark.range(20_000).selectExpr("CAST(id % 50 AS string) AS user", "id * 1000 AS ts", "id").repartition(8)
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, label: f"{tmp_path}/{label}-0")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        got = queries.replayed(rows.select("user", "ts", "id"), partials.over_quota("user", "ts", 2, 10_000_000), "id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sum(r.hits for r in got) == 20_000
    assert len(list(tmp_path.glob("quota-*/rows/file=*/*.parquet"))) > 2 * queries.FILES


def test_log_is_read_once(spark, raw, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    day = 86_400_000
    log = raw(("a", 1, 5, "session_start"), ("a", 2, 6, "pageview", {"page": "/x"}), ("b", 3, 7, "click"), (None, 4, 8, "click"))
    later = raw(("a", 5, day, "click"), ("a", 6, day + 1, "session_end", {"time_spent": 9}))
    for n, part in enumerate((log, later)):
        jobs.ingest_log(part.mapInArrow(count, part.schema), str(tmp_path / "log"), str(n))
    assert seen.value == 6
    assert [(r.id, r.time_spent) for r in tables.read_page_views(spark, str(tmp_path / "log")).collect()] == [(2, 9)]

    seen.value = 0
    head = '{"seq": 1, "arrival": 10, "session_id": "s", '
    lines = spark.createDataFrame(
        [
            (head + '"event": "session_start"}',), ('{"seq": 2, "arrival": 11, "session_id": "s", "body": "{\\"events\\":[]}"}',),
            (head[:20],), ('{"seq": 9000000000000000000, "arrival": 12, "session_id": "s", "body": "{}"}',),
        ],
        "value string",
    )
    jobs.ingest_requests(lines.mapInArrow(count, lines.schema), str(tmp_path / "lines"))
    assert seen.value == 4
    dead = tables.read_dead_letters(spark, str(tmp_path / "lines")).collect()
    assert sorted((r.arrival or 0, r.status) for r in dead) == [(0, 500), (12, 400)]
    assert all(r.value in {head[:20], lines.collect()[3].value} for r in dead)
    assert tables.read_sessions(spark, str(tmp_path / "lines")).count() == 1 and tables.read_rejects(spark, str(tmp_path / "lines")).count() == 0
