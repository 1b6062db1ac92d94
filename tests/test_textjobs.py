import json

from pyspark.sql import functions as F

from clickweave.operators import textjobs


def reply(changes):
    return "Sure!\n```json\n" + json.dumps({"changes": changes}) + "\n```\nBye."


def test_replies(table):
    good = reply([
        {"filePath": "a.tsx", "confidence_score": 0.9, "reasoning": "why", "modifications": [
            {"type": "SPACING", "lineNumber": "12", "content": "", "reasoning": "r1"}, {"type": "SIZE_CHANGE", "lineNumber": "x"}]},
        {"filePath": "b.tsx", "confidence_score": 0, "modifications": "none"},
        {"confidence_score": "0.25", "modifications": []},
    ])
    df = table(
        "reply_id long, raw string",
        (1, good), (2, "no json"), (3, '{"changes": {"a": 1}}'), (4, '{"other": []}'), (5, '{"changes": []}'),
        (6, reply([{"filePath": "a.tsx", "confidence_score": 1, "modifications": []}])),
        (7, "{'changes': []}"),
    )
    rows = textjobs.parse_reply(df).orderBy("reply_id", "pos", "mod_pos").collect()
    assert [tuple(r) for r in rows if r.reply_id == 1] == [
        (1, 0, "a.tsx", 0.9, "why", 0, "SPACING", 12.0, None, "r1"),
        (1, 0, "a.tsx", 0.9, "why", 1, "SIZE_CHANGE", None, None, "undefined"),
        (1, 1, "b.tsx", 0.5, "No reasoning provided", None, None, None, None, None),
        (1, 2, "", 0.25, "No reasoning provided", None, None, None, None, None),
    ]
    assert sorted(r.reply_id for r in textjobs.rejected_replies(df).collect()) == [2, 3, 4, 7]
    numbered = textjobs.changes_by_file(df, chunk=2).collect()
    assert sorted((r.file_path, r.change_no, r.reply_id) for r in numbered) == [
        ("", 1, 1), ("a.tsx", 1, 1), ("a.tsx", 2, 6), ("b.tsx", 1, 1),
    ]
    digest = {r.reply_id: r.digest for r in textjobs.digest_markdown(df).collect()}
    assert digest[1].startswith("## a.tsx\n\nwhy\n\n- SPACING: r1\n- SIZE_CHANGE: undefined\n\n## b.tsx\n\nNo reasoning provided\n\n")
    assert digest[5] == ""


def test_pages(table):
    files = table(
        "path string, content string",
        ("src/app/x/page.tsx", "import A from './a';\nimport B from '../missing';\nimport C from './a';\nimport D from './page';"),
        ("src/app/x/a.tsx", "text of a"),
        ("src/app/_y.tsx", "hidden"),
    )
    pages = textjobs.page_files(files, "page.tsx")
    got = textjobs.page_components(pages, files).collect()[0]
    assert got.components == ["./a", "../missing", "./a", "./page"]
    assert set(got.contents) == {"src/app/x/page.tsx", "src/app/x/a.tsx"}
    commits = table(
        "sha string, ts long, seq long, message string",
        ("old", 1, 1, "src/app/x/page.tsx"), ("n1", 5, 2, "mentions ./a\nmore"), ("n2", 5, 3, "nothing"), ("n3", 4, 4, "src/app/x/page.tsx"),
    )
    assert [r.file for r in textjobs.recent_changes(commits).collect()] == ["n2", "n1", "n3"]
    hits = textjobs.relevant_changes(pages, commits).orderBy("rank").collect()
    assert [(r.sha, r.message) for r in hits] == [("n1", "mentions ./a\nmore"), ("n3", "src/app/x/page.tsx")]


def test_relevant_changes_of_all_history(table):
    """Needles inside words, short ones, ones without a word inside, and ones no commit can hold."""
    pages = table(
        "path string, content string",
        ("src/page.tsx", "import a from './view'; import b from '..'; import c from './zzz/q.ts'"), ("p", "import x from '.'"), ("é/a", ""),
    )
    messages = ["touch src/page.tsx", "xsrc/page.tsxx", "src/page .tsx", "uses ./viewer", "no", "up..", "é/a\nb", "", None, "q.ts zzz"]
    commits = table("sha string, ts long, message string", *[(f"c{i}", i, m) for i, m in enumerate(messages)])
    got = sorted((r.main_file, r.sha) for r in textjobs.relevant_changes_all(pages, commits).collect())
    needles = {"src/page.tsx": ["src/page.tsx", "./view", "..", "./zzz/q.ts"], "p": ["p", "."], "é/a": ["é/a"]}
    expected = {(p, f"c{i}") for p, ns in needles.items() for i, m in enumerate(messages) if m and any(n in m for n in ns)}
    assert got == sorted(expected)
    plan = textjobs.relevant_changes_all(pages, commits)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def _shuffled_rows(plan):
    """Rows written by all shuffles of a plan that has run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    below = plan.children()
    return own + sum(_shuffled_rows(below.apply(i)) for i in range(below.size()))


def test_keys_of_commits_stay_where_they_are(spark, table):
    """A commit has a hundred keys and more; those that no needle is indexed by are counted, not shuffled,
    also where the needles have them."""
    n = 2_000
    pages = table("path string, content string", *[(f"src/app/d{i}/page.tsx", "import a from './view'") for i in range(50)])
    texts = [f"Update the page and its view ./vie\ntouches src/app/d{i % 100}/page.tsx" for i in range(n)]
    commits = table("sha string, ts long, message string", *[(f"c{i}", i, m) for i, m in enumerate(texts)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = textjobs.relevant_changes_all(pages, commits)
        rows = {(r.main_file, r.sha) for r in got.collect()}
        assert rows == {(f"src/app/d{i % 100}/page.tsx", f"c{i}") for i in range(n) if i % 100 < 50}
        # One candidate for every second commit; each is shuffled a few times, each message once, and a hundred keys each before.
        assert _shuffled_rows(got._jdf.queryExecution().executedPlan()) < 10 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_set_of_hashed_keys(spark):
    keys = spark.range(1000).selectExpr("CAST(id AS string) AS key")
    asked = spark.range(50_000).selectExpr("CAST(id AS string) AS key")
    held = asked.filter(textjobs._may_hold(textjobs._hashed_set(keys), F.col("key")))
    assert held.join(keys, "key").count() == 1000 and held.count() < 1100
    assert asked.filter(textjobs._may_hold(textjobs._hashed_set(keys.limit(0)), F.col("key"))).count() == 0
