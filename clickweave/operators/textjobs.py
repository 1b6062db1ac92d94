"""Jobs over source files, commits and model replies.

Tables: ``repo_files(path, content)``, ``commits(sha, ts, seq, message)`` and
``replies(reply_id, raw)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave import schemas
from clickweave.functions import scalars as S
from clickweave.functions import texts as X
from clickweave.operators.history import KPIS, deployment_deltas, last_deployments
from clickweave.operators.running import Running, running

# Number of recent commits, defaults of a reply, and the headings of the page context.
RECENT_K = 3
DEFAULT_CONFIDENCE = 0.5
DEFAULT_REASONING = "No reasoning provided"
UNDEFINED = "undefined"
HEADINGS = {
    "page": "Main File: ",
    "components": "Component Files: ",
    "files": "FILE CONTENTS:",
    "history": "METRICS HISTORY:",
    "deltas": "METRIC CHANGES AFTER DEPLOYMENTS:",
    "recent": "RECENT CHANGES TO THIS PAGE:",
}
STRICT_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def page_files(files: DataFrame, suffix: str | None = None) -> DataFrame:
    hit = X.is_page_path(F.col("path"))
    return files.filter(hit if suffix is None else hit & F.col("path").endswith(suffix))


def relative_imports(files: DataFrame) -> DataFrame:
    """Relative import targets of every file, in order, with the path they resolve to."""
    return files.select(
        "path", F.posexplode(X.relative_imports(F.col("content"))).alias("pos", "target")
    ).withColumn("resolved", X.resolve_import(F.col("path"), F.col("target")))


def component_contents(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Content of every imported component that exists, one row per page and path. A path
    imported twice by one page is listed once, at its first position."""
    wanted = relative_imports(pages).groupBy("path", "resolved").agg(F.min("pos").alias("pos"))
    # A path listed twice counts once, with the greater text; sets of texts aggregate by hash.
    listed = files.select(F.col("path").alias("resolved"), "content").join(wanted.select("resolved"), "resolved", "left_semi")
    found = listed.groupBy("resolved").agg(F.array_max(F.collect_set("content")).alias("component"))
    return wanted.join(found, "resolved").select("path", "pos", "resolved", "component")


def page_components(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Per page: import targets as written, and a map from path to text for the page and
    its components. The lists hold one file's imports, so they stay small."""
    found = (
        component_contents(pages, files)
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "resolved", "component"))).alias("found"))
    )
    own = F.array(F.struct(F.col("path").alias("key"), F.col("content").alias("value")))
    others = F.transform(
        F.coalesce("found", F.array()),
        lambda x: F.struct(x["resolved"].alias("key"), x["component"].alias("value")),
    )
    different = F.filter(others, lambda e: e["key"] != F.col("path"))
    return pages.join(found, "path", "left").select(
        F.col("path").alias("main_file"),
        X.relative_imports(F.col("content")).alias("components"),
        F.map_from_entries(F.concat(own, different)).alias("contents"),
    )


def recent_changes(commits: DataFrame, k: int = RECENT_K) -> DataFrame:
    return (
        commits.orderBy(F.desc("ts"), F.desc("seq"))
        .limit(k)
        .select("ts", "seq", F.col("sha").alias("file"), F.split("message", "\n").alias("changes"))
    )


def _recent_array(commits: DataFrame, k: int) -> Column:
    """The ``k`` newest commits, newest first, as one array value."""
    rows = recent_changes(commits, k).select(
        F.struct((-F.col("ts")).alias("t"), (-F.col("seq")).alias("s"), "file", "changes").alias("r")
    )
    ordered = F.sort_array(F.collect_list("r"))
    return rows.agg(F.transform(ordered, lambda r: F.struct(r["file"], r["changes"]))).scalar()


def _relevant(recent: Column, needles: Column) -> Column:
    return F.filter(
        recent,
        lambda change: F.exists(
            change["changes"], lambda line: F.exists(needles, lambda n: line.contains(n))
        ),
    )


def relevant_changes(pages: DataFrame, commits: DataFrame, k: int = RECENT_K) -> DataFrame:
    """Recent changes that mention a page or one of its import targets as written. The
    ``k`` commits travel as one array, so the pages are only mapped, never joined."""
    needles = F.concat(F.array("path"), X.relative_imports(F.col("content")))
    hits = pages.withColumn("recent", _recent_array(commits, k)).withColumn(
        "hits", _relevant(F.col("recent"), needles)
    )
    return hits.select(F.col("path").alias("main_file"), F.posexplode("hits").alias("rank", "h")).select(
        "main_file", "rank", F.col("h.file").alias("sha"), F.array_join("h.changes", "\n").alias("message")
    )


# Words inside a text, with other characters on both sides; grams of texts without any.
_INNER_WORD = "(?<=[^A-Za-z0-9])([A-Za-z0-9]+)(?=[^A-Za-z0-9])"
_WORD, _GRAM = "[A-Za-z0-9]+", 3


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))


def _keys_of_needle(needle: Column) -> Column:
    """What a text that contains ``needle`` must hold: every word inside it as a word of its own; where there
    is none, every run of three characters, or the needle itself if it is shorter."""
    words = F.regexp_extract_all(needle, F.lit(_INNER_WORD), F.lit(1))
    return (
        F.when(F.size(words) > 0, F.transform(words, lambda w: F.concat(F.lit("w"), w)))
        .when(F.length(needle) >= _GRAM, F.transform(_grams(needle, _GRAM), lambda g: F.concat(F.lit("g"), g)))
        .otherwise(F.array(F.concat(F.lit("g"), needle)))
    )


def _keys_of_text(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.concat(F.lit("w"), w))
    grams = [F.when(F.length(text) >= n, _grams(text, n)).otherwise(F.array().cast("array<string>")) for n in range(1, _GRAM + 1)]
    return F.array_distinct(F.concat(words, F.transform(F.concat(*grams), lambda g: F.concat(F.lit("g"), g))))


#: Bits of a set of hashed keys, and those of one of its words.
_SET_BITS, _WORD_BITS = 1 << 23, 64


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_SET_BITS))


def _hashed_set(keys: DataFrame) -> Column:
    """The hashes of column ``key`` as one value: an array of 64-bit words, a megabyte whatever the number of keys."""
    place = _place(F.col("key"))
    bit = F.expr(f"shiftleft(1L, CAST(place % {_WORD_BITS} AS INT))")
    words = keys.select(place.alias("place")).groupBy(F.floor(F.col("place") / _WORD_BITS).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = keys.sparkSession.range(_SET_BITS // _WORD_BITS).join(words, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(listed, lambda w: w["bits"])).scalar()


def _may_hold(hashed: Column, key: Column) -> Column:
    """Whether ``key`` may be in the set; True for all that are."""
    place = _place(key)
    return F.getbit(F.get(hashed, F.floor(place / _WORD_BITS).cast("int")), place % _WORD_BITS) == 1


def relevant_changes_all(pages: DataFrame, commits: DataFrame) -> DataFrame:
    """``relevant_changes`` over the whole history: ``main_file``, ``sha``, ``ts`` of every commit a line of
    which mentions a page or one of its import targets as written.

    Every needle is indexed by the rarest of its keys; a commit's keys fetch candidates by an equi-join, and
    only those are searched. Texts are not shuffled with their keys. Of a commit's keys, many to a text, nothing
    but counts and those that the index may have are shuffled.
    """
    wanted = pages.select(F.col("path").alias("main_file"), F.explode(F.concat(F.array("path"), X.relative_imports(F.col("content")))).alias("needle"))
    # A line never holds a line feed.
    wanted = wanted.filter(S.present(F.col("needle")) & ~F.col("needle").contains("\n")).distinct()
    needles = wanted.select("needle").distinct().select("needle", F.explode(F.array_distinct(_keys_of_needle(F.col("needle")))).alias("key"))
    numbered = commits.select("sha", "ts", "message")
    keys = numbered.select("sha", "ts", F.explode(_keys_of_text(F.col("message"))).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    # A needle with a key that no commit has is mentioned nowhere.
    known = needles.join(counts, "key", "left")
    rarest = known.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    index = rarest.filter("k.n > 0").select("needle", F.col("k.key").alias("key"))
    fetching = keys.filter(_may_hold(_hashed_set(index), F.col("key")))
    candidates = fetching.join(index, "key").select("needle", "sha", "ts").distinct()
    hits = candidates.join(numbered.select("sha", "ts", "message"), ["sha", "ts"]).filter(F.col("message").contains(F.col("needle")))
    return hits.join(wanted, "needle").select("main_file", "sha", "ts").distinct()


def clean_replies(replies: DataFrame) -> DataFrame:
    return replies.withColumn("cleaned", X.clean_reply(F.col("raw")))


def _parsed(replies: DataFrame) -> DataFrame:
    return clean_replies(replies).withColumn(
        "changes", F.from_json("cleaned", schemas.REPLY, STRICT_JSON)["changes"]
    )


def _confidence(c: Column) -> Column:
    return F.coalesce(S.number_or_null(c.try_cast("double")), F.lit(DEFAULT_CONFIDENCE))


def _modifications(c: Column) -> Column:
    """Modifications of a change; anything but an array counts as none."""
    none = F.lit(None).cast(schemas.MODIFICATIONS)
    return F.transform(
        F.coalesce(c, F.when(none.isNull(), F.array()).cast(schemas.MODIFICATIONS)),
        lambda m: F.struct(
            m["type"].alias("type"),
            m["lineNumber"].try_cast("double").alias("line_number"),
            S.text_or_null(m["content"]).alias("content"),
            F.coalesce(m["reasoning"], F.lit(UNDEFINED)).alias("reasoning"),
        ),
    )


def reply_changes(replies: DataFrame) -> DataFrame:
    """One row per suggested change of every readable reply."""
    return (
        _parsed(replies)
        .filter(F.col("changes").isNotNull())
        .select("reply_id", F.posexplode("changes").alias("pos", "c"))
        .select(
            "reply_id",
            "pos",
            F.coalesce("c.filePath", F.lit("")).alias("file_path"),
            _modifications(F.col("c.modifications")).alias("modifications"),
            _confidence(F.col("c.confidence_score")).alias("confidence_score"),
            F.coalesce(S.text_or_null(F.col("c.reasoning")), F.lit(DEFAULT_REASONING)).alias("reasoning"),
        )
    )


def parse_reply(replies: DataFrame) -> DataFrame:
    """One row per modification; a change without any keeps one row."""
    return reply_changes(replies).select(
        "reply_id",
        "pos",
        "file_path",
        "confidence_score",
        "reasoning",
        F.posexplode_outer("modifications").alias("mod_pos", "m"),
    ).select(
        "reply_id",
        "pos",
        "file_path",
        "confidence_score",
        "reasoning",
        "mod_pos",
        F.col("m.type").alias("type"),
        F.col("m.line_number").alias("line_number"),
        F.col("m.content").alias("content"),
        F.col("m.reasoning").alias("mod_reasoning"),
    )


def rejected_replies(replies: DataFrame) -> DataFrame:
    """Replies without a readable ``changes`` array."""
    return _parsed(replies).filter(F.col("changes").isNull()).select("reply_id", "raw", "cleaned")


def changes_by_file(replies: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Changes grouped by file with their order kept: each gets its number within the
    file. A file's changes stay rows, however many there are."""
    rows = reply_changes(replies)
    numbered = running(
        rows,
        ["file_path"],
        ["reply_id", "pos"],
        [Running("change_no", "sum", F.lit(1))],
        F.floor(F.col("reply_id") / chunk).cast("bigint"),
    )
    return numbered.select(
        "file_path", "change_no", "reply_id", "pos", F.size("modifications").alias("n_modifications")
    )


def digest_markdown(replies: DataFrame) -> DataFrame:
    """One text per reply: a heading, the reasoning and a bullet list per change."""
    bullets = lambda c: F.array_join(
        F.transform(
            _modifications(c["modifications"]),
            lambda m: F.concat(F.lit("- "), F.coalesce(m["type"], F.lit(UNDEFINED)), F.lit(": "), m["reasoning"]),
        ),
        "\n",
    )
    part = lambda c: F.concat(
        F.lit("## "),
        F.coalesce(c["filePath"], F.lit("")),
        F.lit("\n\n"),
        F.coalesce(S.text_or_null(c["reasoning"]), F.lit(DEFAULT_REASONING)),
        F.lit("\n\n"),
        bullets(c),
    )
    return _parsed(replies).filter(F.col("changes").isNotNull()).select(
        "reply_id", F.array_join(F.transform("changes", part), "\n\n").alias("digest")
    )


def clean_code(answers: DataFrame) -> DataFrame:
    """Source text of every answer; answers without any are dropped."""
    return answers.select("path", X.clean_code(F.col("answer")).alias("code")).filter(
        F.col("code").isNotNull()
    )


def _json_array(df: DataFrame, columns: list[str]) -> Column:
    """A few rows, newest first, as one JSON text."""
    rows = df.select(F.struct((-F.col("deploy_time")).alias("t"), (-F.col("id")).alias("i"), F.struct(*columns).alias("r")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"])
    return rows.agg(F.to_json(ordered, {"ignoreNullFields": "false"})).scalar()


def page_context(
    pages: DataFrame, files: DataFrame, commits: DataFrame, deployments: DataFrame
) -> DataFrame:
    """Everything known about a page as one text: its files, the last deployments, their
    differences, and the recent changes that mention it. The history parts are a few rows
    and enter as scalar subqueries."""
    last = last_deployments(deployments)
    history = _json_array(last, ["id", "deploy_time", "environment", "commit_sha", *KPIS])
    deltas = _json_array(
        deployment_deltas(last),
        ["deploy_time", "commit_sha", "bounce_rate_change", "avg_time_change", "visitors_change", "conversion_change"],
    )
    listed = (
        component_contents(pages, files)
        .filter(F.col("resolved") != F.col("path"))
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "resolved", "component"))).alias("found"))
    )
    c = F.col
    block = lambda path, text: F.concat(F.lit("--- "), path, F.lit(" ---\n"), text)
    title = lambda name: F.lit(f"\n\n{HEADINGS[name]}\n")
    needles = F.concat(F.array("path"), c("components"))
    return (
        pages.withColumn("components", X.relative_imports(c("content")))
        .join(listed, "path", "left")
        .withColumns({"history": history, "deltas": deltas, "recent": _recent_array(commits, RECENT_K)})
        .select(
            c("path").alias("main_file"),
            F.concat(
                F.lit(HEADINGS["page"]), c("path"), F.lit("\n"),
                F.lit(HEADINGS["components"]), F.array_join("components", ", "),
                title("files"),
                F.array_join(
                    F.concat(
                        F.array(block(c("path"), c("content"))),
                        F.transform(
                            F.coalesce("found", F.array()),
                            lambda x: block(x["resolved"], x["component"]),
                        ),
                    ),
                    "\n",
                ),
                title("history"), c("history"),
                title("deltas"), c("deltas"),
                title("recent"),
                F.to_json(_relevant(c("recent"), needles)),
            ).alias("context"),
        )
    )
