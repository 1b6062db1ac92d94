"""Personal data by fixed patterns and by bootstrapped contextual extraction.

Four kinds are found by fixed expressions (email, ip, card, phone): the base spans, which
always stay. They seed a bootstrap: an *instance* is a whole base span (without the
separators of its digits) or another token with a digit, its *pattern* the word of any script
that stands before it, also across a line break. Base spans are certain. Patterns and
instances form a weighted graph, scored in ``ROUNDS`` rounds: a pattern is as good as the
instances it introduces, against all places of its word in the corpus (with a discount for
rare patterns), so a word that mostly introduces something else is refused; an instance is as
good as the patterns that introduce it. Patterns of ``LEAST_SCORE`` with ``LEAST_SUPPORT``
different instances of that score then mark whatever else with a digit they introduce as an
``id`` span, identifiers that no expression knows.

Only DataFrame functions: matches come from ``regexp_extract_all`` and their places from
the lengths of what ``split`` leaves between them. Expressions are possessive, so no text
makes them backtrack or recurse. The corpus is scanned once for spans and contexts (no texts),
which are written to the shared folder and joined, and once to count words. A frequent word
is one key of pre-aggregated rows.

Defined results: a null or empty text has no spans. Rows are told apart by a number of
their own, so repeated rows, ties and null ids are judged row by row; an empty table gives
no rows. All places are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickweave.llm.common import materialise

KINDS = ["email", "ip", "card", "phone"]
CONTEXTUAL = "id"
ROUNDS = 3
LEAST_SCORE = 0.5
LEAST_SUPPORT = 5

# The base kinds; possessive where that changes no match.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"

#: A word, up to four characters between, and a token with a digit.
_LETTER = r"\p{L}\p{M}"
_BETWEEN = rf"[^{_LETTER}0-9]{{1,4}}+"
_CONTEXT = rf"(?<![{_LETTER}])[{_LETTER}]++{_BETWEEN}[A-Za-z._+-]*+[0-9][A-Za-z0-9._+-]*+"
_BEFORE = rf"[^{_LETTER}]([{_LETTER}]++){_BETWEEN}$"
#: Characters before a base span in which its word is looked for; longer words are no patterns.
_REACH = 80
_INSTANCE = r"([A-Za-z._+-]*[0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?)([._+-]*)$"

_SPANS = "array<struct<start: bigint, stop: bigint, hit: string>>"


#: Elements that a fold puts into one array before it begins another: appending copies an array.
_BLOCK = 64
#: Characters of the pieces a text is cut into, so that a place in it is found without counting from its start.
_PIECE = 512


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _folded(items: Column, carry: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` gives for each of ``items`` (arrays of ``kind``, one after the other), and the last carry, as
    ``out`` and ``carry``. ``step`` takes the carry and an item and gives the next carry and the array.
    Arrays grow in blocks, so the work is in proportion to the items."""
    none = F.array().cast(f"array<{kind}>")

    def add(state: Column, item: Column) -> Column:
        following, more = step(state["carry"], item)
        return F.struct(following.alias("carry"), F.concat(state["out"], more).alias("out"))

    def over(all_items: Column) -> Column:
        block = lambda i: F.slice(all_items, i * _BLOCK + 1, F.lit(_BLOCK))
        last = F.floor((F.size(all_items) - 1) / _BLOCK).cast("int")
        blocks = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        # First what each block begins with, then the blocks by themselves.
        carries = F.aggregate(
            blocks, F.array(carry),
            lambda s, i: F.array_append(s, F.aggregate(block(i), F.element_at(s, -1), lambda c, item: step(c, item)[0])),
        )

        def outputs(begins: Column) -> Column:
            start = lambda i: F.struct(F.element_at(begins, i + 1).alias("carry"), none.alias("out"))
            out = F.transform(blocks, lambda i: F.aggregate(block(i), start(i), add)["out"])
            return F.struct(F.element_at(begins, -1).alias("carry"), F.flatten(out).alias("out"))

        return _bound(carries, outputs)

    return _bound(items, over)


def _pieces(text: Column) -> Column:
    """The text cut into pieces of ``_PIECE`` characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to before ``stop`` of a text in pieces."""
    first = F.floor(start / _PIECE).cast("int")
    n = F.floor(stop / _PIECE).cast("int") - first + 1
    near = F.array_join(F.slice(pieces, first + 1, n), "")
    return F.substr(near, (start - first * _PIECE + 1).cast("int"), (stop - start).cast("int"))


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches with their places, those that ``keep`` accepts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The text after the last match has none.
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("between"), hits.alias("hit"))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        first = at + F.length(pair["between"])
        stop = first + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.struct(first.alias("start"), stop.alias("stop"), pair["hit"].alias("hit"))
        return stop, F.when(pair["hit"].isNotNull(), F.array(span)).otherwise(F.array().cast(_SPANS))

    found = _folded(pairs, F.lit(0).cast("bigint"), "struct<start: bigint, stop: bigint, hit: string>", step)["out"]
    return F.filter(found, lambda s: keep(s["hit"])) if keep else found


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind; a text without a kind's fixed character is not searched for it."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(_SPANS)
    sized = lambda hit, low, high: F.length(_digits(hit)).between(low, high)
    card = F.filter(matches(t, CARD, lambda h: sized(h, 13, 19)), lambda s: luhn(_digits(s["hit"])))
    # Without 13 digits in a row of digits and separators there is no card to look for.
    long_number = t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    return {
        "email": F.when(F.contains(t, F.lit("@")), matches(t, EMAIL)).otherwise(none),
        "ip": F.when(t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), matches(
            t, IP, lambda h: F.forall(F.split(h, r"\."), lambda p: p.rlike(_BYTE)))).otherwise(none),
        "card": F.when(long_number, card).otherwise(none),
        "phone": F.when(F.contains(t, F.lit("+")), matches(t, PHONE, lambda h: sized(h, 9, 15))).otherwise(none),
    }


def _contexts(text: Column, base: Column) -> Column:
    """pattern, instance, start, stop, seed of base spans and other tokens with a digit that a word introduces."""
    t = F.coalesce(text, F.lit(""))

    def context(pattern: Column, instance: Column, start: Column, stop: Column, seed: bool) -> Column:
        return F.struct(
            F.lower(pattern).alias("pattern"), instance.alias("instance"),
            start.alias("start"), stop.alias("stop"), F.lit(seed).alias("seed"),
        )

    def of_base(pieces: Column) -> Callable[[Column], Column]:
        def one(span: Column) -> Column:
            first = F.greatest(span["start"] - _REACH, F.lit(0).cast("bigint"))
            before = _part(pieces, first, span["start"])
            # A word that reaches the first of many characters may have begun before it.
            before = F.when(first > 0, before).otherwise(F.concat(F.lit(" "), before))
            instance = F.lower(F.regexp_replace(span["hit"], r"[\x20()-]", ""))
            return context(F.regexp_extract(before, _BEFORE, 1), instance, span["start"], span["stop"], True)

        return one

    def of_token(span: Column) -> Column:
        stop = span["stop"] - F.length(F.regexp_extract(span["hit"], _INSTANCE, 2))
        instance = F.regexp_extract(span["hit"], _INSTANCE, 1)
        word = F.regexp_extract(span["hit"], f"^[{_LETTER}]+", 0)
        return context(word, instance, stop - F.length(instance), stop, False)

    def split(spans: Column) -> Column:
        seeds = _bound(_pieces(t), lambda pieces: F.transform(spans, of_base(pieces)))
        seeds = F.filter(seeds, lambda c: c["pattern"] != "")
        tokens = F.transform(matches(t, _CONTEXT), of_token)
        return F.when(F.size(spans) == 0, tokens).otherwise(F.concat(seeds, _apart(tokens, spans)))

    return _bound(base, split)


def _apart(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap none of ``spans``. Both are gone through by start, once forwards with the end of
    the spans so far, once backwards with the start of the next one."""
    kind = "struct<start: bigint, side: int, token: struct<pattern: string, instance: string, start: bigint, stop: bigint, seed: boolean>, stop: bigint>"
    row = lambda c, side, token: F.struct(c["start"].alias("start"), F.lit(side).alias("side"), token.alias("token"), c["stop"].alias("stop"))
    none = F.lit(None).cast("struct<pattern: string, instance: string, start: bigint, stop: bigint, seed: boolean>")
    mixed = F.concat(F.transform(spans, lambda s: row(s, 0, none)), F.transform(tokens, lambda c: row(c, 1, c)))
    empty = F.array().cast(f"array<{kind}>")

    def forwards(reach: Column, e: Column) -> tuple[Column, Column]:
        kept = (e["side"] == 0) | (reach <= e["start"])
        return F.when(e["side"] == 0, F.greatest(reach, e["stop"])).otherwise(reach), F.when(kept, F.array(e)).otherwise(empty)

    def backwards(following: Column, e: Column) -> tuple[Column, Column]:
        kept = (e["side"] == 1) & (e["stop"] <= following)
        return F.when(e["side"] == 0, e["start"]).otherwise(following), F.when(kept, F.array(e)).otherwise(empty)

    first = _folded(F.array_sort(mixed), F.lit(0).cast("bigint"), kind, forwards)["out"]
    left = _folded(F.reverse(first), F.lit(2**62).cast("bigint"), kind, backwards)["out"]
    return F.transform(F.reverse(left), lambda e: e["token"])


def _places(texts: DataFrame) -> DataFrame:
    """``pattern``, ``places``: how often each word stands in ``text``."""
    words = texts.select(F.explode(F.split("text", f"[^{_LETTER}]+")).alias("word"))
    return words.groupBy(F.lower("word").alias("pattern")).agg(F.count("*").alias("places"))


def _scan(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) with a number per row, base spans and contexts; written before use."""
    found = rows.withColumns({"row": F.monotonically_increasing_id(), **base_spans(F.col("text"))})
    return found.withColumn("contexts", _contexts(F.col("text"), F.concat(*KINDS)))


def score_patterns(occurrences: DataFrame, places: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern``, ``score``, ``support`` from ``pattern``, ``instance``, ``seed`` rows and places by pattern."""
    edges = occurrences.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = materialise(edges.join(places, "pattern"), "pii-graph")
    score = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("c"))
    for k in range(rounds):
        weighed = edges.join(score, "instance").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("c")).alias("good"), F.greatest(F.max("places"), F.sum("n")).alias("n"),
            F.count_if(F.col("c") >= LEAST_SCORE).alias("support"),
        )
        patterns = weighed.select("pattern", (F.col("good") / (F.col("n") + 2)).alias("score"), "support")
        patterns = materialise(patterns, f"pii-patterns-{k}")
        introduced = edges.join(patterns.select("pattern", "score"), "pattern").groupBy("instance").agg(
            F.max(F.col("seed").cast("double")).alias("seed"),
            (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("c"),
        )
        score = introduced.select("instance", F.greatest("seed", "c").alias("c"))
    return patterns


def _with_contextual(scanned: DataFrame, texts: DataFrame, least_score: float, least_support: int) -> DataFrame:
    occurrences = scanned.select("row", F.inline("contexts"))
    scored = score_patterns(occurrences, _places(texts))
    good = scored.filter((F.col("score") >= least_score) & (F.col("support") >= least_support))
    new = occurrences.filter(~F.col("seed")).join(good.select("pattern"), "pattern")
    span = F.struct("start", "stop", F.col("instance").alias("hit"))
    by_row = new.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias(CONTEXTUAL))
    joined = scanned.drop("contexts").join(by_row, "row", "left").drop("row")
    return joined.withColumn(CONTEXTUAL, F.coalesce(CONTEXTUAL, F.array().cast(_SPANS)))


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_score: float = LEAST_SCORE, least_support: int = LEAST_SUPPORT,
) -> DataFrame:
    """Per row ``doc_id``, the base spans by kind, and ``id`` (contextual spans)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _with_contextual(materialise(_scan(rows).drop("text"), "pii-spans"), rows, least_score, least_support)


def redact(
    docs: DataFrame, text_col: str = "text", least_score: float = LEAST_SCORE, least_support: int = LEAST_SUPPORT
) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans by one."""
    rows = docs.select(F.struct(*docs.columns).alias("kept"), F.col(text_col).alias("text"))
    scanned = materialise(_scan(rows), "pii-spans")
    found = _with_contextual(scanned, scanned, least_score, least_support)
    kinds = [*KINDS, CONTEXTUAL]
    named = [_with_kind(k) for k in kinds]
    none = F.array().cast("array<string>")

    def cleaned(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            mark = F.concat(F.lit("<"), s["kind"], F.lit(">"))
            more = F.when(s["start"] >= at, F.array(_part(pieces, at, s["start"]), mark)).otherwise(none)
            return F.greatest(at, s["stop"]), more

        done = _folded(F.sort_array(F.concat(*named)), F.lit(0).cast("bigint"), "string", step)
        rest = lambda d: F.concat(F.array_join(d["out"], ""), _part(pieces, d["carry"], F.length("text").cast("bigint")))
        return _bound(done, rest)

    spans = F.size(F.concat(*KINDS, CONTEXTUAL))
    clean = F.when(spans == 0, F.col("text")).otherwise(_bound(_pieces(F.col("text")), cleaned))
    return found.withColumn("clean", clean).select(
        *[(F.col("clean") if c == text_col else F.col("kept")[c]).alias(c) for c in docs.columns]
    )


def _with_kind(kind: str) -> Column:
    # A second parameter of the function would be the position, so the kind is bound here.
    return F.transform(
        F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))
    )


def listed(kinds: list[str]) -> Column:
    """``kind:start:stop`` of all spans, by kind, then start, joined by commas."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.concat_ws(",", F.transform(F.concat(*[_with_kind(k) for k in kinds]), text))
