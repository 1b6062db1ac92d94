"""License scan, URL filter, PII, decontamination and language identification."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from clickweave.llm import decontamination, language_id, license_scan, pii, queries, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}


PII_TEXTS = [
    "write to a.b+c@mail.example.org or x@y.z+d@e.f.",
    "é😀 me@host.com, 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 007.1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111",
    "call +1 (555) 010-9999 or +49.30.1234567 or +1 2 or +123456789012345678",
    "@@ a@b a@b. a@-.- " + "a@" + "b." * 3000 + "c",
    "1" * 3000 + " " + "+1" + " " * 3000,
    "a" * 30_000,
]


def test_base_spans_against_brute_force(spark, docs_of, odd_docs, no_docs, sample_docs):
    docs = docs_of(list(enumerate(PII_TEXTS))).unionByName(odd_docs).unionByName(sample_docs)
    got = pii.find(docs.withColumn("row", F.lit(1)).withColumn("email", F.lit("x"))).collect()
    spans = lambda r: {k: [(s.start, s.stop) for s in r[k]] for k in pii.KINDS}
    key = lambda d: repr(sorted(d.items()))
    expected = sorted(key(brute_spans(r.text)) for r in docs.collect())
    assert sorted(key(spans(r)) for r in got) == expected
    assert pii.find(no_docs).collect() == []


def test_contextual_spans_and_redaction(docs_of):
    rows = [(i, f"Some words. account: 10.0.0.{i} and the rest") for i in range(30)]
    rows += [(100 + i, f"More words here. account: ZX-{i}77Q and page {i}9 follows") for i in range(5)]
    docs = docs_of(rows + [(None, None), (500, "")])
    found = {r.doc_id: [s.hit for s in r.id] for r in pii.find(docs).collect()}
    assert found[101] == ["ZX-177Q"] and found[3] == []
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[3] == "Some words. account: <ip> and the rest"
    assert clean[101] == "More words here. account: <id> and page 19 follows"
    assert clean[None] is None and clean[500] == ""
    assert pii.redact(docs).columns == docs.columns


def test_no_python_in_native_plans(spark):
    for name in ("op4_url_filter", "op5_pii"):
        plan = queries.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_url_filter_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    expected = con.execute(queries.all_oracles()["op4_url_filter"]).fetchall()
    got = [tuple(r) for r in queries.op4_url_filter(spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_url_filter_cases(spark):
    urls = {
        "http://EXAMPLE.org/es/": ("example.org/es/", "block"),
        "http://a.b.example.org/en/12?x": ("example.org/en/1", "block"),
        "http://notexample.org/es/1": ("org/", "allow"),
        "http://x.com/FR/": (None, "allow"),
        "http://x.com/de/1#y": ("com/de/", "block"),
        "http://com/fr/": ("com/fr/", "allow"),
        "https://m.ads-track.example.net/en/1": (None, "block"),
        "http://org": (None, "allow"),
        "no scheme.org/es/": (None, "allow"),
        "": (None, "allow"),
        None: (None, "allow"),
        "http://x.net/a?u=http://example.org/es/": (None, "allow"),
    }
    rows = [(i, u, "kept") for i, u in enumerate([*urls, *urls])]
    pages = spark.createDataFrame(rows, "page_id long, url string, t string")
    got = url_filter.judge(pages, url_filter.standard_rules(spark)).collect()
    assert len(got) == 2 * len(urls) and {r.t for r in got} == {"kept"}
    assert {r.url: (r.rule, r.verdict) for r in got} == urls
    empty = url_filter.judge(pages.limit(0), url_filter.standard_rules(spark))
    assert empty.collect() == []
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, [(0, 1, ".", [], ".", "block")])


def brute_licenses(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_base_licenses_against_brute_force(odd_docs, no_docs, docs_of, sample_docs):
    rng = random.Random(3)
    vocabulary = "gnu general public license apache cc by mit the 2.0 under Ünïcode".split()
    noise = docs_of([(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(100)])
    docs = noise.unionByName(odd_docs).unionByName(sample_docs)
    rows = docs.select("text", license_scan.licenses(F.col("text")).alias("f")).collect()
    for r in rows:
        assert (r.f.n_words, r.f.n_base, r.f.first_word, r.f.last_word, r.f.base_labels) == brute_licenses(r.text)
        assert set(r.f.base_labels) <= set(r.f.labels) and 0 <= r.f.score <= 1
    assert no_docs.select(license_scan.licenses(F.col("text"))).collect() == []


def test_matching_statistics_are_longest_runs():
    scanner = license_scan.Scanner({"a": "x y z x y w", "b": "y z q"}, {"z x": "p"})
    texts = [t.encode().split() for t in ("x y z x y w", "y z q", "z x")]
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.choice([b"x", b"y", b"z", b"w", b"q", b"other"]) for _ in range(30)]
        for end, _, n in scanner.statistics(words):
            run = max(
                k for k in range(end + 1)
                if any(words[end - k : end] == t[i : i + k] for t in texts for i in range(len(t) - k + 1))
            )
            assert n == run


def test_template_spans(docs_of):
    text = "Before it. " + license_scan.TEMPLATES["mit"].replace("free of charge", "free of any charge") + " after"
    found = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES).scan(text.encode())
    assert found["labels"] == ["mit"] and found["score"] > 0.9
    span = next(s for s in found["spans"] if s["label"] == "mit")
    assert span["start"] <= 3 and span["stop"] >= found["n_words"] - 3


def brute_contamination(text, items, length=13):
    words = WORD.findall(lowered(text))
    hit, ids = set(), set()
    for item, t in items:
        w = WORD.findall(lowered(t))
        n = min(length, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("block_words", [4_000_000, 20])
def test_contamination_against_brute_force(spark, docs_of, odd_docs, no_docs, sample_docs, block_words):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 12, 13, 14, 40, 90])]
    items += [(7, items[8][1]), (100, None), (101, " ... "), (102, "word " * 60)]
    bench = spark.createDataFrame(items, "item_id long, text string").unionByName(
        spark.read.parquet(f"{SF}/benchmark.parquet")
    )
    texts = [" ".join([rng.choice("abcdefgh") for _ in range(9)] + [items[k][1]] + ["tail"]) for k in range(9)]
    docs = docs_of(list(enumerate(texts))).unionByName(odd_docs).unionByName(sample_docs)
    blocks = decontamination.benchmark_blocks(bench, block_words=block_words)
    assert (len(blocks) > 1) == (block_words == 20)
    rows = docs.select("text", decontamination.contamination(F.col("text"), blocks).alias("f")).withColumn(
        "n_hit", decontamination.n_hit(F.col("f"))
    )
    known = [(r.item_id, r.text) for r in bench.collect()]
    for r in rows.collect():
        assert (r.f.n_words, r.n_hit, r.f["items"]) == brute_contamination(r.text, known)
    no_bench = decontamination.benchmark_blocks(bench.limit(0))
    assert decontamination.drop_contaminated(no_docs, bench).collect() == [] and no_bench == []
    assert decontamination.drop_contaminated(sample_docs, bench.limit(0)).count() == sample_docs.count()


def test_language_accuracy_on_held_out_rows(spark, sample_docs):
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    held = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    assert rows.filter("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_language_of_odd_rows(spark, odd_docs, no_docs, sample_docs):
    model = language_id.fit(sample_docs)
    found = odd_docs.select("text", language_id.predict(F.col("text"), model).alias("f")).collect()
    assert {r.f.lang for r in found if not (r.text or "").strip()} == {"und"}
    assert all(r.f.lang != "und" for r in found if (r.text or "").strip())
    nothing = language_id.fit(no_docs)
    assert {r.f.lang for r in odd_docs.select(language_id.predict(F.col("text"), nothing).alias("f")).collect()} == {"und"}
    one = language_id.fit(sample_docs.filter("lang = 'de'"))
    assert one.predict(b"irgendein Text") == ("de", pytest.approx(1.0))


def test_pii_query_against_brute_force(spark, sample_docs):
    texts = {r.doc_id: r.text for r in sample_docs.collect()}
    for r in queries.op5_pii(spark, SF).collect():
        spans = brute_spans(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("id:")] == listed
