"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.llm import alignment, decontamination, language_id, license_scan, packing, phrases, pii, sharding, simhash_dedup, substring_dedup, token_store, url_filter, vector_dedup
from clickweave.llm.common import table
from clickweave.session import scratch_dir

#: Tokenizer files stay where they are installed; the operators take any path.
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("found", license_scan.licenses(F.col("text"))).select(
        "doc_id",
        *[F.col(f"found.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")],
        *[F.array_join(f"found.{c}", ",").alias(c) for c in ("base_labels", "labels")],
        F.col("found.score").alias("score"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.standard_rules(spark)).drop("url")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(pii.KINDS), 256).alias("base_sha256"),
        pii.listed([*pii.KINDS, pii.CONTEXTUAL]).alias("spans"),
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontamination.benchmark_blocks(table(spark, sf_dir, "benchmark"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("found")
    return docs.withColumn("found", decontamination.contamination(F.col("text"), blocks)).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        decontamination.n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", found["items"]), 256).alias("items_sha256"),
        decontamination.is_contaminated(found).alias("contaminated"),
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "tokens")
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(), end_id=0)
    return token_store.document_starts(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, length=1024)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_duplicates(
        table(spark, sf_dir, "documents"), window=35, digest=True, row_key=substring_dedup.stored_row_key()
    )
    return rows.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~held_out))
    return docs.withColumn("found", language_id.predict(F.col("text"), model)).select(
        "doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, first=2_000)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32")
    )
    return sharding.shuffle_to_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def all_queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op4_url_filter": op4_url_filter,
        "op5_pii": op5_pii,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_token_output": op3_token_output,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_language_id": op8_language_id,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_sharding": op13_sharding,
    }


# Hosts, paths, rules and verdicts as plain SQL; the pattern rules are those of url_filter.
URL_FILTER_SQL = """
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)', 2, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(.*?)://[^/?#]*([^?#]*)', 2, 's') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule
  FROM cut
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(url, '://([^/?#]*[.-])?(ads|doubleclick|casino|porn)[.-]')
      OR regexp_matches(url, '/[^?#]*[.](exe|zip)([?#]|$)') OR regexp_matches(url, '/login([/?#]|$)') THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM ruled
"""


# Phrases by listing every n-gram of every piece.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
    FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m)
), f AS (
  SELECT lang, m, g, count(*) AS c FROM grams GROUP BY lang, m, g
), totals AS (
  SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, g, c AS a, string_split(g, ' ') AS ws FROM f WHERE m > 1 AND c >= 100
), inside AS (
  SELECT lang, array_to_string(ws[i:i + p - 1], ' ') AS g, max(a) AS longer
  FROM (SELECT lang, ws, a, p, unnest(range(1, m - p + 2)) AS i
    FROM candidates, (SELECT unnest(range(2, 5)) AS p) WHERE p < m)
  GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.g, c.a, k, l.c AS l, r.c AS r, n,
    (CAST(a AS HUGEINT) * n * 1000) // (CAST(l.c AS HUGEINT) * r.c) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.m = k AND l.g = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.m = c.m - k AND r.g = array_to_string(ws[k + 1:c.m], ' ')
  LEFT JOIN inside x ON x.lang = c.lang AND x.g = c.g
  WHERE x.longer IS NULL OR 100 * x.longer < 100 * c.a
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM lowest
)
SELECT lang, rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def all_oracles() -> dict[str, str]:
    return {"op4_url_filter": URL_FILTER_SQL, "op12_phrase_collocations": COLLOCATIONS_SQL}
