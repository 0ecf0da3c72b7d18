"""The queries of the ten operators over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe_codec, decontaminate, license_scan, lm_score, near_dedup, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity
from weftline.llm.common import table

#: The names of the vocabulary files; their folder is that of the package public_tokenizers.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), with_ids=False)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_bpe_codec": op2_bpe_codec,
        "op3_near_dedup": op3_near_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_quality_rules": op5_quality_rules,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_license_scan": op8_license_scan,
        "op9_lm_score": op9_lm_score,
        "op10_decontamination": op10_decontamination,
    }


def _rules_sql() -> str:
    """The threshold table as SQL."""
    parts = []
    for r in quality_rules.RULES:
        parts += [f"{r.over} >= {r.low}::DOUBLE * {r.of}"] if r.low is not None else []
        parts += [f"{r.over} <= {r.high}::DOUBLE * {r.of}"] if r.high is not None else []
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
OP5 = f"""
WITH w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
           FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
g AS (SELECT doc_id, list(i) AS spots FROM (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM p) GROUP BY doc_id, s HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(spots) AS i FROM g), (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP}))) AS n_stop_words, len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_shouts,
             len(list_filter(lines, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS n_ellipsis_lines, len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet_lines
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept FROM f"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP10 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
l AS (SELECT DISTINCT n FROM s),
p AS (SELECT doc_id, l.n, i, array_to_string(w[i:i + l.n - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), l WHERE i + l.n - 1 <= len(w)),
h AS (SELECT doc_id, p.n, i, item FROM p JOIN s USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express and run over whole tables; the others are tested against plain versions."""
    return {"op5_quality_rules": OP5, "op10_decontamination": OP10}
