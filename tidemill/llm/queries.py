"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, language_id, lm_score, media, ngram_join, pii, quality, substring_dedup, url_filter
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(decontam.scan(docs, table(spark, sf_dir, "benchmark")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out()
    dictionaries = language_id.sample(docs.filter(~held), "text", "lang")
    said = language_id.classify(docs.select("doc_id", "text"), dictionaries)
    return said.select("doc_id", held.alias("held_out"), "lang_pred", "score", "reliable")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(media.to_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "lang", "n_symbols", "log_perplexity", "threshold", "keep")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_filter.label_outcomes(table(spark, sf_dir, "labels"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.report(substring_dedup.remove_repeats(docs))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, tokenizer_path()))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4_media: the stored payloads as they are read back."""
    return op4_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9_pii: how many base spans there are."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10_lm_score: all but the model's own score."""
    base = F.round("base_score", 3).alias("base_score")
    return op10_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base)


#: CRC-32 of a string of ASCII characters or of a list of bytes, bit by bit.
CRC32 = "xor(list_reduce({bytes}, lambda a, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295)"
ASCII = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"

MEDIA_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, b || unhex(repeat('FF', CAST(greatest(576, 576 * ceil(octet_length(b) / 576)) - octet_length(b) AS BIGINT))) AS p FROM d),
h AS (SELECT *, right(hex(p), 64) AS t FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(octet_length(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_sha256,
{CRC32.format(bytes="list_transform(range(0, 32), lambda i: CAST('0x' || t[2 * i + 1:2 * i + 2] AS BIGINT))")} AS tail_crc32 FROM h
"""

PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS i,
list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM d)
SELECT doc_id, len(e) AS n_email, len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR CAST('0' || right(ltrim(y, '0'), 3) AS INTEGER) > 255)) = 0)) AS n_ip,
len(list_filter(c, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(x)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(x[length(x) - k] AS INTEGER) ELSE CAST(x[length(x) - k] AS INTEGER) * 2 - CASE WHEN CAST(x[length(x) - k] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
len(list_filter(p, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone FROM m
"""

LM_SQL = rf"""
WITH d AS (SELECT doc_id, {CRC32.format(bytes=ASCII)} % 7 = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' '] AS w FROM documents),
k AS (SELECT doc_id, held_out, unnest(w) AS w FROM d), c AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base FROM k LEFT JOIN c USING (w), n GROUP BY doc_id)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 3) AS base_score FROM d JOIN s USING (doc_id), n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_decontaminate, op3_language_id, op4_media, op5_quality, op6_url_filter, op7_substring_dedup, op8_bpe, op9_pii, op10_lm_score, media_payloads, pii_counts, lm_base_scores)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE,
        "op2_decontaminate": decontam.ORACLE,
        "op6_url_filter": url_filter.oracle(),
        "op7_substring_dedup": substring_dedup.ORACLE,
        "media_payloads": MEDIA_SQL,
        "pii_counts": PII_SQL,
        "lm_base_scores": LM_SQL,
    }
