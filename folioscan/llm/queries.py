"""The operators of this subpackage as queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import dedup_exact, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, tokens, url_filter, warc
from folioscan.llm.common import dealt_join


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad, n) of pages. A page shows the document whose number ends its path; it is bad if that is of low quality or toxic.

    Pages are counted by host and document first; those that show none are never joined.
    """
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    shown = pages.select(host.alias("host"), F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long").alias("doc_id"))
    shown = shown.groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    outcome = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    some = dealt_join(shown.where("doc_id IS NOT NULL"), outcome, ["doc_id"], ["host"], "left").select("host", "bad", "n")
    return some.unionByName(shown.where("doc_id IS NULL").select("host", F.lit(None).cast("int").alias("bad"), "n"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "page_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").drop("target_uri")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, unhex(sha1(h))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to,
 list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), 'string_agg', '') AS payload_digest
FROM b"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(license_scan.sample(docs))).withColumnRenamed("id", "doc_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_exact.decide(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("copies").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP10_SQL = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {mixing.BIN_DIGITS}))::BIGINT AS bin FROM documents),
bins AS (SELECT source, bin, sum(size)::BIGINT AS bin_size FROM sized GROUP BY ALL),
s AS (SELECT source, sum(bin_size)::BIGINT AS source_size FROM bins GROUP BY ALL),
w AS (SELECT *, source_size * {mixing.MAX_EPOCHS} AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER q, 0) AS cap_before, coalesce(sum(weight) OVER q, 0) AS weight_before, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_size - cap_before)::BIGINT / (all_weight - weight_before)::BIGINT AS level FROM b),
f AS (SELECT arg_min(level, weight_before) AS final FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE ELSE least((SELECT final FROM f) * weight, cap::DOUBLE) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT source, coalesce(min(bin) FILTER (before + bin_size / 2 > rest), 1099511627776) AS cut FROM (
  SELECT source, bin, bin_size, target - whole * source_size AS rest,
   coalesce(sum(bin_size) OVER (PARTITION BY source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT bins.*, whole, target, source_size FROM bins JOIN p ON bins.source IS NOT DISTINCT FROM p.source)) GROUP BY source)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (whole + (bin < cut)::BIGINT) * size ELSE 0 END::BIGINT AS taken
FROM sized JOIN p ON sized.source IS NOT DISTINCT FROM p.source JOIN c ON sized.source IS NOT DISTINCT FROM c.source"""

QUERIES = {"op1_packing": op1_packing, "op2_url_filter": op2_url_filter, "op3_warc": op3_warc, "op4_token_counts": op4_token_counts, "op5_license_scan": op5_license_scan, "op6_near_dedup": op6_near_dedup, "op7_quality_rules": op7_quality_rules, "op8_quality_classifier": op8_quality_classifier, "op9_exact_dedup": op9_exact_dedup, "op10_source_mix": op10_source_mix}
ORACLES = {"op3_warc": OP3_SQL, "op9_exact_dedup": OP9_SQL, "op10_source_mix": OP10_SQL}
