"""The queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamkit.llm import bloom_cascade, chebyshev_whiten, decontaminate, exact_dedup, html_crf, partition_join, pfair_mix, quality_bayes, secret_scan, simhash_links, square_catchers, suffix_dedup, warc_audit


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the archive of all pages against a replica with planted damage: of ids that leave 13
    by 97 the payload's first character is replaced, ids that leave 7 by 101 are lost."""
    pages = _read(spark, sf_dir, "pages")
    mine = warc_audit.lay_out(pages)
    body = F.coalesce(F.col("html"), F.lit(""))
    hit = (F.col("page_id") % 97 == 13) & (F.length(body) > 0)
    damaged = pages.withColumn("html", F.when(hit, F.concat(F.lit("�"), F.substring(body, 2, 1 << 30))).otherwise(body))
    record = warc_audit.record_bytes(F.col("url"), F.col("html"))
    copy = damaged.select(F.col("page_id").alias("record_id"), F.sha2(record, 256).alias("now"))
    offsets = mine.select("archive", "offset", "length", "record_id", "digest")
    theirs = offsets.join(copy.where(F.col("record_id") % 101 != 7), "record_id").select("archive", "offset", "length", "record_id", F.col("now").alias("digest"))
    return warc_audit.audit(mine, theirs).select("archive", F.col("node").alias("range"), "offset", F.col("record_id").alias("page_id"), "status")


_OP1_SQL = """
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), b AS (
  SELECT page_id, html,
         'WARC/1.1 response ' || url || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM r
), o AS (
  SELECT page_id, html, page_id // 1024 AS archive,
         coalesce(sum(octet_length(encode(rec))) OVER (PARTITION BY page_id // 1024 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM b
)
SELECT archive, CAST(off // 65536 AS BIGINT) AS "range", CAST(off AS BIGINT) AS "offset", page_id,
       CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM o
WHERE page_id % 101 = 7 OR (page_id % 97 = 13 AND length(html) > 0)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring dedup leaves of every document."""
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents")).drop("cuts")


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.extract(_read(spark, sf_dir, "pages"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in the mix for every document, sources weighted by the roots of their sizes."""
    return pfair_mix.mix(_read(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document, with source as host and language as path."""
    return quality_bayes.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    return secret_scan.scan(_read(spark, sf_dir, "documents")).drop("base_spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, with distance and span."""
    return decontaminate.find_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page url."""
    return bloom_cascade.judge(_read(spark, sf_dir, "pages"))


_OP8_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), j AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u
), s AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM j
), h AS (
  SELECT host, count(*) FILTER (said = 'block') > count(*) FILTER (said = 'allow') AS host_listed FROM s GROUP BY host
)
SELECT page_id, s.host, path, rule, coalesce(said, CASE WHEN host_listed THEN 'block' ELSE 'allow' END) AS verdict, host_listed
FROM s JOIN h ON s.host = h.host
"""


def op9_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_links.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_links.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of every group of equal documents; digests of all rows are asked for."""
    return exact_dedup.report(_read(spark, sf_dir, "documents"), digest_all=True)


_OP10_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after a tail of words has been repeated in those whose id's
    checksum ends in 0."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    planted = docs.withColumns({"ws": words, "g": F.floor(F.col("h") / 10)}).withColumn("n", F.size("ws"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    planted = planted.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("ws", lambda w, i: F.get("ws", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    found = square_catchers.periodic_runs(planted.select("doc_id", F.coalesce(F.when(F.col("n") > 0, F.array_join(again, " ")), "text").alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return partition_join.similar_sets(_read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return chebyshev_whiten.whiten(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc_fixity, op2_suffix_dedup, op3_html_crf, op4_pfair_mix, op5_quality_bayes, op6_secret_scan, op7_decontaminate, op8_url_filter, op9_simhash_links, op10_exact_dedup, op11_periodic_runs, op12_jaccard_join, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": _OP1_SQL, "op8_url_filter": _OP8_SQL, "op10_exact_dedup": _OP10_SQL}
