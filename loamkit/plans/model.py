"""The knowledge model derived from the given tables, in Spark and in DuckDB SQL.

Each function has a SQL twin in ``SQL``; queries and their oracles build on the two."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamkit.operators.term_index import CONFIGS, stop_words
from loamkit.schemas import CATEGORIES, SOURCES

AS_OF = "2024-01-01 12:00:00"
THRESHOLD, AUTO = 70, 90


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; a local one where none is set and the master is
    local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamkit-")
    return f"{base.rstrip('/')}/loamkit-{uuid.uuid4().hex}"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge entries; labels decide their status."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved")
        .when(F.col("quality").isNotNull(), "rejected")
        .when(F.col("doc_id") % 17 == 0, "classifying")
        .otherwise("pending")
    )
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("content"),
        pick(CATEGORIES, F.col("doc_id")).alias("category"),
        pick(SOURCES, F.col("doc_id")).alias("source"),
        status.alias("status"),
        "lang",
        "n_chars",
        (F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60)).alias("updated_at"),
    )


def owners(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """(entry, chunk index) of a vector: two vectors an entry, over all entries, and again."""
    n = table(spark, sf_dir, "documents").count()
    v = F.col("vec_id")
    return F.floor(v / 2) % max(n, 1), (v % 2 + 2 * F.floor(v / (2 * max(n, 1)))).cast("int")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the chunks of the entries."""
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("project_id"))
    entry, index = owners(spark, sf_dir)
    return table(spark, sf_dir, "embeddings").select(entry.alias("entry_id"), index.alias("chunk_index"), "embedding").join(e, "entry_id")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query, numbered in order."""
    v = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0)
    return v.select(F.floor(F.col("vec_id") / 100).alias("query_id"), "embedding")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: their first three words of five letters or more, by
    definition, of those that are no stop words."""
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: (F.length(w) >= 5) & ~w.isin(*stop_words("english")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(F.array_distinct(words), 1, 3).alias("terms")).where(F.size("terms") > 0)


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, key): documents that hold the whole passage of a query.

    Documents meet a passage by an equi-join on its second, third and fourth words; texts are
    compared for those pairs alone."""
    at = lambda words, i: F.concat_ws(" ", *[F.try_element_at(words, F.lit(j)) for j in range(i, i + 3)])
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), at(F.split("text", " "), 2).alias("probe"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    words = F.split("text", " ")
    grams = F.zip_with(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y)), F.slice(words, 3, F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))
    probes = d.select("key", F.explode(F.array_distinct(grams)).alias("probe"))
    pairs = probes.join(b.select("query_id", "probe"), "probe").select("query_id", "key")
    return pairs.join(d, "key").join(b, "query_id").where(F.col("text").contains(F.col("passage"))).select("query_id", "key").distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts; ids end in a digit for the kind."""
    kinds = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    out = None
    for i, (kind, key, name) in enumerate(kinds):
        rows = table(spark, sf_dir, kind).select((F.col(key).cast("long") * 10 + i).alias("id"), F.lit("tpch").alias("project_id"), F.col(name).alias("name"), F.lit(kind).alias("type"))
        out = rows if out is None else out.unionByName(rows)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer in nation, supplier in nation, nation in region, part supplied_by supplier."""

    def edge(rows: DataFrame, subject: str, s: int, predicate: str, target: str, o: int) -> DataFrame:
        return rows.select((F.col(subject).cast("long") * 10 + s).alias("subject_id"), F.lit(predicate).alias("predicate"), (F.col(target).cast("long") * 10 + o).alias("object_id"))

    out = edge(table(spark, sf_dir, "customer"), "c_custkey", 2, "in", "c_nationkey", 1)
    out = out.unionByName(edge(table(spark, sf_dir, "supplier"), "s_suppkey", 3, "in", "s_nationkey", 1))
    out = out.unionByName(edge(table(spark, sf_dir, "nation"), "n_nationkey", 1, "in", "n_regionkey", 0))
    out = out.unionByName(edge(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", 4, "supplied_by", "l_suppkey", 3))
    return out.withColumn("id", F.xxhash64("subject_id", "predicate", "object_id"))


def entry_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("entry_id"), (F.col("doc_id") % 25 * 10 + 1).alias("entity_id")).union(d.select("doc_id", (F.col("doc_id") % 10 * 10 + 3)))


def entry_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, project_id, name): language and length band."""
    d = table(spark, sf_dir, "documents")
    band = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return d.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("project_id"), F.explode(F.array(F.col("lang"), band)).alias("name"))


RULE_SETS = "CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 2 THEN array() WHEN id % 4 = 1 THEN array(6, -8) ELSE array(6) END"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a shadow decision; flags are absent for ids that 11 divides."""
    score = (F.col("id") * 37 % 101).cast("int")
    out = entries(spark, sf_dir).select("id", "project_id", "status", F.lit("shadow").alias("mode"), score.alias("final_score"))
    verdict = F.when(F.col("final_score") >= THRESHOLD, "important").otherwise("not_important")
    present = F.col("id") % 11 != 0
    rules = F.transform(F.expr(RULE_SETS), lambda a: F.struct(F.when(a > 0, "explicit_decision").otherwise("speculative_language").alias("id"), a.alias("adjustment"), F.lit("why").alias("reason")))
    return out.withColumns({"verdict": verdict, "rules": rules}).withColumns(
        {"would_reject": F.when(present, F.col("verdict") == "not_important"), "would_approve": F.when(present, F.col("final_score") >= AUTO), "auto_approved": F.when(F.col("id") % 13 != 1, F.col("id") % 13 == 0)}
    )


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def docterms_sql(language: str, rows: str = "documents") -> str:
    """(entry_id, ws): the terms of title, content and tags of ``rows``, whose project has ``language``."""
    stops = ", ".join(f"('{c}', {_listed(stop_words(c))})" for c in CONFIGS)
    return rf"""docterms AS (
  SELECT doc_id AS entry_id, list_filter(string_split_regex(lower(left(split_part(text, chr(10), 1), 80) || ' ' || text || ' ' || tags), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains(stops, w)) AS ws
  FROM (SELECT doc_id, text, {language} AS language, array_to_string(list_sort(list_distinct([lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END])), ' ') AS tags FROM {rows})
  JOIN (VALUES {stops}) s(config, stops) ON config = CASE WHEN regexp_matches(lower(language), '^pt(-|$)') THEN 'portuguese' WHEN regexp_matches(lower(language), '^es(-|$)') THEN 'spanish' ELSE 'english' END),
postings AS (SELECT entry_id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT entry_id, unnest(ws) AS term, len(ws) AS n FROM docterms) GROUP BY entry_id, term)"""


_CAT = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_SRC = "[" + ", ".join(f"'{c}'" for c in SOURCES) + "]"
SQL = {
    "entries": f"""entries AS (
  SELECT d.doc_id AS id, d.source AS project_id, left(split_part(d.text, chr(10), 1), 80) AS title, d.text AS content,
         {_CAT}[d.doc_id % 7 + 1] AS category, {_SRC}[d.doc_id % 5 + 1] AS source,
         CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN quality IS NOT NULL THEN 'rejected' WHEN d.doc_id % 17 = 0 THEN 'classifying' ELSE 'pending' END AS status,
         d.lang, d.n_chars, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS updated_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "chunks": """chunks AS (
  SELECT e.entry_id, e.chunk_index, e.embedding, d.source AS project_id, e.vec_id
  FROM (SELECT vec_id, vec_id // 2 % n AS entry_id, CAST(vec_id % 2 + 2 * (vec_id // (2 * n)) AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS embedding
        FROM embeddings, (SELECT count(*) AS n FROM documents)) e JOIN documents d ON d.doc_id = e.entry_id)""",
    "vq": "vq AS (SELECT vec_id // 100 AS query_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id % 100 = 0)",
    "tq": rf"""tq AS (
  SELECT item_id AS query_id, unnest(ts) AS term, len(ts) AS n_terms FROM (
    SELECT item_id, list_slice(list_filter(ws, lambda w, i: list_position(ws, w) = i), 1, 3) AS ts
    FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 5 AND NOT list_contains({_listed(stop_words("english"))}, w)) AS ws FROM benchmark)))""",
    "postings": """langs AS (SELECT source, arg_max(lang, (c, lang)) AS project_language FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source),
"""
    + docterms_sql("project_language", "(documents JOIN langs USING (source))"),
    "entities": """entities AS (
  SELECT CAST(r_regionkey AS BIGINT) * 10 AS id, 'tpch' AS project_id, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 1, 'tpch', n_name, 'nation' FROM nation
  UNION ALL SELECT CAST(c_custkey AS BIGINT) * 10 + 2, 'tpch', c_name, 'customer' FROM customer
  UNION ALL SELECT CAST(s_suppkey AS BIGINT) * 10 + 3, 'tpch', s_name, 'supplier' FROM supplier
  UNION ALL SELECT CAST(p_partkey AS BIGINT) * 10 + 4, 'tpch', p_name, 'part' FROM part)""",
    "relations": """relations AS (
  SELECT CAST(c_custkey AS BIGINT) * 10 + 2 AS subject_id, 'in' AS predicate, CAST(c_nationkey AS BIGINT) * 10 + 1 AS object_id FROM customer
  UNION ALL SELECT CAST(s_suppkey AS BIGINT) * 10 + 3, 'in', CAST(s_nationkey AS BIGINT) * 10 + 1 FROM supplier
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 1, 'in', CAST(n_regionkey AS BIGINT) * 10 FROM nation
  UNION ALL SELECT DISTINCT CAST(l_partkey AS BIGINT) * 10 + 4, 'supplied_by', CAST(l_suppkey AS BIGINT) * 10 + 3 FROM lineitem)""",
    "entry_entities": """entry_entities AS (
  SELECT doc_id AS entry_id, doc_id % 25 * 10 + 1 AS entity_id FROM documents UNION ALL SELECT doc_id, doc_id % 10 * 10 + 3 FROM documents)""",
    "entry_tags": """entry_tags AS (
  SELECT doc_id AS entry_id, source AS project_id, unnest([lang, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END]) AS name FROM documents)""",
    "decisions": f"""decisions AS (
  SELECT id, project_id, status, 'shadow' AS mode, CAST(id * 37 % 101 AS INTEGER) AS final_score,
         CASE WHEN id * 37 % 101 >= {THRESHOLD} THEN 'important' ELSE 'not_important' END AS verdict,
         CASE WHEN id % 11 <> 0 THEN id * 37 % 101 < {THRESHOLD} END AS would_reject,
         CASE WHEN id % 11 <> 0 THEN id * 37 % 101 >= {AUTO} END AS would_approve,
         CASE WHEN id % 13 <> 1 THEN id % 13 = 0 END AS auto_approved,
         CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 2 THEN CAST([] AS INTEGER[]) WHEN id % 4 = 1 THEN [6, -8] ELSE [6] END AS adjustments
  FROM entries)""",
}


def with_sql(names: str, body: str) -> str:
    """A statement over the named model tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
