"""Ingestion: chunking and indexing, imports, condensing transcripts, storing entries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamkit.functions import text as tx
from loamkit.functions.replies import candidates as parse_candidates
from loamkit.functions.rules import ingestion_status
from loamkit.operators.classify import release_all
from loamkit.operators.filters import indexable
from loamkit.operators.graph import find_or_create_entities, find_or_create_tags
from loamkit.operators.search import near_duplicates
from loamkit.schemas import Settings
from loamkit.sources.legacy import with_ids
from loamkit.sources.tables import purge_chunks, replace_chunks


def chunk(entries: DataFrame, max_bytes: int = 0) -> DataFrame:
    """OP-6: (entry_id, project_id, chunk_index, content)."""
    return entries.select(F.col("id").alias("entry_id"), "project_id", F.explode(tx.chunks(F.col("content"), max_bytes)).alias("c")).select("entry_id", "project_id", "c.chunk_index", "c.content")


def unmoved(entries: DataFrame, current: DataFrame) -> DataFrame:
    """ST-6: the rows of ``entries`` that are to be indexed and whose content, project and status are the
    same in ``current``, the entries as they are by now; a missing project or content is the same as a
    missing one."""
    now = current.where(indexable(F.col("status"))).select(F.col("id").alias("_id"), F.col("project_id").alias("_p"), F.sha2("content", 256).alias("_h"))
    same = (F.col("id") == F.col("_id")) & F.col("project_id").eqNullSafe(F.col("_p")) & F.sha2("content", 256).eqNullSafe(F.col("_h"))
    return entries.where(indexable(F.col("status"))).join(now, same, "left_semi")


def index(entries: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], current: DataFrame | None = None, max_bytes: int = 0) -> DataFrame:
    """OP-7: chunks with those of ``entries`` made anew.

    With ``current``, the entries as they are when the vectors are ready, results of entries whose
    content, project or status has moved on are thrown away (ST-6)."""
    due = entries.where(indexable(F.col("status"))) if current is None else unmoved(entries, current)
    fresh = chunk(due, max_bytes).withColumn("embedding", embed(F.col("content")))
    return replace_chunks(chunks, due, fresh)


def reindex(entries: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], project: str | None = None) -> DataFrame:
    """SNK-4: the project's chunks, or all, made anew for approved entries only."""
    chosen = entries if project is None else entries.where(F.col("project_id") == project)
    kept = chunks.limit(0) if project is None else chunks.where(F.col("project_id") != project)
    fresh = chunk(chosen.where("status = 'approved'")).withColumn("embedding", embed(F.col("content")))
    return kept.unionByName(fresh, allowMissingColumns=True)


def after_review(entries: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], max_bytes: int = 0) -> DataFrame:
    """OP-16: chunks once reviewed entries have their new status: those of rejected entries are
    purged, and approved entries that have none are indexed."""
    kept = purge_chunks(chunks, entries)
    due = entries.where("status = 'approved'").join(kept.select(F.col("entry_id").alias("id")), "id", "left_anti")
    return index(due, kept, embed, max_bytes=max_bytes)


def demote_stranded(entries: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], max_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """SC-8: (entries, chunks) once every entry that is still being classified has become pending; each
    of those is indexed anew, none is lost."""
    after = release_all(entries)
    due = after.join(entries.where("status = 'classifying'").select("id"), "id", "left_semi")
    return after, index(due, chunks, embed, max_bytes=max_bytes)


def import_documents(documents: DataFrame, project: str, category: str = "documentation", tags: tuple[str, ...] = ()) -> DataFrame:
    """OP-8: one entry per markdown section or text file, with the tags; pending, never classified."""
    name = F.regexp_extract("path", "([^/]*)\\z", 1)
    whole = F.array(F.struct(name.alias("title"), F.col("content").alias("content")))
    parts = F.when(F.col("extension") == "md", tx.sections(F.col("content"))).otherwise(whole)
    rows = documents.select("path", F.posexplode(parts).alias("section", "s"))
    return rows.select("path", "section", F.lit(project).alias("project_id"), F.col("s.title").alias("title"), F.col("s.content").alias("content"), F.lit(category).alias("category"), F.lit("import").alias("source"), F.lit("pending").alias("status"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"))


def condense(transcripts: DataFrame, extract: Callable[[Column], Column], embed: Callable[[Column], Column], chunks: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """OP-9: (candidates that are no duplicates, runs).

    ``transcripts`` has (session_id, project_id, transcript); ``extract`` gives a model's raw
    reply. A run is failed without a reply, done if it made an entry, else skipped."""
    heard = transcripts.withColumn("_reply", extract(F.col("transcript")))
    said = heard.select("session_id", "project_id", F.posexplode(parse_candidates(F.col("_reply"))).alias("n", "c"))
    found = said.select(F.concat_ws("#", "session_id", "n").alias("query_id"), "session_id", "project_id", "c.*")
    vectors = found.select("query_id", "project_id", embed(F.concat_ws("\n", "title", "content")).alias("embedding"))
    fresh = near_duplicates(vectors, chunks, settings.dedup_score).where("NOT duplicate").select("query_id")
    kept = found.join(fresh, "query_id").withColumns({"source": F.lit("condense"), "status": ingestion_status(F.lit("condense"), settings.mode)})
    counts = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries_created"))
    runs = heard.select("session_id", "project_id", F.col("_reply").isNull().alias("_none")).join(counts, "session_id", "left").withColumn("entries_created", F.coalesce("entries_created", F.lit(0)))
    return kept, runs.withColumn("status", F.when(F.col("_none"), "failed").when(F.col("entries_created") > 0, "done").otherwise("skipped")).drop("_none")


def store_entries(candidates: DataFrame, kb: dict[str, DataFrame], mode: str, fixed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, DataFrame]:
    """SNK-1: the rows that candidates add to entries, tags, entry_tags, entities, entry_entities
    and relations. Candidates have project_id, title, content, category, source, tags, entities and
    relations. ``fixed`` writes rows and reads them again, so that ids, once given, are the same in all
    six; ``commit_entries`` writes them so that they appear together."""
    body = ["project_id", "title", "content", "category", "source"]
    rows = fixed(with_ids(candidates.withColumn("status", ingestion_status(F.col("source"), mode)), kb["entries"], body))
    tagged = rows.select("id", "project_id", F.explode("tags").alias("name")).where("name <> ''").distinct()
    tags = fixed(find_or_create_tags(tagged, kb["tags"]))
    ends = F.flatten(F.transform("relations", lambda r: F.array(F.struct(r["subject"].alias("name"), F.lit("").alias("type")), F.struct(r["object"].alias("name"), F.lit("").alias("type")))))
    own = rows.select("id", "project_id", F.explode("entities").alias("e")).select("id", "project_id", "e.name", F.coalesce("e.type", F.lit("")).alias("type")).where("name <> ''")
    far = rows.select("project_id", F.explode(ends).alias("e")).select("project_id", "e.name", "e.type")
    entities = fixed(find_or_create_entities(own.select("project_id", "name", "type").unionByName(far), kb["entities"]))
    by_name = entities.where("type = ''").select("project_id", "name", F.col("id").alias("entity_id"))
    said = rows.select(F.col("id").alias("entry_id"), "project_id", F.explode("relations").alias("r")).select("entry_id", "project_id", "r.*")
    triples = said.join(by_name.withColumnsRenamed({"name": "subject", "entity_id": "subject_id"}), ["project_id", "subject"]).join(by_name.withColumnsRenamed({"name": "object", "entity_id": "object_id"}), ["project_id", "object"])
    keys = ["project_id", "subject_id", "predicate", "object_id", "entry_id"]
    return {
        "entries": rows.select("id", *body, "status"),
        "tags": tags.join(kb["tags"].select("id"), "id", "left_anti"),
        "entry_tags": tagged.join(tags.withColumnRenamed("id", "tag_id"), ["project_id", "name"]).select(F.col("id").alias("entry_id"), "tag_id"),
        "entities": entities.where("created").drop("created"),
        "entry_entities": own.withColumnRenamed("id", "entry_id").join(entities.select("project_id", "name", "type", F.col("id").alias("entity_id")), ["project_id", "name", "type"]).select("entry_id", "entity_id").distinct(),
        "relations": with_ids(triples.select(*keys).distinct().join(kb["relations"].select(*keys), keys, "left_anti"), kb["relations"], keys),
    }


#: The tables that a commit writes, with the columns it gives them.
STORED = {
    "entries": "id long, project_id string, title string, content string, category string, source string, status string",
    "tags": "id long, project_id string, name string",
    "entry_tags": "entry_id long, tag_id long",
    "entities": "id long, project_id string, name string, type string",
    "entry_entities": "entry_id long, entity_id long",
    "relations": "id long, project_id string, subject_id long, predicate string, object_id long, entry_id long",
}


def read_committed(spark: SparkSession, path: str, stored: dict[str, str] = STORED) -> dict[str, DataFrame]:
    """The tables of a store: the rows of commits that the list of commits names.

    A table has a folder per commit, so that the join with the list prunes folders."""
    named = spark.read.schema("commit string").parquet(f"{path}/commits").distinct()
    return {t: spark.read.schema(f"{columns}, commit string").parquet(f"{path}/{t}").join(named, "commit", "left_semi").drop("commit") for t, columns in stored.items()}


def create_store(spark: SparkSession, path: str, stored: dict[str, str] = STORED) -> None:
    """An empty store of tables that are written by commits."""
    for table, columns in stored.items():
        spark.createDataFrame([], columns).write.parquet(f"{path}/{table}")
    spark.createDataFrame([], "commit string").write.parquet(f"{path}/commits")


def work_tables(spark: SparkSession, path: str, commit: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes rows beside a commit's tables and reads them again."""

    def fixed(rows: DataFrame) -> DataFrame:
        work = f"{path}/work/{commit}-{uuid.uuid4().hex}"
        rows.write.parquet(work)
        return spark.read.schema(rows.schema).parquet(work)

    return fixed


def commit_rows(spark: SparkSession, path: str, commit: str, rows: dict[str, DataFrame], stored: dict[str, str] = STORED) -> str:
    """Adds rows to the tables of a store at once.

    All are written under the commit's name first, and seen only when the name is added to the list of
    commits, which is one write; a commit that fails before leaves nothing that is read, and may be
    repeated. One writer at a time."""
    for table, df in rows.items():
        columns = [c.split()[0] for c in stored[table].split(", ")]
        df.select(*columns, F.lit(commit).alias("commit")).write.mode("append").partitionBy("commit").parquet(f"{path}/{table}")
    spark.createDataFrame([(commit,)], "commit string").write.mode("append").parquet(f"{path}/commits")
    return commit


def commit_entries(candidates: DataFrame, path: str, mode: str) -> str:
    """SNK-1: adds ``store_entries``' six outputs to a store at once, and gives the commit's name.

    Rows are numbered once, into work tables. No candidates make an empty commit."""
    spark, commit = candidates.sparkSession, uuid.uuid4().hex
    rows = store_entries(candidates, read_committed(spark, path), mode, work_tables(spark, path, commit))
    return commit_rows(spark, path, commit, rows)
