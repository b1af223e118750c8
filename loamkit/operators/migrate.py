"""OP-20: a legacy knowledge base of nine tables brought into the current one.

Tables go in the order of what they refer to. Rows are known by natural keys: of legacy rows with one
key the first (by ``created_at``, then id) is taken, unless the current table has the key, and all
of them stand for the row that is there in the end. Nulls in a key are equal to each other."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamkit.operators.ingest import commit_rows, read_committed, work_tables
from loamkit.sources.legacy import from_epoch, migrate_entries, migrate_projects, remap, with_ids

#: The tables that an import writes, with the columns it gives them.
IMPORTED = {
    "projects": "id string, name string, root_path string, description string, project_type array<string>, language string, created_at timestamp, updated_at timestamp",
    "project_paths": "project_id string, path string, created_at timestamp",
    "entries": "id long, project_id string, title string, content string, category string, source string, author string, status string, metadata string, created_at timestamp, updated_at timestamp",
    "tags": "id long, project_id string, name string",
    "entry_tags": "entry_id long, tag_id long",
    "entities": "id long, project_id string, name string, type string",
    "relations": "project_id string, subject_id long, predicate string, object_id long, entry_id long, created_at timestamp",
    "entry_entities": "entry_id long, entity_id long",
    "entry_links": "from_entry long, to_entry long, relation string",
}


def _by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys whose nulls are equal; the right side's keys fall away."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(Column.__and__, [left[k].eqNullSafe(other[f"_{k}"]) for k in keys])
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def _unknown(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose key the current table lacks, one a key: that least in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    if rest:
        best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("_r"))
        rows = best.select(*keys, "_r.*")
    else:
        rows = rows.distinct()
    return _by_key(rows, existing.select(*keys).distinct(), keys, "left_anti")


def natural_ids(legacy: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(legacy id, id, added) of every legacy row; ``added`` marks the row that is to be inserted.

    Only keys and ids are grouped, never the texts."""
    known = existing.groupBy(*keys).agg(F.min("id").alias("known"))
    first = legacy.groupBy(*keys).agg(F.min(F.struct(*order, "id"))["id"].alias("first"))
    found = _by_key(first, known, keys, "left")
    fresh = with_ids(found.where("known IS NULL").drop("known"), existing, keys)
    ids = fresh.select(*keys, "id", "first").unionByName(found.where("known IS NOT NULL").select(*keys, F.col("known").alias("id"), F.lit(None).cast(first.schema["first"].dataType).alias("first")))
    rows = legacy.select(*keys, F.col("id").alias("legacy_id"))
    return _by_key(rows, ids, keys, "inner").select("legacy_id", "id", F.coalesce(F.col("legacy_id") == F.col("first"), F.lit(False)).alias("added"))


def import_legacy(legacy: dict[str, DataFrame], kb: dict[str, DataFrame], now: Column | None = None, fixed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, DataFrame]:
    """The rows that the nine legacy tables (named as in IMPORTED) add to ``kb``'s.

    Links, tags and relations whose ends are not known are dropped; a relation's entry becomes null
    instead. Relations are known by project, subject, predicate and object; entities by project and
    name. Paths and relations without a time get ``now``. ``fixed`` writes the id maps and reads them
    again, so that ids are given once."""
    now = F.current_timestamp() if now is None else now
    or_else = lambda name, value: F.coalesce(F.col(name), F.lit(value)).alias(name)
    timed = F.coalesce(from_epoch("created_at"), now).alias("created_at")

    def mapped(table: str, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
        ids = fixed(natural_ids(legacy[table], kb[table], keys, order))
        rows = legacy[table].withColumnRenamed("id", "legacy_id").join(ids.where("added"), "legacy_id")
        return ids.select(F.col("legacy_id").alias("uuid"), "id"), rows

    entry_ids, entries = mapped("entries", ["project_id", "title"], ["created_at"])
    tag_ids, tags = mapped("tags", ["project_id", "name"], [])
    entity_ids, entities = mapped("entities", ["project_id", "name"], [])
    said = remap(legacy["relations"], {"subject_id": entity_ids, "object_id": entity_ids})
    of_entry = entry_ids.select(F.col("uuid").alias("entry_id"), F.col("id").alias("_entry"))
    said = said.join(of_entry, "entry_id", "left").drop("entry_id").withColumnRenamed("_entry", "entry_id")
    pair = lambda table, maps, keys: _unknown(remap(legacy[table], maps).select(*keys), kb[table], keys)
    made = {
        "projects": _unknown(migrate_projects(legacy["projects"]).select("id", "name", "root_path", or_else("description", ""), "project_type", or_else("language", "en"), "created_at", "updated_at"), kb["projects"], ["id"], ["created_at", "name"]),
        "project_paths": _unknown(legacy["project_paths"].select("project_id", "path", timed), kb["project_paths"], ["project_id", "path"]),
        "entries": migrate_entries(entries).select("id", "project_id", "title", "content", "category", or_else("source", "manual"), or_else("author", ""), "status", or_else("metadata", "{}"), "created_at", "updated_at"),
        "tags": tags,
        "entry_tags": pair("entry_tags", {"entry_id": entry_ids, "tag_id": tag_ids}, ["entry_id", "tag_id"]),
        "entities": entities.withColumn("type", or_else("type", "")),
        "relations": _unknown(said.select("project_id", "subject_id", "predicate", "object_id", "entry_id", timed, "id"), kb["relations"], ["project_id", "subject_id", "predicate", "object_id"], ["created_at", "id"]),
        "entry_entities": pair("entry_entities", {"entry_id": entry_ids, "entity_id": entity_ids}, ["entry_id", "entity_id"]),
        "entry_links": pair("entry_links", {"from_entry": entry_ids, "to_entry": entry_ids}, ["from_entry", "to_entry", "relation"]),
    }
    return {t: made[t].select(*[c.split()[0] for c in columns.split(", ")]) for t, columns in IMPORTED.items()}


def commit_import(legacy: dict[str, DataFrame], spark: SparkSession, path: str, now: Column | None = None) -> str:
    """OP-20: ``import_legacy`` into a store of these tables (``create_store``), seen as a whole or not at
    all; the commit's name. An import done twice adds nothing the second time."""
    commit = uuid.uuid4().hex
    rows = import_legacy(legacy, read_committed(spark, path, IMPORTED), now, work_tables(spark, path, commit))
    return commit_rows(spark, path, commit, rows, IMPORTED)


def import_counts(rows: dict[str, DataFrame]) -> DataFrame:
    """(table, migrated): how many rows each table gets."""
    counts = [df.agg(F.count(F.lit(1)).alias("migrated")).select(F.lit(t).alias("table"), "migrated") for t, df in rows.items()]
    return reduce(DataFrame.unionByName, counts)
