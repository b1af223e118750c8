"""OP-20: importing a legacy knowledge base with natural-key matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.functions.text import trimmed


def from_epoch(col: str) -> F.Column:
    """DT-1: seconds since 1970, fraction cut off, as a timestamp."""
    return F.timestamp_seconds(F.floor(F.col(col)).cast("long"))


def with_ids(new: DataFrame, existing: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """New rows with ids that go on from the existing table's.

    A row's number is its rank among equal-hash-prefix rows plus the rows of lesser prefixes, so no
    task numbers the whole table."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    keyed = new.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(1024)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_b").orderBy(*order)
    numbered = keyed.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(firsts), "_b").crossJoin(F.broadcast(top))
    return numbered.withColumn(id_col, F.col("top") + F.col("_first") + F.col("_n")).drop("_b", "_first", "_n", "top")


def id_map(legacy: DataFrame, existing: DataFrame, keys: list[str], legacy_id: str = "uuid") -> tuple[DataFrame, DataFrame]:
    """JN-15: ((legacy id, new id) of every row, rows to insert with their ids). A legacy row whose
    natural key exists takes the existing id."""
    known = existing.groupBy(*keys).agg(F.min("id").alias("old_id"))
    matched = legacy.join(known, keys, "left")
    fresh = with_ids(matched.where("old_id IS NULL").drop("old_id", legacy_id).dropDuplicates(keys), existing, keys)
    ids = known.withColumnRenamed("old_id", "id").unionByName(fresh.select(*keys, "id"))
    return legacy.select(legacy_id, *keys).join(ids, keys).select(legacy_id, "id"), fresh


def remap(dependent: DataFrame, maps: dict[str, DataFrame], legacy_id: str = "uuid") -> DataFrame:
    """JN-15: replace legacy ids in columns; rows with an unmapped id are dropped."""
    for column, mapping in maps.items():
        pair = mapping.select(F.col(legacy_id).alias(column), F.col("id").alias("_new"))
        dependent = dependent.join(pair, column).drop(column).withColumnRenamed("_new", column)
    return dependent


def migrate_projects(legacy: DataFrame) -> DataFrame:
    """SRC-6: projects with a scalar type as a list, a list in JSON as that list, and epoch times as
    timestamps."""
    kind = trimmed(F.coalesce(F.col("project_type"), F.lit("")))
    listed = F.when(kind.startswith("["), F.from_json(kind, "array<string>"))
    kinds = F.coalesce(listed, F.when(kind == "", F.array().cast("array<string>")).otherwise(F.array(kind)))
    return legacy.withColumns({"project_type": kinds, "created_at": from_epoch("created_at"), "updated_at": from_epoch("updated_at")})


def migrate_entries(legacy: DataFrame) -> DataFrame:
    """SRC-6: entries with ``indexed`` as approved and epoch times as timestamps."""
    status = F.when(F.col("status") == "indexed", F.lit("approved")).otherwise(F.col("status"))
    return legacy.withColumns({"status": status, "created_at": from_epoch("created_at"), "updated_at": from_epoch("updated_at")})
