"""Filters on entries (FLT-*); a blank or missing value means no filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def given(value: str | None) -> bool:
    return value is not None and value.strip() != ""


def entry_filter(entries: DataFrame, project: str | None = None, category: str | None = None, status: str | None = None) -> DataFrame:
    """FLT-1 to FLT-3."""
    for column, value in (("project_id", project), ("category", category), ("status", status)):
        if given(value):
            entries = entries.where(F.col(column) == value)
    return entries


def auto_approved(flag: Column, wanted: bool) -> Column:
    """FLT-4: two states: an absent flag counts as no."""
    return F.coalesce(flag, F.lit(False)) == wanted


def flag_is(flag: Column, wanted: bool) -> Column:
    """FLT-5: three states: an absent flag matches neither."""
    return flag == wanted


def created_between(col: Column, first: str | None, last: str | None) -> Column:
    """FLT-6: whole days, both included."""
    day = col.cast("date")
    out = F.lit(True)
    if given(first):
        out = out & (day >= F.lit(first).cast("date"))
    if given(last):
        out = out & (day <= F.lit(last).cast("date"))
    return out


def listed(term: str | None) -> Column:
    """FLT-7: project or title contains the term, whatever the case."""
    if not given(term):
        return F.lit(True)
    low = term.strip().lower()
    return F.lower("project_id").contains(low) | F.lower("title").contains(low)


def shadow_classified(mode: Column, verdict: Column) -> Column:
    """FLT-10."""
    return (mode == "shadow") & verdict.isNotNull()


def stale(status: Column, updated_at: Column, as_of: Column, minutes: int = 15) -> Column:
    """FLT-12: classifying for longer than ``minutes``."""
    return (status == "classifying") & (updated_at < as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def indexable(status: Column) -> Column:
    """FLT-15."""
    return status.isin("approved", "pending")


def valid_items(items: Column, keys: list[str]) -> Column:
    """FLT-13: struct (items, skipped): items whose ``keys`` are all non-blank, and how many are
    not."""
    kept = F.filter(items, lambda x: F.forall(F.array(*[x[k] for k in keys]), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    return F.struct(kept.alias("items"), (F.size(items) - F.size(kept)).alias("skipped"))


def review(entries: DataFrame, ids: DataFrame, approve: bool) -> tuple[DataFrame, DataFrame]:
    """OP-16, FLT-16: (entries, counts): selected entries that are not being classified change
    status; counts has one row (changed, refused)."""
    chosen = entries.join(ids.select("id").distinct().withColumn("_on", F.lit(True)), "id", "left")
    hit = F.coalesce("_on", F.lit(False))
    acts = hit & (F.col("status") != "classifying")
    counts = chosen.agg(F.count_if(acts).alias("changed"), F.count_if(hit & (F.col("status") == "classifying")).alias("refused"))
    return chosen.withColumn("status", F.when(acts, F.lit("approved" if approve else "rejected")).otherwise(F.col("status"))).drop("_on"), counts


def entry_page(entries: DataFrame, order: str = "created_at", descending: bool = True, limit: int = 25, offset: int = 0) -> DataFrame:
    """TOP-5: one page of entries by project, title or time; ties by id."""
    if order not in ("project_id", "title", "created_at", "updated_at"):
        raise ValueError(f"cannot order by {order}")
    return entries.orderBy(F.desc(order) if descending else F.asc(order), "id").offset(offset).limit(limit)
