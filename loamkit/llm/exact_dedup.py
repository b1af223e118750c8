"""Exact deduplication by progressive refinement (length, prefix hash, full hash), all on the JVM.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The first pass counts
byte lengths alone. Only rows whose length repeats are hashed by their prefix, and only rows whose
(length, prefix) class repeats are hashed in full and shuffled.

Defined cases: null text is the empty text; empty texts form one group; texts may be of any
length, as only lengths, hashes and the kept rows are shuffled; rows repeated with one doc_id and
one text count as separate rows of which exactly one stays; a null doc_id sorts below every other;
of rows that tie in id, ``keep_one`` keeps the one whose own text (before lower-casing) has the
larger hash; extra columns of any type, maps too, are kept or ignored, whatever their names (work
columns start with ``__xd_``); an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import ascii_lower, materialize, sized

#: Code points of the prefix whose hash is the second refinement.
PREFIX_CHARS = 64


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _length(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0))


def _prefix(text_col: str, prefix_chars: int) -> Column:
    return F.xxhash64(ascii_lower(F.coalesce(F.substring(F.col(f"`{text_col}`"), 1, prefix_chars), F.lit(""))))


def repeated_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The byte lengths that two rows or more have: a narrow table, at most one row per length."""
    lengths = docs.select(_length(text_col).alias("__xd_len")).groupBy("__xd_len").agg(F.count(F.lit(1)).alias("n"))
    return lengths.where("n > 1").select("__xd_len")


def candidate_classes(docs: DataFrame, text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The (length, prefix hash) classes that hold two rows or more; prefixes are hashed only where
    the length repeats."""
    lengths = sized(materialize(repeated_lengths(docs, text_col), "xd-lengths"))
    again = docs.withColumn("__xd_len", _length(text_col)).join(lengths, "__xd_len", "left_semi")
    keys = again.select("__xd_len", _prefix(text_col, prefix_chars).alias("__xd_prefix"))
    return keys.groupBy("__xd_len", "__xd_prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__xd_len", "__xd_prefix")


def _flagged(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """docs with __xd_len, __xd_prefix and __xd_again: whether the row's class repeats."""
    classes = sized(materialize(candidate_classes(docs, text_col, prefix_chars), "xd-classes").withColumn("__xd_hit", F.lit(True)))
    keyed = docs.withColumns({"__xd_len": _length(text_col), "__xd_prefix": _prefix(text_col, prefix_chars)})
    return keyed.join(classes, ["__xd_len", "__xd_prefix"], "left").withColumn("__xd_again", F.coalesce("__xd_hit", F.lit(False)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows that no other row can equal, unless ``digest_all``."""
    rows = _flagged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", prefix_chars)
    digest = F.sha2(_norm("text"), 256)
    rows = rows.select("doc_id", "__xd_again", (digest if digest_all else F.when(F.col("__xd_again"), digest)).alias("text_sha256"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(rows, "xd-rows")
    alone = rows.where("NOT __xd_again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = rows.where("__xd_again")
    groups = again.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("best"))
    groups = sized(materialize(groups, "xd-groups"))
    joined = again.join(groups, "text_sha256").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs without repeats: of equal texts the row with the largest id stays, all columns kept.

    Only rows of repeating (length, prefix) classes are hashed in full and shuffled; each task
    sends at most one row of a group."""
    columns = docs.columns
    rows = _flagged(docs, text_col, prefix_chars)
    alone = rows.where("NOT __xd_again").select(*[f"`{c}`" for c in columns])
    order = F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    again = rows.where("__xd_again").select(F.sha2(_norm(text_col), 256).alias("__xd_sha"), order.alias("__xd_order"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__xd_row"))
    best = again.groupBy("__xd_sha").agg(F.max_by("__xd_row", "__xd_order").alias("__xd_row"))
    return alone.union(best.select(*[F.col(f"__xd_row.`{c}`") for c in columns]))
