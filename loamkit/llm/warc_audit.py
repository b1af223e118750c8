"""Merkle fixity audit of archived records.

Records of an archive are ordered by offset. Level 0 of its tree has one node per range of
``LEAF_BYTES`` offsets, the SHA-256 of the digests of the records that start there; each node
above hashes the ordered hashes of up to FANOUT nodes below. Replicas are compared by their roots,
then level by level below mismatching nodes alone, then by record within mismatching ranges. Both
replicas' trees are built side by side, one table a level. No step gathers more than FANOUT nodes
or one range's records in a group.

Defined cases: null payloads and urls are empty; very long records are hashed whole where they are
read, and end ranges of their own; rows that repeat are records of their own, at
offsets of their own; records without an id go to archives by their hash; an archive that one
replica lacks mismatches at its root; empty tables give no findings; extra columns are ignored,
whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.llm._shared import materialize

LEAF_BYTES = 1 << 16
FANOUT = 16
#: Levels above the ranges; FANOUT**LEVELS ranges make the largest archive (4 GiB).
LEVELS = 4
#: Records of an archive when a table of pages is laid out as archives.
ARCHIVE_RECORDS = 1024


def record_bytes(url: Column, payload: Column) -> Column:
    """The bytes of a record: a response header line and the payload."""
    return F.concat(F.lit("WARC/1.1 response "), F.coalesce(url, F.lit("")), F.lit("\r\n\r\n"), F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n"))


def lay_out(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_archive: int = ARCHIVE_RECORDS) -> DataFrame:
    """Records (archive, offset, length, record_id, digest) of a table: ids in order, archives of
    ``per_archive`` ids, offsets running. Only digests and lengths are shuffled."""
    record = record_bytes(F.col(f"`{url_col}`"), F.col(f"`{payload_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    archive = F.coalesce(F.floor(F.col("record_id") / per_archive), -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 20))).cast("long")
    before = Window.partitionBy("archive").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("archive", archive).select("archive", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "record_id", "digest")


def tree(records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Nodes (side, archive, node, hash) by level, ranges first, roots last."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "digest")))
    node = F.floor(F.col("offset") / leaf_bytes).cast("long")
    text = F.array_join(F.transform(ordered, lambda r: F.concat_ws(":", r["offset"].cast("string"), r["digest"])), ",")
    out = [materialize(records.groupBy("side", "archive", node.alias("node")).agg(F.sha2(text, 256).alias("hash")), "merkle-0")]
    for level in range(1, levels + 1):
        below = F.array_sort(F.collect_list(F.struct("node", "hash")))
        text = F.array_join(F.transform(below, lambda r: F.concat_ws(":", r["node"].cast("string"), r["hash"])), ",")
        up = out[-1].groupBy("side", "archive", F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(F.sha2(text, 256).alias("hash"))
        out.append(materialize(up.withColumnRenamed("up", "node"), f"merkle-{level}"))
    return out


def _mismatching(nodes: DataFrame) -> DataFrame:
    """(archive, node) whose hashes differ or that one side lacks."""
    found = nodes.groupBy("archive", "node").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count(F.lit(1)).alias("n"))
    return found.where("n < 2 OR low <> high").select("archive", "node")


def audit(mine: DataFrame, theirs: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Findings (archive, node, offset, record_id, status): records that are changed, or missing
    or extra in ``theirs``, located by descending from the roots."""
    names = ["archive", "offset", "length", "record_id", "digest"]
    sides = mine.select(F.lit("a").alias("side"), *names).unionByName(theirs.select(F.lit("b").alias("side"), *names))
    records = materialize(sides, "records")
    nodes = tree(records, leaf_bytes, fanout, levels)
    bad = materialize(_mismatching(nodes[-1]), "bad-roots")
    for level in range(levels - 1, -1, -1):
        above = bad.select("archive", F.col("node").alias("up"))
        below = nodes[level].withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(above, ["archive", "up"], "left_semi")
        bad = materialize(_mismatching(below), f"bad-{level}")
    held = records.withColumn("node", F.floor(F.col("offset") / leaf_bytes).cast("long")).join(bad, ["archive", "node"], "left_semi")
    of = {x: held.where(F.col("side") == x).select("archive", "node", "offset", F.col("record_id").alias(f"{x}_id"), F.col("digest").alias(f"{x}_digest")) for x in "ab"}
    both = of["a"].join(of["b"], ["archive", "node", "offset"], "full_outer")
    status = F.when(F.col("a_digest").isNull(), "extra").when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest") != F.col("b_digest"), "changed")
    return both.select("archive", "node", "offset", F.coalesce("a_id", "b_id").alias("record_id"), status.alias("status")).where("status IS NOT NULL")
