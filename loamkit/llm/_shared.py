"""What the training-data operators share: shared-folder tables, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCOPES: list[list[str]] = []
_OWN: list[str] = []
#: A side is broadcast only when its rows have been measured to take at most this many bytes.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch, and rows, as texts can be very long.
BATCH_BYTES, BATCH_ROWS = 32 << 20, 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    folder of this machine serves a local master; on a cluster it is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="loamkit-"))
        path = _OWN[0]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, noted by the innermost open ``written_tables``."""
    path = f"{shared_dir(spark)}/loamkit/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``by`` names a column that
    the files are parted by.

    This cuts the lineage, fixes generated ids, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written_tables() -> Iterator[list[str]]:
    """The paths of the tables written inside the block, for ``release``."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables; call it only after the results that read them have been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def _width(kind: T.DataType) -> int:
    """Bytes of a value of fixed width, or at least."""
    return sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 16


def byte_size(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take, summed over all of them."""
    per_row: Column = F.lit(16).cast("long")
    for field in df.schema.fields:
        per_row = per_row + _width(field.dataType)
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            per_row = per_row + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            per_row = per_row + F.coalesce(F.size(col), F.lit(0)) * _width(field.dataType.elementType)
    return df.agg(F.sum(per_row).alias("b")).first()["b"] or 0


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, lists included, measure at most ``limit`` bytes,
    else unchanged (the join then shuffles). ``df`` should be a materialized table."""
    return F.broadcast(df) if byte_size(df) <= limit else df


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, maps and variants by their JSON."""

    def plain(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        text = field.dataType.simpleString()
        return F.to_json(F.struct(col.alias("x"))) if "map<" in text or "variant" in text else col

    return F.xxhash64(*[plain(f) for f in df.schema.fields])


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes; a setting of the session, as
    lazy results read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def least_of_groups(keyed: DataFrame, found: DataFrame, uid_col: str) -> DataFrame:
    """Rows of ``keyed`` with one of each group of ``found`` (doc_id, root, uid), a stored table: that of
    the least id, where null is the least only if all are null."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = sized(materialize(best.where("n > 1").select("root", F.col("best.uid").alias("stay")), "best"))
    drop = found.join(best, "root").where("uid <> stay").select(F.col("uid").alias(uid_col))
    return keyed.join(sized(materialize(drop, "drop")), uid_col, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph as (node, root), root the least node reachable.

    ``edges`` has columns a and b of one ordered type. Labels start as the least neighbour; each
    round takes the least label over all neighbours and then jumps to the label's own label, so
    long chains close in logarithmically many rounds in practice. Labels only fall, so the rounds
    end. Each round is written to the shared folder. Only nodes with an edge come out."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = materialize(hooked.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        labels = step.select("node", "root")
        if step.where("old <> root").limit(1).count() == 0:
            return labels
