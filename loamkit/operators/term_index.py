"""The written search index (OP-2, TX-2, JN-21): terms of title, content and tags in the language of
an entry's project.

An index is a folder of two tables that are only appended to. ``postings`` (term, entry_id, edition,
tf) lies in folders by the term's bucket, sorted by term and entry, so that a search reads little but its
own terms; postings travel as compressed lists, a row for a bucket and a batch of entries. ``entries`` (entry_id, edition, seq, len) says which edition of an entry holds: the one of
the greatest seq; without a length it is removed. An update writes its postings first and its entries
last: until then nothing of it is seen, and what a failed update leaves behind never is. One writer at
a time.

Defined cases: null titles and contents and missing tags count as empty; an entry without terms counts
for the statistics; a project that is unknown or without a language is English; an empty index finds
nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.functions.stop_words import STOP_WORDS
from loamkit.functions.text import text_config
from loamkit.operators import search

CONFIGS = ("english", "portuguese", "spanish")
BUCKETS = 64
POSTINGS = "term string, entry_id long, edition string, tf long, bucket int"
ENTRIES = "entry_id long, edition string, seq long, len int"
#: Rows that are sent to all tasks at most, and postings of an index that are packed together anew.
SENT_ROWS, PACKED_ROWS = 1 << 18, 1 << 20


@lru_cache
def stop_words(config: str) -> tuple[str, ...]:
    """Words that searches leave out in texts of a configuration, sorted."""
    return tuple(sorted(STOP_WORDS[config].split()))


def terms(text: Column, config: Column) -> Column:
    """TX-2: the words of a text without the stop words of its configuration, unstemmed."""
    by = {name: search.terms(text, list(stop_words(name))) for name in CONFIGS}
    return F.when(config == "portuguese", by["portuguese"]).when(config == "spanish", by["spanish"]).otherwise(by["english"])


def with_config(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """JN-21: ``rows`` with ``config``, the text configuration of their project's language."""
    known = projects.select(F.col("id").alias("project_id"), text_config(F.col("language")).alias("config"))
    return rows.join(known, "project_id", "left").withColumn("config", F.coalesce("config", F.lit("english")))


def entry_terms(entries: DataFrame, entry_tags: DataFrame, projects: DataFrame, stems=None) -> DataFrame:  # noqa: ANN001
    """(entry_id, terms) of ``entries`` (id, project_id, title, content), in any order; ``stems`` is a
    function (words, config), such as ``stemmer()``."""
    tags = entry_tags.groupBy(F.col("entry_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("_tags"))
    rows = with_config(entries.select("id", "project_id", "title", "content"), projects).join(tags, "id", "left")
    found = terms(F.concat_ws(" ", "title", "content", "_tags"), F.col("config"))
    return rows.select(F.col("id").alias("entry_id"), (stems(found, F.col("config")) if stems else found).alias("terms"))


def query_terms(queries: DataFrame, projects: DataFrame, stems=None) -> DataFrame:  # noqa: ANN001
    """``queries`` (query_id, text, project_id) with ``terms``: read in the language of the project
    asked, in English where none is."""
    rows = with_config(queries, projects)
    found = terms(F.coalesce("text", F.lit("")), F.col("config"))
    return rows.withColumn("terms", stems(found, F.col("config")) if stems else found).drop("config")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(f"{path}/entries")


def create(spark: SparkSession, path: str) -> None:
    """An empty index."""
    spark.createDataFrame([], ENTRIES).write.parquet(f"{path}/entries")
    spark.createDataFrame([], POSTINGS).write.parquet(f"{path}/postings")


def _lists(bucket: np.ndarray, names: pa.Array, code: np.ndarray, entry: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed) of the postings (names[code], entry, tf); ``bucket`` is that of each name."""
    order = np.lexsort((entry, code, bucket[code]))
    code, entry, tf = code[order], entry[order], tf[order]
    own, starts = np.unique(bucket[code], return_index=True)
    for b, begin, end in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(code)]):
        used, index = np.unique(code[begin:end], return_inverse=True)
        term = pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), names.take(pa.array(used)))
        steps = np.diff(entry[begin:end], prepend=np.int64(0))  # small numbers, as entries are in order
        batch = pa.RecordBatch.from_arrays([term, pa.array(steps), pa.array(tf[begin:end])], names=["term", "step", "tf"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield b, sink.getvalue().to_pybytes()


def _buckets(names: pa.Array) -> np.ndarray:
    """``bucket`` of each of these terms."""
    return np.array([xxhash.xxh64_intdigest(n.as_buffer(), 42) % BUCKETS for n in names], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, packed, entry_ids, lens) of (entry_id, terms): for each batch of entries a row without a
    bucket that tells their lengths, and one for each bucket of its terms."""
    for batch in batches:
        ids, size = batch.column(0), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
        flat = batch.column(1).flatten().dictionary_encode()
        rows, packed = max(1, len(ids)), []
        if len(flat):
            owner = np.repeat(np.arange(len(ids), dtype=np.int64), size)
            key, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * rows + owner, return_counts=True)
            known = ids.is_valid().to_numpy(zero_copy_only=False)[key % rows]
            entry = pc.fill_null(ids, 0).to_numpy()[key[known] % rows]
            packed = list(_lists(_buckets(flat.dictionary), flat.dictionary, key[known] // rows, entry, tf[known].astype(np.int64)))
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        columns = [[None, *(b for b, _ in packed)], [None, *(x for _, x in packed)], [ids.to_pylist(), *[None] * len(packed)], [size.tolist(), *[None] * len(packed)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), longs, ints))], names=["bucket", "packed", "entry_ids", "lens"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, packed) of (term, entry_id, tf), PACKED_ROWS of them at a time."""

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        term = whole["term"].combine_chunks().dictionary_encode()
        rows = list(_lists(_buckets(term.dictionary), term.dictionary, term.indices.to_numpy().astype(np.int64), whole["entry_id"].to_numpy(), whole["tf"].to_numpy()))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "packed"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= PACKED_ROWS:
            yield made(held)
            held = []
    if sum(map(len, held)):
        yield made(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, term, entry_id, tf) of (bucket, packed)."""
    for batch in batches:
        for b, packed in zip(batch.column(0), batch.column(1)):
            with pa.ipc.open_stream(packed.as_buffer()) as source:
                for part in source:
                    entry = pa.array(np.cumsum(part.column(1).to_numpy()))
                    yield pa.RecordBatch.from_arrays([pa.repeat(b, len(part)), part.column(0).cast(pa.string()), entry, part.column(2)], names=["bucket", "term", "entry_id", "tf"])


def _dealt(packed: DataFrame, edition: str) -> DataFrame:
    """Postings of (bucket, packed) by bucket; a bucket too large for one task is split, small ones share
    tasks."""
    rows = packed.select("bucket", "packed").hint("rebalance", "bucket").mapInArrow(_unpacked, "bucket int, term string, entry_id long, tf long")
    return rows.select("term", "entry_id", F.lit(edition).alias("edition"), "tf", "bucket")


def _put(postings: DataFrame, path: str) -> None:
    """Appends postings by bucket; sorted, so that entries are written as small steps."""
    rows = postings.sortWithinPartitions("bucket", "term", "entry_id").write.mode("append").partitionBy("bucket")
    rows.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{path}/postings")


def update(path: str, entries: DataFrame, entry_tags: DataFrame, projects: DataFrame, stems=None, removed: DataFrame | None = None) -> None:  # noqa: ANN001
    """Indexes ``entries`` anew, whatever of them was indexed before, and takes out those of
    ``removed`` (id). After a change of a project's language, give its entries."""
    spark = entries.sparkSession
    edition, seq = uuid.uuid4().hex, (log(spark, path).agg(F.max("seq")).first()[0] or 0) + 1
    work = f"{path}/work/{edition}"  # what is counted is read twice, and stemmed once
    schema = "bucket int, packed binary, entry_ids array<long>, lens array<int>"
    counted = entry_terms(entries, entry_tags, projects, stems).select(F.col("entry_id").cast("long").alias("entry_id"), "terms")
    counted.mapInArrow(_counted, schema).write.parquet(work)
    made = spark.read.schema(schema).parquet(work)
    _put(_dealt(made.where("bucket IS NOT NULL"), edition), path)
    listed = made.where("bucket IS NULL").select(F.explode(F.arrays_zip("entry_ids", "lens")).alias("e")).select(F.col("e.entry_ids").alias("entry_id"), F.col("e.lens").alias("len"))
    held = listed.select("entry_id", F.lit(edition).alias("edition"), F.lit(seq).cast("long").alias("seq"), "len")
    if removed is not None:
        gone = removed.select(F.col("id").cast("long").alias("entry_id"), F.lit(edition).alias("edition"), F.lit(seq).cast("long").alias("seq"), F.lit(None).cast("int").alias("len"))
        held = held.unionByName(gone.join(listed, "entry_id", "left_anti"))
    held.write.mode("append").parquet(f"{path}/entries")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def retell(path: str, report: DataFrame, entries: DataFrame, entry_tags: DataFrame, projects: DataFrame, stems=None) -> None:  # noqa: ANN001
    """OP-18: the terms of all entries of projects that are now told in another language (``retold`` in
    the report of ``patch_projects``), made anew; other projects' stay as they are."""
    due = entries.join(report.where("retold").select(F.col("id").alias("project_id")), "project_id", "left_semi")
    update(path, due, entry_tags.join(due.select(F.col("id").alias("entry_id")), "entry_id", "left_semi"), projects, stems)


def live(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id, edition, len) of the entries in the index."""
    last = log(spark, path).groupBy("entry_id").agg(F.max_by(F.struct("edition", "len"), "seq").alias("l"))
    return last.select("entry_id", "l.edition", "l.len").where("len IS NOT NULL")


def statistics(spark: SparkSession, path: str) -> tuple[float, float]:
    """The number of entries, and their mean length."""
    r = live(spark, path).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    return float(r["n"]), float(r["mean"] or 1)


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, narrow ones, sent to all tasks of a join where they are few."""
    return F.broadcast(rows) if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else rows


def _holding(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """Of ``found``, postings, those whose edition holds: of an update that has ended, and not replaced or
    taken out by a later one."""
    written = log(spark, path)
    former = written.join(live(spark, path).select("entry_id", "edition"), ["entry_id", "edition"], "left_anti").select("entry_id", "edition")
    found = found.join(_sent(written.select("edition").distinct()), "edition", "left_semi")
    return found.join(_sent(former), ["entry_id", "edition"], "left_anti")


def _asked(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """(bucket, term, entry_id, tf) of the entries that hold, for the terms of ``queries`` alone where given."""
    found = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    if queries is not None:
        wanted = queries.select(F.explode("terms").alias("term")).distinct()
        found = found.join(_sent(wanted.select("term", bucket(F.col("term")).alias("bucket"))), ["bucket", "term"], "left_semi")
    return _holding(spark, path, found).select("bucket", "term", "entry_id", "tf")


def postings(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """(entry_id, term, tf, len) of the entries that hold, for the terms of ``queries`` alone where
    given."""
    return _asked(spark, path, queries).join(live(spark, path).select("entry_id", "len"), "entry_id").select("entry_id", "term", "tf", "len")


def find(spark: SparkSession, path: str, queries: DataFrame, entries: DataFrame, k: int = 20) -> DataFrame:
    """OP-2: for ``queries`` (query_id, terms, project_id, category; of the last two either may be
    null) the best approved entries of the project and category: query_id, entry_id, score, rank.

    A query meets the entries that have its rarest term, not those of each of its terms: entries that may
    be found have their postings as one map, in which a query looks up its other terms."""
    n, mean = statistics(spark, path)
    asked = queries.select("query_id", "project_id", "category", F.array_distinct("terms").alias("terms")).where("size(terms) > 0")
    found = _asked(spark, path, asked)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", idf.alias("idf"))
    each = asked.select("query_id", "project_id", "category", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).join(known, "term")
    whole = each.groupBy("query_id", "project_id", "category", "n_terms").agg(F.sort_array(F.collect_list(F.struct("df", "term", "idf"))).alias("needs")).where("size(needs) = n_terms")
    whole = whole.select("query_id", "project_id", "category", F.col("needs")[0]["term"].alias("rarest"), "needs")

    ok = entries.where("status = 'approved'").select(F.col("id").alias("entry_id"), F.col("project_id").alias("_p"), F.col("category").alias("_c"))
    ok = ok.join(live(spark, path).select("entry_id", "len"), "entry_id")
    each = found.select("entry_id", "term", "tf").repartition("entry_id").groupBy("entry_id", "term").agg(F.sum("tf").alias("tf"))
    held = each.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("has")).join(ok, "entry_id")
    near = held.select("*", F.explode(F.map_keys("has")).alias("rarest")).join(_sent(whole), "rarest")
    near = near.where("(project_id IS NULL OR project_id = _p) AND (category IS NULL OR category = _c)")

    def part(t: Column) -> Column:
        tf = F.try_element_at("has", t["term"])
        return t["idf"] * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("len") / F.lit(mean)))

    score = F.round(F.aggregate("needs", F.lit(0.0), lambda total, t: total + part(t)), search.DIGITS)
    hits = near.select("query_id", "entry_id", F.explode(F.filter(F.array(score), lambda x: x.isNotNull())).alias("score"))  # told once
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("entry_id")))
    return hits.withColumn("place", place).where(F.col("place") <= k).select("query_id", "entry_id", "score", (F.col("place") - 1).alias("rank"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes what holds to a new index, without former editions."""
    create(spark, target)
    edition = uuid.uuid4().hex
    _put(_dealt(_asked(spark, path).select("term", "entry_id", "tf").mapInArrow(_packed, "bucket int, packed binary"), edition), target)
    held = log(spark, path).groupBy("entry_id").agg(F.max_by(F.struct("seq", "len"), "seq").alias("l")).select("entry_id", "l.*").where("len IS NOT NULL")
    held.select("entry_id", F.lit(edition).alias("edition"), "seq", "len").write.mode("append").parquet(f"{target}/entries")
