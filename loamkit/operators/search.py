"""Hybrid search: vector and keyword arms, rank fusion, graph expansion, hydration (OP-1 to OP-5).

Queries are a frame (query_id, ...), all answered in one plan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.functions.text import snippet
from loamkit.functions.vectors import dot, norm  # noqa: F401  (dot for callers)
from loamkit.operators.filters import entry_filter, given

#: Query vectors that are sent to the chunks at once, as one matrix; more go in blocks.
QUERY_BLOCK = 2_048
#: Digits to which scores are rounded before ranking, so that ranks do not hang on the last bit.
DIGITS = 9
#: Of BM25: how soon repeats of a term count less, and how far long entries are held against.
K1, B = 1.2, 0.75


def unit(embedding: Column) -> Column:
    """The vector in double precision at length one; null if it has no length or is not finite."""
    length = norm(embedding)
    fine = (length > 0) & ~F.isnan(length) & (length < float("inf"))
    return F.when(fine, F.transform(embedding, lambda x: x.cast("double") / length))


def _units(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their unit vectors as a matrix) of the lists of ``dim`` numbers that have a length and
    are finite; by default of the commonest number."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    if dim is None:
        dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    rows = np.flatnonzero((sizes == dim) & (dim > 0))
    flat = column.take(pa.array(rows)).flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    with np.errstate(all="ignore"):
        length = np.sqrt((matrix * matrix).sum(axis=1))
        fine = np.isfinite(length) & (length > 0)
    return rows[fine], matrix[fine] / length[fine, None]


def similarities(queries: DataFrame, chunks: DataFrame, min_score: float, block: int = QUERY_BLOCK) -> DataFrame:
    """JN-3: (query_id, entry_id, chunk_index, similarity) of pairs above the floor.

    Queries, a stated set, are sent to the chunks as matrices of about ``block`` vectors; every
    batch of chunks is multiplied by one, and only pairs above the floor leave it."""
    spark = queries.sparkSession
    q = queries.select("query_id", "embedding")
    kinds = {"query_id": q, "entry_id": chunks, "chunk_index": chunks}
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in kinds.items()) + ", similarity double"
    parts = max(1, -(-queries.count() // block))
    out = []
    for part in range(parts):
        mine = q if parts == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        table = mine.toArrow()
        if not table.num_rows:
            out.append(spark.createDataFrame([], schema))
            continue
        ids, vectors = (pa.concat_arrays(table.column(i).chunks) for i in (0, 1))
        rows, matrix = _units(vectors)
        shared = spark.sparkContext.broadcast((ids.take(pa.array(rows)), np.ascontiguousarray(matrix.T)))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, matrix = shared.value
            for batch in batches:
                at, units = _units(batch.column(2), len(matrix))
                found = np.round(units @ matrix, DIGITS)
                i, j = np.nonzero(found >= min_score)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), *(batch.column(c).take(pa.array(at[i])) for c in (0, 1)), pa.array(found[i, j])], names=["query_id", "entry_id", "chunk_index", "similarity"])

        out.append(chunks.select("entry_id", "chunk_index", "embedding").mapInArrow(score, schema))
    return reduce(DataFrame.unionByName, out)


def best_chunks(pairs: DataFrame) -> DataFrame:
    """WIN-1: each entry's best chunk per query, ties to the lower index."""
    best = F.min(F.struct((-F.col("similarity")).alias("d"), "chunk_index"))
    return pairs.groupBy("query_id", "entry_id").agg(best.alias("b")).select("query_id", "entry_id", F.col("b.chunk_index").alias("chunk_index"), (-F.col("b.d")).alias("similarity"))


def ranked(df: DataFrame, order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """0-based rank per query; the first ``k``."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)
    return out if k is None else out.where(F.col(name) < k)


def vector_search(queries: DataFrame, chunks: DataFrame, entries: DataFrame, k: int = 20, min_score: float = 0.30) -> DataFrame:
    """OP-1: the ``k`` nearest entries (not chunks) of every query: query_id, entry_id, chunk_index,
    similarity, rank. ``entries`` are those that may be found, already filtered."""
    eligible = chunks.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    best = best_chunks(similarities(queries, eligible, min_score))
    return ranked(best, [F.desc("similarity"), F.asc("entry_id"), F.asc("chunk_index")], k)


def terms(text: Column, stop_words: list[str]) -> Column:
    """TX-2: lower-case words without stop words, unstemmed."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def postings(entries: DataFrame, text: Column, stop_words: list[str]) -> DataFrame:
    """(entry_id, term, tf, len): the inverted index of entries."""
    listed = entries.select(F.col("id").alias("entry_id"), terms(text, stop_words).alias("ts"))
    return listed.select("entry_id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("entry_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def keyword_search(queries: DataFrame, index: DataFrame, n_entries: Column | float, avg_len: Column | float, k: int | None = 20, k1: float = K1, b: float = B) -> DataFrame:
    """OP-2: entries with all terms of a query (query_id, terms), by BM25: query_id, entry_id,
    score, rank.

    Postings are first cut to the queries' terms, so that documents without them never shuffle."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("n_terms"))
    used = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = (x if isinstance(x, Column) else F.lit(float(x)) for x in (n_entries, avg_len))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    hits = wanted.join(used, "term").join(df, "term").groupBy("query_id", "entry_id", "n_terms").agg(F.count(F.lit(1)).alias("m"), F.round(F.sum(part), DIGITS).alias("score"))
    return ranked(hits.where("m = n_terms").select("query_id", "entry_id", "score"), [F.desc("score"), F.asc("entry_id")], k)


#: What results keep of the arms that found them: the chunk, its similarity, and the BM25 score.
DETAILS = ("chunk_index", "similarity", "keyword_score")


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """OP-3: reciprocal-rank fusion: query_id, entry_id, fusion, matched_by, iter_order and DETAILS.

    iter_order is the order in which the fused list is walked: vector hits by rank, then those by
    keyword alone."""
    part = lambda hits, name, kind, given: (F.col(given) if given in hits.columns else F.lit(None).cast(kind)).alias(name)
    v = vector.select("query_id", "entry_id", F.col("rank").alias("vrank"), part(vector, "chunk_index", "int", "chunk_index"), part(vector, "similarity", "double", "similarity"))
    w = keyword.select("query_id", "entry_id", F.col("rank").alias("krank"), part(keyword, "keyword_score", "double", "score"))
    both = v.join(w, ["query_id", "entry_id"], "full_outer")
    term = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    matched = F.array_compact(F.array(F.when(F.col("vrank").isNotNull(), "vector"), F.when(F.col("krank").isNotNull(), "keyword")))
    return both.select("query_id", "entry_id", (term("vrank") + term("krank")).alias("fusion"), matched.alias("matched_by"), F.coalesce("vrank", F.col("krank") + 1_000_000_000).alias("iter_order"), *DETAILS)


def expand_graph(fused: DataFrame, entry_entities: DataFrame, relations: DataFrame, weight: float = 0.3, project: str | None = None) -> DataFrame:
    """OP-4: fused entries and those one directed relation away, scored by the first parent in
    walking order; entries already found keep their own score. A project keeps to its relations."""
    if given(project):
        relations = relations.where(F.col("project_id") == project)
    subject = entry_entities.select("entry_id", F.col("entity_id").alias("subject_id"))
    target = entry_entities.select(F.col("entry_id").alias("to_entry"), F.col("entity_id").alias("object_id"))
    steps = fused.join(subject, "entry_id").join(relations.select("subject_id", "object_id"), "subject_id").join(target, "object_id")
    first = F.min(F.struct("iter_order", "fusion"))
    found = steps.where("entry_id <> to_entry").groupBy("query_id", F.col("to_entry").alias("entry_id")).agg(first.alias("p"))
    fresh = found.join(fused.select("query_id", "entry_id"), ["query_id", "entry_id"], "left_anti")
    more = fresh.select("query_id", "entry_id", (F.col("p.fusion") * weight).alias("fusion"), F.array(F.lit("graph")).alias("matched_by"))
    kept = [c for c in DETAILS if c in fused.columns]
    return fused.select("query_id", "entry_id", "fusion", "matched_by", *kept).unionByName(more, allowMissingColumns=True)


def limited(results: DataFrame, limit: int = 10) -> DataFrame:
    """WIN-4."""
    return ranked(results, [F.desc(F.round("fusion", 12)), F.asc("entry_id")], limit)


def hydrate(results: DataFrame, entries: DataFrame, entry_tags: DataFrame | None = None) -> DataFrame:
    """JN-7, TOP-4: results joined to approved entries after the limit; others fall away."""
    approved = entries.where("status = 'approved'").select(F.col("id").alias("entry_id"), "project_id", "title", "category", "content")
    out = results.join(approved, "entry_id")
    if entry_tags is not None:
        tags = entry_tags.groupBy("entry_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
        out = out.join(tags, "entry_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out


def with_snippets(results: DataFrame, queries: DataFrame, chunk_texts: DataFrame) -> DataFrame:
    """OP-5, TX-4: hydrated results with the snippet of the chunk that matched, of ``chunk_texts``
    (entry_id, chunk_index, content), else of the entry; and whether the graph alone found them.

    Terms of ``queries`` are in bold; a query without terms shows the beginning."""
    parts = chunk_texts.select("entry_id", "chunk_index", F.col("content").alias("_part"))
    asked = queries.select("query_id", F.array_distinct("terms").alias("_terms"))
    out = results.join(parts, ["entry_id", "chunk_index"], "left").join(asked, "query_id", "left")
    shown = snippet(F.coalesce("_part", "content"), F.col("_terms"))
    return out.withColumns({"snippet": shown, "graph_expanded": F.array_contains("matched_by", "graph")}).drop("_part", "_terms")


def result_line(position: str = "position") -> Column:
    """TX-10: ``[n] title (category) [tags] [matched] (score)``."""
    tag_text = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    return F.concat(F.format_string("[%d] %s (%s)", F.col(position), F.col("title"), F.col("category")), tag_text, F.lit(" ["), F.array_join("matched_by", "+"), F.format_string("] (%.4f)", F.col("fusion")))


def hybrid_search(queries: DataFrame, chunks: DataFrame, entries: DataFrame, index: DataFrame, n_entries: Column | float, avg_len: Column | float, entry_entities: DataFrame, relations: DataFrame, entry_tags: DataFrame | None = None, k: int = 20, min_score: float = 0.30, limit: int = 10, project: str | None = None, category: str | None = None) -> DataFrame:
    """OP-5: all of it, for ``queries`` (query_id, embedding, terms), of which either may be null.

    ``entries`` holds every status; the arms search approved ones of the project and category, with
    the statistics of the whole index."""
    wanted = entry_filter(entries, project, category, "approved")
    vector = vector_search(queries.where("embedding IS NOT NULL"), chunks, wanted, k, min_score)
    scored = keyword_search(queries.where("terms IS NOT NULL"), index, n_entries, avg_len, None).drop("rank")
    keyword = ranked(scored.join(wanted.select(F.col("id").alias("entry_id")), "entry_id", "left_semi"), [F.desc("score"), F.asc("entry_id")], k)
    return hydrate(limited(expand_graph(fuse(vector, keyword), entry_entities, relations, project=project), limit), entries, entry_tags)


def near_duplicates(candidates: DataFrame, chunks: DataFrame, threshold: float = 0.85, block: int = QUERY_BLOCK, own: str | None = None) -> DataFrame:
    """JN-9: (query_id, best, duplicate): whether a candidate (query_id, project_id, embedding) is
    as near as ``threshold`` to any chunk of its project, and how near the nearest such chunk is.

    A project's candidates come in blocks and its chunks in slices, each of about ``block`` vectors, and
    a task multiplies one block by one slice, so that none holds a project. ``own`` names a column of
    both; a candidate does not meet chunks of its own value. Vectors of other dimensions, without a
    length, or not finite are near none; candidates without a project neither."""
    label = F.col(f"`{own}`").cast("string") if own else F.lit(None).cast("string")
    dim = F.size("embedding").alias("dim")
    c = candidates.where("embedding IS NOT NULL").select(F.col("query_id").alias("query"), F.col("project_id").alias("project"), dim, label.alias("own"), F.col("embedding").alias("vector"))
    other = [f"`{name}`" for name in chunks.columns if name != "embedding"]
    v = chunks.where("embedding IS NOT NULL").select(F.col("project_id").alias("project"), dim, label.alias("own"), F.col("embedding").alias("vector"), F.xxhash64(*other).alias("at"))
    parts = F.ceil(F.count(F.lit(1)) / block)
    keys = ["project", "dim"]
    sizes = c.groupBy(*keys).agg(parts.alias("blocks")).join(v.groupBy(*keys).agg(parts.alias("slices")), keys)
    c = c.withColumn("own_block", F.xxhash64("query")).join(sizes, keys)
    c = c.select(*keys, "query", "own", "vector", F.pmod("own_block", "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    v = v.join(sizes, keys).select(*keys, "own", "vector", F.pmod("at", "slices").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def nearest(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.combine_chunks(), held.combine_chunks()
        rows = best = np.zeros(0, np.int64)
        if asked.num_rows and held.num_rows:
            size = asked.column("dim")[0].as_py()
            vectors = lambda t: _units(pa.concat_arrays(t.column("vector").chunks), size)
            (rows, one), (there, two) = vectors(asked), vectors(held)
            found = np.round(one @ two.T, DIGITS)
            if own and len(there):
                codes = pc.index_in(asked.column("own"), pc.unique(held.column("own"))), pc.index_in(held.column("own"), pc.unique(held.column("own")))
                mine, theirs = (pc.fill_null(x, n).to_numpy() for x, n in zip(codes, (-1, -2)))
                found[mine[rows][:, None] == theirs[there][None, :]] = -np.inf
            best = found.max(axis=1, initial=-np.inf)
            rows, best = rows[best >= threshold], best[best >= threshold]
        return pa.table({"query_id": asked.column("query").take(pa.array(rows)), "near": pa.array(best, pa.float64())})

    grid = [*keys, "block", "slice"]
    pairs = c.groupBy(*grid).cogroup(v.groupBy(*grid)).applyInArrow(nearest, f"query_id {candidates.schema['query_id'].dataType.simpleString()}, near double")
    top = pairs.groupBy("query_id").agg(F.max("near").alias("best"))
    return candidates.select("query_id").join(top, "query_id", "left").withColumn("duplicate", F.col("best").isNotNull())
