"""Entity graphs: exploration, export, lookup or creation of entities (OP-12, SNK-6, JN-11 to 14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamkit.sources.legacy import with_ids

#: Seeds that meet in a task with the lists of all their neighbours; ranges of entities by which they are
#: dealt out, at most; and neighbours that an entity may have for them to be sent as one list.
BLOCK_SEEDS, RANGES, LIST = 1_000, 256, 1_000_000
#: Rows of a result that are sent off together.
SENT_ROWS = 1 << 19


def explore(seeds: DataFrame, relations: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """OP-12: ((seed, entity_id, hop), (seed, relation id)): entities within ``depth`` (one or two)
    undirected steps of each seed's entity and the relations walked. ``seeds`` has (seed,
    entity_id).

    Edges are made symmetric once and read as distinct (src, dst), so that parallel relations do not
    multiply the frontier. Two steps give every pair of a seed and an entity that it reaches, so that
    their rows multiply at hubs: ``_by_lists`` makes them where they are written, from lists of
    neighbours, and shuffles no pairs. Where an entity has over LIST relations its list would be too
    long for one row; a second step then takes each distinct entity of the frontier once: its
    neighbours are joined to the entity, and the seeds that stand there last, and hot entities are
    spread over tasks, as neither join needs all rows of an entity together."""
    depth = max(1, min(2, depth))
    edges = relations.select("id", F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    edges = edges.unionByName(relations.select("id", F.col("object_id").alias("src"), F.col("subject_id").alias("dst")))
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    reached = seeds.select("seed", "entity_id", F.lit(0).alias("hop"))
    standing = seeds.select("seed", F.col("entity_id").alias("src")).distinct()
    walked = standing.join(edges, "src").select("seed", "id")
    one = standing.join(pairs, "src").select("seed", F.col("dst").alias("entity_id")).distinct()
    if depth == 2:
        front = one.join(seeds.select("seed", "entity_id"), ["seed", "entity_id"], "left_anti").withColumnRenamed("entity_id", "src")
        walked = walked.union(front.join(edges, "src").select("seed", "id"))
        most = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= LIST:
            return reached.distinct().unionByName(_by_lists(standing, edges)), walked.distinct()
        near = pairs.join(front.select("src").distinct(), "src", "left_semi")
        two = front.join(near, "src").select("seed", F.col("dst").alias("entity_id"))
        reached = reached.unionByName(two.distinct().withColumn("hop", F.lit(2)))
    reached = reached.unionByName(one.withColumn("hop", F.lit(1)))
    return reached.groupBy("seed", "entity_id").agg(F.min("hop").alias("hop")), walked.distinct()


def _blocks(standing: DataFrame) -> DataFrame:
    """(seed, src, block) of (seed, src): about BLOCK_SEEDS seeds a block, those of near entities
    together, as they often have the same neighbours; all rows of a seed in one block."""
    first = standing.groupBy("seed").agg(F.min("src").alias("first"))
    n = first.count()
    ranges = min(RANGES, max(min(n, 8), -(-n // BLOCK_SEEDS)))
    ends = first.agg(F.percentile_approx("first", [k / ranges for k in range(1, ranges)], 100 * RANGES)).first()[0] if ranges > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("first"))) if ends else F.lit(0)
    placed = first.withColumn("place", place)
    many = {r["place"]: r["n"] for r in placed.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.array(*[F.lit(-(-many.get(k, 1) // (2 * BLOCK_SEEDS))) for k in range(max(1, ranges))])  # for ranges that one entity fills
    block = F.struct("place", F.pmod(F.xxhash64("seed"), F.get(parts, F.col("place"))).alias("part"))
    placed = placed.select(F.col("seed").alias("_seed"), F.xxhash64(block).alias("block"))
    return standing.join(placed, F.col("seed").eqNullSafe(F.col("_seed"))).select("seed", "src", "block")


def _by_lists(standing: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, entity_id, hop) of the entities one or two steps from a seed, each with its least number of
    steps; ``standing`` has (seed, src), without repeats.

    Entities have their neighbours as one list. A block of seeds gets the lists of its own entities and,
    each once, those of their neighbours; a task that has them lists what its seeds reach, so that pairs
    go from there to the result."""
    lists = edges.where("src <> dst").groupBy("src").agg(F.collect_set("dst").alias("list"))
    mine = _blocks(standing.where("src IS NOT NULL")).join(lists, "src")
    asked = mine.repartition("block").select("block", F.explode("list").alias("src")).distinct()
    seed = standing.schema["seed"].dataType.simpleString()
    theirs = lists.join(asked, "src").select("block", F.lit(0).alias("kind"), F.lit(None).cast(seed).alias("seed"), "src", "list")
    rows = theirs.unionByName(mine.withColumn("kind", F.lit(1))).repartition("block").sortWithinPartitions("block", "kind", "seed")
    return rows.select("block", "kind", "seed", "src", "list").mapInArrow(_reached, f"seed {seed}, entity_id long, hop int")


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, entity_id, hop) of rows (block, kind, seed, src, list), in order: those of kind 0 are lists of
    entities that the block's seeds may step to, those of kind 1 of the seeds' own entities."""
    block, lists, step = None, [], None
    seed, own, near = None, [], []
    seeds, sizes, found, hops, held = [], [], [], [], 0

    def told() -> None:
        nonlocal held, own, near
        if own:
            for hop, entities in enumerate(step(np.array(own, np.int64), np.concatenate(near)), 1):
                seeds.append(seed)
                sizes.append(len(entities))
                found.append(entities)
                hops.append(hop)
                held += len(entities)
        own, near = [], []

    def sent(kind: pa.DataType) -> pa.RecordBatch:
        nonlocal held
        whose = pa.array(np.repeat(np.arange(len(seeds)), sizes))
        out = [pa.array(seeds, kind).take(whose), pa.array(np.concatenate(found)), pa.array(np.repeat(np.array(hops, np.int32), sizes))]
        for x in (seeds, sizes, found, hops):
            x.clear()
        held = 0
        return pa.RecordBatch.from_arrays(out, names=["seed", "entity_id", "hop"])

    kind_of_seed = None
    for batch in batches:
        kind_of_seed = batch.schema.field("seed").type
        heads = zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "seed", "src")))
        flat, ends = batch.column(4).flatten().to_numpy(), np.cumsum(pc.list_value_length(batch.column(4)).to_numpy())
        for (at, kind, who, src), begin, end in zip(heads, np.append(0, ends[:-1]).tolist(), ends.tolist()):
            if at != block or (kind and own and who != seed):
                told()
            if at != block:
                block, lists, step = at, [], None
            if kind:
                step = step or _stepper(lists)
                seed = who
                own.append(src)
                near.append(flat[begin:end])
                if held >= SENT_ROWS:
                    yield sent(kind_of_seed)
            else:
                lists.append((src, flat[begin:end].copy()))
    told()
    if seeds:
        yield sent(kind_of_seed)


def _stepper(lists: list[tuple[int, np.ndarray]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from a seed's entities and their neighbours to the entities at one step and at two."""
    lists = sorted(lists, key=lambda x: x[0])
    names, sizes = np.array([x[0] for x in lists], np.int64), np.array([len(x[1]) for x in lists], np.int64)
    everyone, place = np.unique(np.concatenate([x[1] for x in lists]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes

    def step(own: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.setdiff1d(near, own)
        at = np.searchsorted(names, one)
        many = sizes[at]
        where = np.repeat(starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        met = np.zeros(len(everyone), bool)
        met[place[where]] = True
        for known in (own, one):
            spot = np.minimum(np.searchsorted(everyone, known), len(everyone) - 1)
            met[spot[everyone[spot] == known]] = False
        return one, everyone[met]

    return step


def explore_once(seeds: DataFrame, relations: DataFrame, depth: int = 1) -> DataFrame:
    """(entity_id, hop, from): the entities within ``depth`` steps of any seed, each once, with the
    least number of steps and the least seed that is so near; for exploration of a whole selection.

    The frontier is the set of distinct entities that no earlier step has reached, with one seed each:
    a step writes a row an entity, however many seeds meet in a hub, and any depth will do."""
    edges = relations.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    pairs = edges.union(edges.select("dst", "src")).where("src <> dst").distinct()
    reached = seeds.groupBy("entity_id").agg(F.lit(0).alias("hop"), F.min("seed").alias("from"))
    frontier = reached
    for hop in range(1, depth + 1):
        steps = pairs.join(frontier.select(F.col("entity_id").alias("src"), "from"), "src")
        fresh = steps.groupBy(F.col("dst").alias("entity_id")).agg(F.min("from").alias("from"))
        frontier = fresh.join(reached.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(hop).alias("hop"), "from")
        reached = reached.unionByName(frontier)
    return reached


def named_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """JN-14, SET-2: distinct (subject, predicate, object) by name."""
    s = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    o = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    return relations.join(s, "subject_id").join(o, "object_id").select("subject", "predicate", "object").distinct()


def export(entities: DataFrame, relations: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-6: (nodes, edges); an edge needs both ends among the nodes."""
    chosen = entities if project is None else entities.where(F.col("project_id") == project)
    nodes = chosen.select("id", F.col("name").alias("label"), "type", "project_id")
    ids = nodes.select("id")
    edges = relations.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")
    return nodes, edges.select(F.col("subject_id").alias("from"), F.col("object_id").alias("to"), F.col("predicate").alias("label"))


def top_entities(entities: DataFrame, entry_entities: DataFrame, n: int = 10) -> DataFrame:
    """AGG-19: entities by number of entries, then id."""
    counts = entry_entities.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("entries"))
    return entities.join(counts, "id", "left").select("id", "name", "type", F.coalesce("entries", F.lit(0)).alias("entries")).orderBy(F.desc("entries"), "id").limit(n)


def find_or_create_tags(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """JN-11: (project_id, name, id) of wanted tags, new ones numbered on."""
    keys = ["project_id", "name"]
    want = wanted.select(*keys).distinct()
    fresh = with_ids(want.join(tags.select(*keys), keys, "left_anti"), tags, keys)
    return want.join(tags.select(*keys, "id"), keys).unionByName(fresh.select(*keys, "id"))


def find_or_create_entities(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """JN-12, JN-13: (project_id, name, type, id, created) of wanted (project_id, name, type).

    A typed one is matched by type as well; an untyped one takes the least id of its name over any
    type, made in the same batch included, and is created untyped if there is none."""
    keys = ["project_id", "name", "type"]
    want = wanted.select("project_id", "name", F.coalesce("type", F.lit("")).alias("type")).distinct()
    typed = want.where("type <> ''")
    made = with_ids(typed.join(entities.select(*keys), keys, "left_anti"), entities, keys)
    known = entities.select(*keys, "id", F.lit(False).alias("created")).unionByName(made.select(*keys, "id", F.lit(True).alias("created")))
    names = known.groupBy("project_id", "name").agg(F.min(F.struct("id", "created")).alias("k"))
    untyped = want.where("type = ''").select("project_id", "name").join(names, ["project_id", "name"], "left")
    new = with_ids(untyped.where("k IS NULL").select("project_id", "name"), known, ["project_id", "name"])
    found = untyped.where("k IS NOT NULL").select("project_id", "name", F.lit("").alias("type"), F.col("k.id").alias("id"), F.lit(False).alias("created"))
    new = new.select("project_id", "name", F.lit("").alias("type"), "id", F.lit(True).alias("created"))
    return typed.join(known, keys).select(*keys, "id", "created").unionByName(found).unionByName(new)
