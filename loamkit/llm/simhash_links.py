"""SimHash near-duplicates, joined in a segment-popcount embedding.

A text's fingerprint takes the majority of each bit over the XXH64 hashes of its three-word
shingles. Fingerprints embed into small integers: the number of set bits in each 2-bit segment.
One differing bit changes one count by at most one, so the Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints. The grid join cuts the embedding into
BLOCKS ranges of segments; a Manhattan distance of at most MAX_BITS leaves at least
BLOCKS - MAX_BITS ranges with no change at all, so fingerprints meet in the grid cell of some
choice of BLOCKS - MAX_BITS ranges. Candidates are cut by the Manhattan lower bound and then
verified by exact Hamming distance. Only distinct fingerprints are joined, and a pair comes out
of one cell alone, so that copies do not multiply.

``near_groups`` uses the same embedding and join for groups of similar texts, with several
fingerprints of five-word shingles a text: the grid cells are then bands of segments drawn from all
of them, as many and as wide as the number of texts asks for.

Defined cases: null text is the empty text, whose fingerprint is zero; texts of fewer words than a
shingle hash as one; very long texts are read whole, CHUNK shingles at a time; a bit set in exactly
half of the shingles is 0; repeated rows share their fingerprint and component; a null id is never
the least id of a component unless all are null; extra columns are ignored, and kept by
``keep_one``, whatever their names (work columns start with ``__sh_``); an empty table gives an
empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import components, least_of_groups, materialize, sized, small_batches

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Ranges of segments; each has 64 / BLOCKS bits, more or less.
BLOCKS = 6
#: For groups of similar texts: words of a shingle, fingerprints per text, and the share of all
#: bits that may differ. Texts with a share J of common shingles differ in about
#: acos(2 J / (1 + J)) / pi of their bits: 0.152 at 0.8, 0.172 at 0.75.
NEAR_WORDS, TABLES, NEAR_RATE = 5, 8, 0.173
#: A candidate pair shares a band of segments. Bands are so wide that a text meets CELL_MATES texts
#: in a cell by chance, and so many that a pair that differs in BAND_RATE of its bits shares one
#: with a chance of BAND_RECALL.
CELL_MATES, BAND_RATE, BAND_RECALL = 16, 0.152, 0.95
#: Fingerprints that travel with a cell, and the share of their bits in which a pair may differ
#: before it is dropped unverified (2.6 deviations above BAND_RATE); and such a share for the
#: first fingerprint's embedding alone (3.9 deviations).
SEEN, SEEN_RATE, FIRST_RATE = 4, 0.21, 0.33
#: Rounds in which each text is compared with one other of a half, to draw crowds together.
STAR_ROUNDS = 3
#: Shingles hashed at a time, so that a very long text needs no long list of hashes.
CHUNK = 1 << 16


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Hashes of the table-th fingerprint; the 0th takes them as they are."""
    if not table:
        return hashes
    x = hashes ^ np.uint64(table * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, k: int = SHINGLE_WORDS, seed: int = SEED, tables: int = 1) -> list[int]:
    """The 64-bit fingerprints of UTF-8 bytes, one per table; zeros if there is no word."""
    words = text.lower().split()  # on bytes: A-Z and the white space of ASCII only
    if not words:
        return [0] * tables
    if len(words) < k:
        words = [b" ".join(words)]
        k = 1
    digest = xxhash.xxh64_intdigest
    total, counts = len(words) - k + 1, np.zeros((tables, 64), np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : min(at + CHUNK, total) + k - 1]
        grams = [b" ".join(g) for g in zip(*(part[i:] for i in range(k)))]
        hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
        for t in range(tables):
            bits = np.unpackbits(_mixed(hashes, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[t] += bits.sum(axis=0, dtype=np.uint32)
    majority = np.packbits((2 * counts > total).astype(np.uint8), axis=1, bitorder="little")
    return [int(x) for x in majority.view("<u8")[:, 0]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = 1, uid_col: str | None = None, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fps): the fingerprints of every whole text, as signed 64-bit integers; with the
    row's key as ``uid`` if ``uid_col`` names one."""
    keys = [F.col(f"`{uid_col}`").cast("long").alias("uid")] if uid_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py() or b"", k, tables=tables) for t in texts], dtype=np.uint64).reshape(-1, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * tables), pa.array(fps.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], names=["doc_id", "fps", *batch.schema.names[2:]])

    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *keys).mapInArrow(run, "doc_id long, fps array<long>" + ", uid long" * len(keys))


def popcounts(fp: Column) -> Column:
    """The embedding, packed: the set bits of each 2-bit segment in that segment's place."""
    low = F.lit(0x5555555555555555)
    even, odd = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [2 * round(i * 32 / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def _mask(blocks: tuple[tuple[int, int], ...]) -> int:
    bits = sum(((1 << (b - a)) - 1) << a for a, b in blocks)
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def _manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the embeddings of two fingerprints: their differing bits, less two
    for each segment in which 01 stands against 10."""
    differ = a.bitwiseXOR(b)
    swapped = differ.bitwiseAND(F.shiftrightunsigned(differ, 1)).bitwiseAND(a.bitwiseXOR(F.shiftrightunsigned(a, 1))).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(differ) - 2 * F.bit_count(swapped)


def links(points: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b), a < b, of owners of fingerprints that differ in at most ``max_bits`` bits.
    ``points`` has distinct (fp, owner); fingerprints of one owner are not linked."""
    choices = [_mask(c) for c in combinations(_bounds(blocks), blocks - max_bits)]
    points = points.select("fp", "owner", popcounts(F.col("fp")).alias("v"))
    placed = points.select("fp", "owner", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in choices])).alias("choice", "cell"))
    left = placed.select("choice", "cell", F.col("fp").alias("fa"), F.col("owner").alias("a"), F.col("v").alias("va"))
    right = placed.select("choice", "cell", F.col("fp").alias("fb"), F.col("owner").alias("b"), F.col("v").alias("vb"))
    differ = F.col("va").bitwiseXOR(F.col("vb"))
    first = F.lit(None).cast("int")
    for i in range(len(choices) - 1, -1, -1):
        first = F.when(differ.bitwiseAND(F.lit(choices[i])) == 0, F.lit(i)).otherwise(first)
    near = (F.col("a") < F.col("b")) & (_manhattan(F.col("fa"), F.col("fb")) <= max_bits) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)
    same = (left["choice"] == right["choice"]) & (left["cell"] == right["cell"])
    return left.join(right, same & near & (first == left["choice"])).select("a", "b")


def _rooted(nodes: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    """nodes with the root of column ``key``, itself if it has no edge."""
    return nodes.join(roots.select(F.col("node").alias(key), F.col("root").alias("_root")), key, "left").withColumn(name, F.coalesce("_root", key)).drop("_root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (least doc_id reachable over links).

    Fingerprints a single bit apart are joined first: a crowd of near copies mostly hangs together
    that way, by few links, and links of more bits are then sought between different components
    only, so that a crowd's pairs are not listed."""
    rows = materialize(fingerprints(docs, id_col, text_col).select("doc_id", F.col("fps")[0].alias("fp")), "sh-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "sh-nodes")
    points = nodes.select("fp", F.col("fp").alias("owner"))
    crowds = components(links(points, 1, 2))
    held = materialize(_rooted(points, crowds, "owner", "crowd").select("fp", F.col("crowd").alias("owner")), "sh-held")
    roots = components(links(held))
    found = _rooted(_rooted(nodes, crowds, "fp", "crowd"), roots, "crowd", "root")
    return _components_of(rows, materialize(found.select(F.col("fp").alias("g"), "least", "root"), "sh-found"), "fp").select("doc_id", "fp", "component_id")


def _components_of(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with the root and the least doc_id of their node's component; ``found`` is (g, least, root)."""
    ids = sized(materialize(found.groupBy("root").agg(F.min("least").alias("component_id")), "sh-ids"))
    by_node = materialize(found.join(ids, "root").select(F.col("g").alias(key), "root", "component_id"), "sh-components")
    return rows.join(sized(by_node), key)


def _distance(a: str, b: str) -> Column:
    """Differing bits over all fingerprints of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def band_shape(texts: int, mates: float = CELL_MATES, rate: float = BAND_RATE, recall: float = BAND_RECALL) -> tuple[int, int]:
    """(segments of a band, bands) for a number of different texts."""
    by_chance = 6 / 16  # that two random segments have equal counts
    alike = (1 - rate) ** 2 + rate**2 / 2
    width = max(4, round(math.log(max(texts, 1) / mates + 1) / -math.log(by_chance)))
    return width, math.ceil(math.log(1 - recall) / math.log1p(-(alike**width)))


def _band_masks(width: int, bands: int, tables: int) -> np.ndarray:
    """(bands, tables) masks of embedded fingerprints: each band has ``width`` of their segments."""
    draw = np.random.default_rng(width * 1_000_003 + bands)
    masks = np.zeros((bands, tables), np.uint64)
    for band in masks:
        for segment in draw.choice(32 * tables, min(width, 32 * tables), replace=False).tolist():
            band[segment // 32] |= np.uint64(3 << 2 * (segment % 32))
    return masks


def cells(nodes: DataFrame, masks: np.ndarray, words: int) -> DataFrame:
    """(key, g, crowd, w0, w1, ...): a row for each band of each of nodes (g, crowd, fps), keyed by
    the band and the counts of its segments, with the first ``words`` fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(0x5555555555555555)
        for batch in batches:
            fps = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            even, odd = fps & low, (fps >> np.uint64(1)) & low
            counts = (even ^ odd) | ((even & odd) << np.uint64(1))
            keys = np.tile(np.arange(len(masks), dtype=np.uint64), (batch.num_rows, 1))
            for t in range(fps.shape[1]):
                keys = _mixed((counts[:, t, None] & masks[None, :, t]) ^ keys, t + 1)
            owner = np.repeat(np.arange(batch.num_rows), len(masks))
            seen = [pa.array(np.repeat(fps[:, t].view(np.int64), len(masks))) for t in range(words)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), *seen], names=["key", "g", "crowd", *_seen(words)])

    small_batches(nodes.sparkSession)
    return nodes.select("g", "crowd", "fps").mapInArrow(run, "key long, g long, crowd long, " + ", ".join(f"{n} long" for n in _seen(words)))


def _seen(words: int) -> list[str]:
    return [f"w{t}" for t in range(words)]


def _bits(words: int) -> list[Column]:
    """Aggregates: the bits that all texts of a class have set, and those that any has."""
    return [f(w).alias(w + x) for f, x in ((F.bit_and, "all"), (F.bit_or, "any")) for w in _seen(words)]


def _least_distance(words: int) -> Column:
    """The least in which two texts of two classes can differ: the bits that all of one class have
    and none of the other. For classes of one text this is their distance."""
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    return sum((apart(w + "alla", w + "anyb") + apart(w + "allb", w + "anya") for w in _seen(words)), F.lit(0))


def _classes_may_be_near(single: Column, words: int) -> Column:
    """The Manhattan distance of the first embedding, where both classes are of one text, and the
    least distance of the fingerprints that travel along."""
    bound = _manhattan(F.col("w0alla"), F.col("w0allb")) <= int(FIRST_RATE * 64)
    return (_least_distance(words) <= int(SEEN_RATE * 64 * words)) & (bound | ~single)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = TABLES, rate: float = NEAR_RATE, uid_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, component_id and root, over links of similar texts; with the
    row's key as ``uid`` if ``uid_col`` names one. A root is one component's alone, also where ids
    repeat or are missing.

    Texts link when at most ``rate`` of the bits of all their fingerprints differ. A crowd of near
    copies is first drawn together by few links: each text is compared with one text that shares
    the commonest of its fingerprints' halves. Then the grid join lists pairs that share a band of segments
    and do not yet hang together; they are cut by Manhattan distance and verified exactly. Texts of
    one cell and one crowd travel as a class; of two crowds one pair is compared first, and where
    that does not join them, all their pairs that share a cell are."""
    rows = materialize(fingerprints(docs, id_col, text_col, tables, uid_col, NEAR_WORDS).withColumn("g", F.xxhash64("fps")), "sg-rows")
    nodes = materialize(rows.groupBy("g").agg(F.first("fps").alias("fps"), F.min("doc_id").alias("least")), "sg-nodes")
    low = F.lit((1 << 32) - 1)
    halves = F.flatten(F.transform("fps", lambda x: F.array(x.bitwiseAND(low), F.shiftrightunsigned(x, 32))))
    most, carried = int(rate * 64 * tables), min(SEEN, tables)
    a, b = nodes.select(F.col("g").alias("a"), F.col("fps").alias("x")), nodes.select(F.col("g").alias("b"), F.col("fps").alias("y"))

    def joined(pairs: DataFrame) -> DataFrame:
        """Roots of the crowds ca and cb of those texts a and b that are similar."""
        pairs = materialize(pairs.select("a", "b", "ca", "cb"), "sg-pairs")
        near = pairs.join(a, "a").join(b, "b").where(_distance("x", "y") <= most)
        return components(near.select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    # only the halves that several texts share are of use; a text is compared by its commonest one
    points = nodes.select("g", F.posexplode(halves).alias("t", "fp")).select("g", F.xxhash64("t", "fp").alias("half"))
    shared = materialize(points.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sg-halves")
    points = materialize(points.join(sized(shared), "half"), "sg-points")
    crowds = nodes.select("g", F.col("g").alias("crowd"))
    for n in range(STAR_ROUNDS):
        placed = points.join(crowds, "g")
        order = F.xxhash64("g", F.lit(n)) if n else F.col("g")
        centre = placed.groupBy("half").agg(F.min(F.struct(order.alias("o"), F.col("g").alias("a"), F.col("crowd").alias("ca"))).alias("c")).select("half", "c.a", "c.ca")
        stars = placed.join(centre, "half").where("crowd <> ca").groupBy("g").agg(F.max(F.struct("n", "a", "ca", "crowd")).alias("s"))
        crowds = materialize(_rooted(crowds, joined(stars.select("s.a", F.col("g").alias("b"), "s.ca", F.col("s.crowd").alias("cb"))), "crowd", "crowd"), "sg-crowds")

    placed = materialize(nodes.join(crowds, "g").select("g", "crowd", "fps"), "sg-placed")
    masks = _band_masks(*band_shape(placed.count()), tables)
    # only crowds of several texts have classes to gather; a text of its own is one as it is
    large = sized(materialize(crowds.groupBy("crowd").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("crowd"), "sg-large"))
    alone = cells(placed.join(large, "crowd", "left_anti"), masks, carried)
    alone = alone.select("key", "crowd", F.col("g").alias("pick"), F.lit(1).cast("long").alias("n"), *[F.col(w).alias(w + x) for x in ("all", "any") for w in _seen(carried)])
    gathered = cells(placed.join(large, "crowd", "left_semi"), masks, carried).groupBy("key", "crowd")
    gathered = gathered.agg(F.min("g").alias("pick"), F.count(F.lit(1)).alias("n"), *_bits(carried))
    classes = alone.unionByName(gathered).repartition("key")  # both sides of the join read this one shuffle
    words = [w + x for x in ("all", "any") for w in _seen(carried)]
    left = classes.select(F.col("key").alias("key"), F.col("crowd").alias("ca"), F.col("pick").alias("a"), F.col("n").alias("na"), *[F.col(w).alias(w + "a") for w in words])
    right = classes.select(F.col("key").alias("kb"), F.col("crowd").alias("cb"), F.col("pick").alias("b"), F.col("n").alias("nb"), *[F.col(w).alias(w + "b") for w in words])
    single = (F.col("na") == 1) & (F.col("nb") == 1)
    pairs = left.join(right, (F.col("key") == F.col("kb")) & (F.col("ca") < F.col("cb")) & _classes_may_be_near(single, carried))
    pairs = materialize(pairs.select("key", "a", "b", "ca", "cb", single.alias("single")), "sg-links")
    # one pair of each two crowds first
    one = F.struct("a", "b")
    tried = pairs.groupBy("ca", "cb").agg(F.min(one).alias("p"), ((F.min(one) != F.max(one)) | ~F.bool_and("single")).alias("more"))
    tried = materialize(tried.select("p.a", "p.b", "ca", "cb", "more"), "sg-tried")
    roots = joined(tried)
    crowds = materialize(_rooted(crowds, roots, "crowd", "crowd"), "sg-crowds")

    # then, where that has not joined them, all pairs of theirs that share a cell
    apart = _rooted(_rooted(tried.where("more").withColumns({"oa": F.col("ca"), "ob": F.col("cb")}), roots, "ca", "ca"), roots, "cb", "cb").where("ca <> cb")
    apart = materialize(apart.select("oa", "ob", "ca", "cb"), "sg-apart")
    left_over = pairs.withColumnsRenamed({"ca": "oa", "cb": "ob"}).join(sized(apart), ["oa", "ob"])
    left_over = materialize(left_over, "sg-left")
    several = left_over.where("NOT single").select("key", "oa", "ob", "ca", "cb")
    wanted = sized(materialize(several.select(F.col("oa").alias("crowd")).union(several.select("ob")).distinct(), "sg-wanted"))
    members = cells(placed.join(wanted, "crowd", "left_semi"), masks, tables)
    members = materialize(members.join(sized(materialize(several.select("key").distinct(), "sg-keys")), "key", "left_semi"), "sg-members")
    sides = [w + x for x in ("all", "any") for w in _seen(tables)]
    # texts of one class against what all texts of the other share, then against each of them
    class_b = members.groupBy("key", F.col("crowd").alias("ob")).agg(*_bits(tables)).withColumnsRenamed({w: w + "b" for w in sides})
    of_a = members.select("key", F.col("crowd").alias("oa"), F.col("g").alias("a"), *[F.col(w).alias(w + x + "a") for x in ("all", "any") for w in _seen(tables)])
    of_b = members.select("key", F.col("crowd").alias("ob"), F.col("g").alias("b"), *[F.col(w).alias(w + x + "b") for x in ("all", "any") for w in _seen(tables)])
    within = lambda x, y, side: (x["key"] == y["key"]) & (x[side] == y[side]) & (_least_distance(tables) <= most)
    some = several.join(class_b, ["key", "ob"])
    some = some.join(of_a, within(some, of_a, "oa")).select(some["key"], "ob", "ca", "cb", "a", *[w + "a" for w in sides])
    more = some.join(of_b, within(some, of_b, "ob")).select("a", "b", "ca", "cb")
    more = more.union(left_over.where("single").select("a", "b", "ca", "cb"))
    roots = joined(more.groupBy("a", "b").agg(F.min("ca").alias("ca"), F.min("cb").alias("cb")))
    found = _rooted(nodes.join(crowds, "g").select("g", "least", "crowd"), roots, "crowd", "root")
    return _components_of(rows, materialize(found.select("g", "least", "root"), "sg-found"), "g").select("doc_id", "component_id", "root", *["uid"] * bool(uid_col))


def hexed(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: int = TABLES, rate: float = NEAR_RATE) -> DataFrame:
    """docs with one row of each group of ``near_groups``: that of its least id; all columns kept.

    A null id is the least only if all are null; of rows that repeat the least id one stays."""
    keyed = materialize(docs.withColumn("__sh_uid", F.monotonically_increasing_id()), "sh-docs")
    found = materialize(near_groups(keyed, id_col, text_col, tables, rate, "__sh_uid"), "sh-verdicts")
    return least_of_groups(keyed, found, "__sh_uid").select(*[f"`{c}`" for c in docs.columns])
