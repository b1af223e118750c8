import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from loamkit.llm import exact_dedup, simhash_links, suffix_dedup
from tests.llm.fixtures import DOCS, awkward, docs, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_report_matches_brute_force(spark):
    df = awkward(spark).selectExpr("*", "doc_id AS n", "doc_id AS uid", "text AS text_sha256")
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    got = exact_dedup.report(df, digest_all=True).collect()
    assert len(got) == len(rows)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[key] if i is not None]
        assert r.keep_id == (max(ids) if ids else None) and r.group_size == len(groups[key])
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_exact_hashes_only_what_can_repeat(spark):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.report(docs(spark, [(1, "abc", "a"), (2, "abd", "a"), (3, "ABC", "a"), (4, "long text", "a")])).collect()}
    assert got[4] is None and got[2] is None and got[1] == got[3] is not None


def test_exact_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.report(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    base = words(80, 5)
    rows = [(1, None, "a"), (2, "", "a"), (3, "one", "a"), (4, "One", "a"), (5, "one two", "a"), (6, "x\x0by\x85z q", "a")]
    rows += [(100 + i, base + f" v{i}", "a") for i in range(30)]
    rows += [(200 + i, words(50, 100 + i), "a") for i in range(20)]
    got = simhash_links.near_duplicates(docs(spark, rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    want = brute_components(fps)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps


def test_simhash_links_are_complete(spark):
    """Random flips of up to five bits around a few centres: every link of three bits or fewer."""
    import random

    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = {}
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps[x] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = spark.createDataFrame([(signed(x), signed(x)) for x in fps], "fp long, owner long")
    got = {frozenset((e.a % (1 << 64), e.b % (1 << 64))) for e in simhash_links.links(points).collect()}
    xs = list(fps)
    want = {frozenset((a, b)) for i, a in enumerate(xs) for b in xs[i + 1 :] if (a ^ b).bit_count() <= 3}
    assert got == want


def test_near_groups_hold_similar_texts_only(spark):
    import random

    r = random.Random(12)
    rows = [(i, words(250, 500 + i), "a") for i in range(30)]
    for i in range(10):
        for n in range(4):
            w = rows[i][1].split(" ")
            for _ in range(4):
                w[r.randrange(len(w))] = "changed"
            rows.append((100 + 10 * i + n, " ".join(w), "a"))
    got = {x.doc_id: x.component_id for x in simhash_links.near_groups(docs(spark, rows)).collect()}
    assert got == {i: i if i < 100 else (i - 100) // 10 for i, _, _ in rows}


def test_simhash_edge_cases(spark):
    df = awkward(spark)
    assert simhash_links.near_duplicates(df).count() == df.count()
    kept = simhash_links.keep_one(df, tables=3)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {None, 1, 4, 6, 8}
    assert simhash_links.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_removed(rows, depth):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - depth + 1):
            seen[b[i : i + depth]] = seen.get(b[i : i + depth], 0) + 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"bucket_spans": 1, "block_spans": 3, "small": 1}, {"bucket_spans": 4, "block_spans": 50}])
def test_suffix_dedup_matches_brute_force(spark, settings):
    passage, other = words(60, 7), words(45, 8)
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 400), (5, "x" * 1000), (6, words(90, 9)), (7, words(90, 9)), (7, words(90, 9)), (None, other + " é " + passage)]
    rows += [(10 + i, words(30, 20 + i) + passage[: len(passage) - 7 * i] + words(20, 40 + i)) for i in range(12)]
    rows += [(40 + i, words(5, 60 + i) + " " + other + words(3, 80 + i) + other) for i in range(4)]
    df = docs(spark, [(i, t, "a") for i, t in rows])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, **settings).collect()), key=repr)
    assert got == brute_removed(rows, 200)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_segments_overlap(spark, monkeypatch):
    """A text longer than a segment loses no suffix at the cut."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    text = words(1500, 11).encode()
    covered = []
    for rows, offsets, parts in suffix_dedup._segments(pa.array([text], pa.binary()), 200):
        runs = suffix_dedup.Runs(parts)
        off = np.array(offsets)[runs.doc]
        covered += [i for lo, hi in zip(runs.lo + off, runs.hi + off) for i in range(lo, hi + 1)]
    assert sorted(covered) == list(range(len(text) - 199))


def test_difference_cover_is_one():
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


def shingles(text, k=5):
    w = lower(text).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_near_groups_recall_and_precision(spark):
    """Pairs of known five-word similarity: of those at 0.8 to 0.85 at least 0.9 are found, of those
    above 0.87 all, and none below 0.6."""
    import random

    r = random.Random(31)
    rows, pairs = [], []
    for i in range(700):
        text = words(r.randint(150, 500), 10_000 + i).split(" ")
        other = list(text)
        want = (0.825, 0.9, 0.5)[i % 3]
        while True:
            at = r.randrange(len(other))
            other[at : at + 1] = r.choice([[], ["zebra" + str(r.random())], [other[at], "more" + str(r.random())]])
            a, b = shingles(" ".join(text)), shingles(" ".join(other))
            share = len(a & b) / len(a | b)
            if share <= want:
                break
        rows += [(2 * i, " ".join(text), "a"), (2 * i + 1, " ".join(other), "a")]
        pairs.append((2 * i, share))
    group = {x.doc_id: x.component_id for x in simhash_links.near_groups(docs(spark, rows)).collect()}
    found = {i: group[i] == group[i + 1] for i, _ in pairs}
    near = [found[i] for i, s in pairs if 0.8 <= s <= 0.85]
    assert len(near) > 200 and sum(near) >= 0.9 * len(near)
    assert all(found[i] for i, s in pairs if s >= 0.87)
    assert not any(found[i] for i, s in pairs if s < 0.6)
    assert all(group[i] in (i, i - 1) for i in group)


def test_near_groups_compare_every_pair_that_shares_a_band(spark, monkeypatch):
    """Chains of drifting fingerprints and several crowds in common cells: every similar pair that
    shares a band is found, also where the texts of least hash are others."""
    import random

    import numpy as np

    r = random.Random(22)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = {}
    root = [r.getrandbits(64) for _ in range(simhash_links.TABLES)]
    for i in range(12):  # centres near one another, so that their crowds share cells but are apart
        base = [x ^ sum(1 << b for b in r.sample(range(64), 9)) for x in root]
        for n in range(12):
            fps[100 * i + n] = [x ^ sum(1 << b for b in r.sample(range(64), 3 + n % 4)) for x in base]
    most = int(simhash_links.NEAR_RATE * 64 * simhash_links.TABLES)
    masks = simhash_links._band_masks(*simhash_links.band_shape(len(fps)), simhash_links.TABLES)
    even = 0x5555555555555555
    counts = lambda x: (x ^ x >> 1) & even | (x & x >> 1 & even) << 1
    keys = {i: [tuple(counts(x) & int(m) for x, m in zip(f, band)) for band in masks] for i, f in fps.items()}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if j < i and any(a == b for a, b in zip(keys[i], keys[j])):
                seen = sum((a ^ b).bit_count() for a, b in zip(fps[i][: simhash_links.SEEN], fps[j]))
                first = sum(abs((fps[i][0] >> s & 3).bit_count() - (fps[j][0] >> s & 3).bit_count()) for s in range(0, 64, 2)) <= int(simhash_links.FIRST_RATE * 64)
                if first and seen <= int(simhash_links.SEEN_RATE * 64 * simhash_links.SEEN) and sum((a ^ b).bit_count() for a, b in zip(fps[i], fps[j])) <= most:
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in fps}
    assert 1 < len(set(want.values())) < len(fps) and np.array(masks).any()
    given = spark.createDataFrame([(i, [signed(x) for x in f]) for i, f in fps.items()], "doc_id long, fps array<long>")
    monkeypatch.setattr(simhash_links, "fingerprints", lambda *_, **__: given)
    got = {x.doc_id: x.component_id for x in simhash_links.near_groups(docs(spark, [])).collect()}
    # halves that two texts share make links of their own, which only join what is similar
    assert all(got[i] == got[want[i]] for i in fps)


def test_keep_one_judges_rows_without_or_with_repeated_ids(spark):
    near, other, third = words(300, 71), words(300, 72), words(300, 73)
    rows = [(None, near + " a", "x"), (5, near + " b", "x"), (None, other, "x"), (None, other + " tail", "x"), (7, third, "x"), (7, third + " tail", "x"), (5, words(300, 74), "x"), (9, words(300, 75), "x"), (4, words(300, 75) + " tail", "x"), (9, words(300, 76), "x")]
    kept = [(r.doc_id, r.text) for r in simhash_links.keep_one(docs(spark, rows)).collect()]
    assert len(kept) == 6
    for group in ([1], [6], [8], [9], [2, 3], [4, 5]):
        assert sum(kept.count(rows[i][:2]) for i in group) == 1


def test_exact_refines_by_length_first(spark):
    rows = docs(spark, [(1, "abc", "a"), (2, "abd", "a"), (3, "abcd", "a"), (4, "ABC", "a")])
    assert [r[0] for r in exact_dedup.repeated_lengths(rows).collect()] == [3]
    classes = exact_dedup.candidate_classes(rows)
    plan = exact_dedup.candidate_classes(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert classes.count() == 1 and "LeftSemi" in plan


def test_keep_one_takes_columns_of_any_type(spark):
    df = awkward(spark).selectExpr("*", "map('a', doc_id) AS m", "array(struct(doc_id)) AS __row", "doc_id AS uid")
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 8
    assert simhash_links.keep_one(df).columns == df.columns


def test_suffix_dedup_extra_columns(spark):
    df = docs(spark, [(1, words(80, 3), "a"), (2, words(80, 3), "a"), (3, None, "a")]).selectExpr("*", "1 AS uid", "2 AS lo", "3 AS cuts", "map(1, 2) AS bucket")
    assert sorted((r.doc_id, r.n_bytes - r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()) == [(1, 0), (2, 0), (3, 0)]
