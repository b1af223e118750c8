"""Square catchers, the partition join and whitening against brute force, and their odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamkit.llm import chebyshev_whiten, partition_join, queries, square_catchers, suffix_dedup
from tests.llm.fixtures import awkward, docs, words


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 30), st.integers(2, 6), st.lists(st.integers(0, 2), max_size=40))
@settings(max_examples=300, deadline=None)
def test_runs_equal_brute_force(head, period, times, tail):
    w = head + (head + tail + [1, 0, 2])[:period] * times + tail
    got = sorted(map(tuple, square_catchers.runs(np.array(w, np.int64), len(w)).tolist()))
    assert got == plain_runs(w)


@pytest.mark.parametrize("w", [np.zeros(200_000, np.int64), np.arange(200_000) % 700])
def test_long_runs_take_no_square_of_their_length(w):
    assert len(square_catchers.runs(w, len(w))) == 1


def test_op11_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(texts)
    planted = 0
    for i, text in texts.items():
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if n > 500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            planted += 1
        runs = plain_runs(w)
        dropped = {j for a, b, q in runs for j in range(a + q, b)}
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
        a, b, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
        best = (a, b - a, q, 1000 * (b - a) // q) if runs else (None,) * 4
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in dropped)).hexdigest()
    assert planted > 3


def test_runs_of_awkward_texts(spark):
    from pyspark.sql import functions as F

    rows = square_catchers.periodic_runs(awkward(spark).withColumn("runs", F.lit(1))).collect()
    assert len(rows) == 13 and all(r.runs == [] for r in rows)
    assert {r.doc_id: r.n_words for r in rows}[1] == 0
    one = square_catchers.periodic_runs(docs(spark, [(1, "x " + " a b\tc\n" * 5 + "y", "s"), (2, "\x1f " * 13, "s")])).orderBy("doc_id").collect()
    assert [tuple(r) for r in one[0].runs] == [(1, 15, 3)] and one[0].collapsed == "x a b c y"
    assert [tuple(r) for r in one[1].runs] == [(0, 13, 1)]
    assert square_catchers.periodic_runs(docs(spark, [])).count() == 0


def sets_of(text, k=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def expected(rows):
    sets = [(i, sets_of(t)) for i, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= 80 * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        least.setdefault(find(x), []).append(i)
    return sorted((i, len(s), min(least[find(x)], key=lambda i: (i is None, i or 0)) if s else i) for x, (i, s) in enumerate(sets))


def clustered(seed=3, groups=8, size=25):
    """Groups of texts around a base each, with so many words changed that similarities lie about the
    threshold; short ones, too, and many that share a passage of a good half of their words."""
    r, out = random.Random(seed), []
    for g in range(groups):
        base = words(r.choice([8, 14, 30, 80, 150]), 100 + g).split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = [f"new{r.randrange(10**6)}"] * r.randint(0, 1)
            out.append(" ".join(w))
    passage = words(70, 7)
    out += [f"{passage} {words(r.randint(15, 40), 500 + i)}" for i in range(60)]
    return [(i, t, "s") for i, t in enumerate(out)]


@pytest.mark.parametrize("budget", [128, 1])
def test_jaccard_components_equal_brute_force(spark, budget):
    """With a budget of 1 every set that has candidates is laid out with its neighbourhoods."""
    rows = clustered()
    got = sorted(tuple(r) for r in partition_join.similar_sets(docs(spark, rows), budget=budget).collect())
    want = expected(rows)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 60


def test_jaccard_of_awkward_texts(spark):
    a = awkward(spark)
    rows = [(r.doc_id, r.text, r.source) for r in a.collect()]
    got = sorted((tuple(r) for r in partition_join.similar_sets(a).collect()), key=repr)
    assert got == sorted(expected_rows(rows), key=repr)
    assert partition_join.similar_sets(docs(spark, [])).count() == 0


def expected_rows(rows):
    numbered = expected([(n, t, s) for n, (_, t, s) in enumerate(rows)])
    ids = {}
    for n, _, c in numbered:
        ids.setdefault(c, []).append(rows[n][0])
    least = {c: min((i for i in g if i is not None), default=None) for c, g in ids.items()}
    return [(rows[n][0], s, least[c] if s else rows[n][0]) for n, s, c in numbered]


def test_sets_differ_in_so_much_at_most():
    for total in range(9, 400):
        fits = [d for d in range(total + 1) if (total - d) % 2 == 0 and 100 * ((total - d) // 2) >= 80 * ((total + d) // 2)]
        assert partition_join.differing(total) == max(fits, default=-1)


def test_whitening_equals_dense_eigenvectors(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted(queries.op13_whitening(spark, sf).collect(), key=lambda r: (r.vec_id, r.component))
    full = {r.vec_id: np.floor(256 * np.array(r.embedding, np.float64)).astype(np.int64) for r in vectors.collect()}
    x = np.unique(np.array(list(full.values())), axis=0)
    v = np.cov(x.T, bias=True)
    values, basis = np.linalg.eigh(v)
    white = (np.array([full[i] for i in sorted(full)]) - x.mean(axis=0)) @ basis[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    assert np.abs(np.abs(np.array([r.whitened for r in rows]).reshape(-1, 4)) - np.abs(white)).max() < 1e-9
    assert all(r.n == len(x) and r.identity_error < 1e-9 for r in rows)
    assert np.allclose([r.explained for r in rows[:4]], values[::-1][:4] / values.sum(), rtol=1e-9)
    first = rows[0]
    assert first.deviation == sum((int(first.n) * int(a) - int(s)) ** 2 for a, s in zip(full[first.vec_id], x.sum(axis=0)))


def test_whitening_of_awkward_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 2.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, []), (10, [1e300, 0.0])]
    frame = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, n int")
    got = chebyshev_whiten.whiten(frame).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == [("1", 1), ("1", 2), ("2", 1), ("2", 1), ("2", 2), ("2", 2), ("None", 1), ("None", 2)]
    assert {r.n for r in got} == {3}
    assert chebyshev_whiten.whiten(frame.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert chebyshev_whiten.whiten(same).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in chebyshev_whiten.whiten(flat).collect()} == {1}


def test_deviations_of_any_size():
    x, sums = np.array([[1 << 30, 3]], np.int64), [5, 7]
    assert chebyshev_whiten._deviations(x, 2, sums).tolist() == [((2 << 30) - 5) ** 2 + 1]
    with pytest.raises(OverflowError):
        chebyshev_whiten._deviations(x, 1 << 20, sums)


def test_jaccard_subsets_travel_a_bucket_a_row(spark, monkeypatch):
    rows = clustered(seed=5)
    texts = docs(spark, rows).selectExpr("doc_id AS node", "doc_id AS crowd", "text").coalesce(1)
    dealt = partition_join._subsets(texts, 80, 7).collect()
    assert len(dealt) <= 14 and sum(len(r["keys"]) for r in dealt) > 8 * 50 * len(dealt)
    monkeypatch.setattr(partition_join, "BUCKET_KEYS", 500)
    assert sorted(tuple(r) for r in partition_join.similar_sets(docs(spark, rows)).collect()) == expected(rows)


def test_jaccard_neighbourhoods_of_every_set_that_asks(spark):
    """With a budget of 0 every set that has candidates is laid out with its neighbourhoods."""
    rows = clustered(seed=9)
    got = sorted(tuple(r) for r in partition_join.similar_sets(docs(spark, rows), budget=0).collect())
    assert got == expected(rows)


def family(size=300, n=100, seed=21):
    """A text and copies with so many words changed that many are similar to no other."""
    r, base = random.Random(seed), words(n, 77).split()
    out = []
    for _ in range(size):
        w = list(base)
        for at in r.sample(range(n), r.randint(1, 9)):
            w[at] = f"new{r.randrange(10**9)}"
        out.append(" ".join(w))
    return [(i, t, "s") for i, t in enumerate(out)]


def test_jaccard_family_is_compared_as_it_is_while_that_costs_less(spark, monkeypatch):
    """Subsets that over BUDGET others have no longer send all sets that have any of them through their
    neighbourhoods, of a row a shingle and more; those are for sets with more comparisons than that."""
    rows, laid = family(), []
    former = partition_join._neighbourhoods
    monkeypatch.setattr(partition_join, "_neighbourhoods", lambda texts, percent: laid.append(texts.count()) or former(texts, percent))
    assert sorted(tuple(r) for r in partition_join.similar_sets(docs(spark, rows)).collect()) == expected(rows)
    assert not laid
    assert sorted(tuple(r) for r in partition_join.similar_sets(docs(spark, rows), budget=3).collect()) == expected(rows)
    assert laid and laid[0] <= len(rows)


def test_jaccard_subsets_of_the_same_sets_are_one_group():
    import pyarrow as pa

    whole = lambda *x: np.array(x, np.int64).tobytes()
    # keys 5 and 9 are of nodes 1 and 2 (two crowds), and node 3 of crowd 1 looks for 9; key 7 is of one crowd
    bucket = pa.table({"bucket": [0, 0], "side": [0, 1], "keys": [whole(9, 5, 5, 9, 7, 7), whole(9)], "nodes": [whole(1, 1, 2, 2, 1, 4), whole(3)], "crowds": [whole(0, 0, 0, 0, 0, 4 ^ 1), whole(3 ^ 1)]})
    got = partition_join._several(bucket).to_pylist()
    assert len({r["group"] for r in got}) == 1
    assert sorted((r["node"], r["crowd"], r["side"], r["others"]) for r in got) == [(1, 1, 0, 1), (1, 1, 0, 1), (2, 2, 0, 1), (2, 2, 0, 1), (3, 1, 1, 1)]


def test_lists_of_spans_are_never_sent_to_all(spark, monkeypatch):
    """They grow with the texts, so a small run must go the way of a large one."""
    hinted, sized = [], suffix_dedup.sized
    monkeypatch.setattr(suffix_dedup, "sized", lambda df, *more: hinted.append(df.columns) or sized(df, *more))
    shared = words(60, 5)
    rows = [(i, f"{words(40, 200 + i)} {shared} {words(40, 300 + i)}", "s") for i in range(20)]
    got = suffix_dedup.remove_repeats(docs(spark, rows)).collect()
    assert all(r.n_removed >= len(shared) for r in got)
    assert hinted and not any("runs" in columns for columns in hinted)
