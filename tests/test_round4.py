"""Findings of round 4: each of these tests failed before."""

import random

import duckdb
import pytest

from loamkit.functions.vectors import hashing_embedder
from loamkit.operators import graph, ingest, term_index
from loamkit.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["one", "", " \t\n ", None, "# Heading", "# A\n\ntext\n \nmore", "a\r\n\r\nb", "a\n\n\r", "a\n\x0b\nb", "\x0b", "a\n\f\nb\n\n\n", "\n\nb"]


@pytest.fixture
def odd_documents(spark, tmp_path):
    """A folder of documents and labels with the awkward texts, one without a source, and a repeated id."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS * 3)]
    rows += [(101, "no source", "en", None, 9), (102, None, "en", None, 0), (110, None, "en", "s", 0), (103, "twice", "en", "s", 5), (103, "twice\n\nover", "en", "s", 11), (None, "no id", "en", "s", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, i // 2 % 2) for i in range(0, 36, 3)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return str(tmp_path), con


def test_guard_lists_entries_without_paragraphs(spark, odd_documents):
    path, con = odd_documents
    assert_same(QUERIES["stale_write_guard"](spark, path), con, ORACLES["stale_write_guard"])


def test_guard_knows_entries_without_project_or_content(spark):
    schema = "id long, project_id string, content string, status string"
    e = spark.createDataFrame([(1, None, "a", "approved"), (2, "p", None, "approved"), (3, "p", "b", "approved"), (4, "p", "c", "approved")], schema)
    now = spark.createDataFrame([(1, None, "a", "approved"), (2, "p", None, "approved"), (3, "q", "b", "approved"), (4, "p", "c", "rejected")], schema)
    old = spark.createDataFrame([(2, "p", 0, "old", [0.0]), (3, "p", 0, "old", [0.0])], "entry_id long, project_id string, chunk_index int, content string, embedding array<float>")
    got = {(r.entry_id, r.content) for r in ingest.index(e, old, hashing_embedder(4), now).collect()}
    assert got == {(1, "a"), (3, "old")}


def records_shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_pairs_through_a_hub_are_not_shuffled(spark, tmp_path):
    """400 seeds of one hub with 3 000 leaves: 1.2 million pairs."""
    edges = spark.range(3_400).selectExpr("id", "id + 10 AS subject_id", "1L AS object_id")
    seeds = spark.range(400).selectExpr("id AS seed", "id + 10 AS entity_id")
    before = set(records_shuffled(spark))
    found = graph.explore(seeds, edges, 2)[0]
    found.write.parquet(f"{tmp_path}/found")
    assert sum(n for k, n in records_shuffled(spark).items() if k not in before) < 100_000
    got = spark.read.parquet(f"{tmp_path}/found")
    assert {r.hop: r.n for r in got.groupBy("hop").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {0: 400, 1: 400, 2: 400 * 3_399}


@pytest.mark.parametrize(("block", "most"), [(1_000, 1_000_000), (1, 1_000_000), (1_000, 3)])
def test_two_steps_equal_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(graph, "BLOCK_SEEDS", block)
    monkeypatch.setattr(graph, "LIST", most)
    r = random.Random(block + most)
    edges = [(r.choice([r.randrange(60), 7]), r.randrange(60)) for _ in range(90)] + [(3, 3), (5, None), (5, 6), (5, 6)]
    near = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seeds = [(f"s{i % 25}", r.randrange(70)) for i in range(40)] + [("s1", 7), ("s1", 7), (None, 5), (None, 7), ("s2", None)] + [(f"t{i}", 9) for i in range(12)]
    want = {}
    for who, at in set(seeds):
        front = {at}
        for hop in range(3):
            for e in front:
                want[who, e] = min(hop, want.get((who, e), 9))
            front = {y for x in front for y in near.get(x, ())}
    rel = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "id long, subject_id long, object_id long")
    found = graph.explore(spark.createDataFrame(seeds, "seed string, entity_id long"), rel, 2)[0].collect()
    assert sorted((r.seed or "", r.entity_id or -1, r.hop) for r in found) == sorted((s or "", e or -1, h) for (s, e), h in want.items())


def test_index_shuffles_lists_and_queries_meet_their_rarest_term(spark, tmp_path):
    """500 entries of 60 words, one of them common to all; 500 queries of that and a rare word."""
    path = f"file://{tmp_path}/index"
    e = spark.range(500).selectExpr("id", "'p' AS project_id", "'' AS title", "concat('common rare', id, ' ', array_join(transform(sequence(1, 58), x -> concat('w', id % 10, 'x', x)), ' ')) AS content", "'c' AS category", "'approved' AS status")
    projects = spark.createDataFrame([("p", "en")], "id string, language string")
    tags = spark.createDataFrame([], "entry_id long, name string")
    term_index.create(spark, path)
    before = set(records_shuffled(spark))
    term_index.update(path, e, tags, projects)
    assert sum(n for k, n in records_shuffled(spark).items() if k not in before) < 20_000
    asked = e.selectExpr("id AS query_id", "concat('common rare', id) AS text", "CAST(NULL AS string) AS project_id", "CAST(NULL AS string) AS category")
    before = set(records_shuffled(spark))
    found = term_index.find(spark, path, term_index.query_terms(asked, projects), e).collect()
    assert sum(n for k, n in records_shuffled(spark).items() if k not in before) < 50_000
    assert sorted((r.query_id, r.entry_id, r["rank"]) for r in found) == [(i, i, 0) for i in range(500)]
