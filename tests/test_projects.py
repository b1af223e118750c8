from pyspark.sql import functions as F

from loamkit.functions.vectors import hashing_embedder
from loamkit.operators import ingest, projects
from loamkit.operators import term_index as ti

PROJECT = "id string, name string, project_type array<string>, description string, language string"
PATCH = "id string, technologies array<string>, description string, language string"
ROWS = [("a", "A", ["php"], "d", "en"), ("b", "B", ["go"], "e", None), ("c", "C", None, None, "pt-PT")]


def test_patches_change_what_they_name(spark):
    p = spark.createDataFrame(ROWS, PROJECT)
    patches = spark.createDataFrame([("a", [" PHP", "Cobol", "", None, "php", "Cobol"], None, "en-US"), ("b", None, "", "es"), ("c", [], None, None), ("gone", ["go"], "x", "pt")], PATCH)
    after, report = projects.patch_projects(p, patches, ["php", "go"])
    assert {r.id: tuple(r)[1:] for r in after.select(*p.columns).collect()} == {"a": ("A", ["php", "other"], "d", "en-US"), "b": ("B", ["go"], "", "es"), "c": ("C", [], None, "pt-PT")}
    assert {r.id: tuple(r)[1:] for r in report.collect()} == {"a": (["technologies", "language"], ["Cobol"], False), "b": (["description", "language"], [], True), "c": (["technologies"], [], False)}
    after, report = projects.patch_projects(p, patches.limit(0), ["php"])
    assert sorted(map(tuple, after.select(*p.columns).collect())) == ROWS and report.count() == 0


def test_texts_are_retold_in_the_new_language(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    ti.create(spark, path)
    p = spark.createDataFrame(ROWS, PROJECT)
    e = spark.createDataFrame([(1, "a", "the los", ""), (2, "b", "the los", "")], "id long, project_id string, title string, content string")
    tags = spark.createDataFrame([(1, "x"), (2, "brick")], "entry_id long, name string")
    ti.update(path, e, tags, p)
    after, report = projects.patch_projects(p, spark.createDataFrame([("a", None, None, "en-US"), ("b", None, None, "es")], PATCH), [])
    ti.retell(path, report, e, tags, after)
    assert sorted((r.entry_id, r.term) for r in ti.postings(spark, path).collect()) == [(1, "los"), (1, "x"), (2, "brick"), (2, "the")]
    editions = {r.entry_id: r.n for r in ti.log(spark, path).groupBy("entry_id").agg(F.countDistinct("edition").alias("n")).collect()}
    assert editions == {1: 1, 2: 2}


def test_stranded_entries_are_pending_and_indexed(spark):
    e = spark.createDataFrame([(1, "p", "one", "classifying"), (2, "p", "two", "approved"), (3, "p", "", "classifying"), (4, "p", "four", "rejected")], "id long, project_id string, content string, status string")
    old = spark.createDataFrame([(1, "p", 0, "stale"), (1, "p", 1, "stale"), (2, "p", 0, "two")], "entry_id long, project_id string, chunk_index int, content string")
    old = old.withColumn("embedding", hashing_embedder(8)(F.col("content")))
    after, chunks = ingest.demote_stranded(e, old, hashing_embedder(8))
    assert {r.id: r.status for r in after.collect()} == {1: "pending", 2: "approved", 3: "pending", 4: "rejected"}
    assert sorted((r.entry_id, r.chunk_index, r.content) for r in chunks.collect()) == [(1, 0, "one"), (2, 0, "two")]
