from pyspark.sql import functions as F

from loamkit.operators import ingest, migrate

LEGACY = {
    "projects": ("id string, name string, root_path string, description string, project_type string, language string, created_at double, updated_at double", [("p", "P", "/p", None, " php ", None, 1.9, 2.0), ("q", "Q", "/q", "d", '["a", "b"]', "pt", 0.0, 0.0), ("r", "R", "/r", "", "", "en", 0.0, 0.0), ("s", "S", "/s", "", "[odd", "en", 0.0, 0.0)]),
    "project_paths": ("project_id string, path string, created_at double", [("p", "/p", 5.0), ("p", "/p", 6.0), ("p", "/x", None)]),
    "entries": (
        "id string, project_id string, title string, content string, category string, source string, author string, status string, metadata string, created_at double, updated_at double",
        [("e1", "p", "t", "late", "insight", None, None, "indexed", None, 9.0, 9.0), ("e2", "p", "t", "first", "insight", "cli", "me", "indexed", "{}", 3.0, 9.0), ("e3", "p", None, "c", "insight", "cli", "me", "pending", "{}", 3.0, 9.0), ("e4", "p", None, "d", "insight", "cli", "me", "pending", "{}", 4.0, 9.0), ("e5", "q", "u", "", "insight", "cli", "me", "rejected", "{}", 4.0, 9.0)],
    ),
    "tags": ("id string, project_id string, name string", [("t1", "p", "x"), ("t2", "p", "x"), ("t3", "q", "x")]),
    "entry_tags": ("entry_id string, tag_id string", [("e1", "t1"), ("e2", "t2"), ("e5", "t3"), ("e5", "gone"), ("gone", "t1")]),
    "entities": ("id string, project_id string, name string, type string", [("n1", "p", "a", "tool"), ("n2", "p", "a", None), ("n3", "p", "b", None)]),
    "relations": ("id string, project_id string, subject_id string, predicate string, object_id string, entry_id string, created_at double", [("r1", "p", "n1", "uses", "n3", "gone", 1.0), ("r2", "p", "n2", "uses", "n3", "e1", 2.0), ("r3", "p", "n3", "uses", "n1", None, None), ("r4", "p", "n3", "uses", "lost", "e1", 1.0), ("r5", "p", "n1", None, "n3", "e2", 1.0), ("r6", "p", "n1", None, "n3", "e2", 1.0)]),
    "entry_entities": ("entry_id string, entity_id string", [("e1", "n1"), ("e2", "n2"), ("e3", "gone")]),
    "entry_links": ("from_entry string, to_entry string, relation string", [("e1", "e5", "see"), ("e2", "e5", "see"), ("e2", "e5", "also"), ("e2", "gone", "see")]),
}


def frames(spark, rows=LEGACY):
    return {t: spark.createDataFrame(r, kind) for t, (kind, r) in rows.items()}


def held(spark, path):
    return {t: sorted(map(tuple, df.collect()), key=repr) for t, df in ingest.read_committed(spark, path, migrate.IMPORTED).items()}


def test_import_is_whole_and_repeatable(spark, tmp_path):
    path = f"file://{tmp_path}/kb"
    ingest.create_store(spark, path, migrate.IMPORTED)
    now = F.timestamp_seconds(F.lit(1000))
    known = {t: spark.createDataFrame([], kind) for t, kind in migrate.IMPORTED.items()}
    known["entries"] = spark.createDataFrame([(40, "q", "u")], "id long, project_id string, title string").select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in migrate.IMPORTED["entries"].split(", ")[3:]])
    ingest.commit_rows(spark, path, "before", known, migrate.IMPORTED)
    migrate.commit_import(frames(spark), spark, path, now)
    got = held(spark, path)

    assert {r[0]: (r[3], list(r[4]), r[5], r[6].timestamp()) for r in got["projects"]} == {"p": ("", ["php"], "en", 1), "q": ("d", ["a", "b"], "pt", 0), "r": ("", [], "en", 0), "s": ("", ["[odd"], "en", 0)}
    assert {(r[0], r[1], r[2].timestamp()) for r in got["project_paths"]} == {("p", "/p", 5), ("p", "/x", 1000)} and len(got["project_paths"]) == 2
    entry = {(r[1], r[2]): r for r in got["entries"]}
    assert len(got["entries"]) == len({r[0] for r in got["entries"]}) == 3 and entry["q", "u"][0] == 40
    assert entry["p", "t"][3:9] == ("first", "insight", "cli", "me", "approved", "{}") and entry["p", None][3] == "c"
    t, n, u = entry["p", "t"][0], entry["p", None][0], 40
    assert min(t, n) > 40
    tag = {r[1:]: r[0] for r in got["tags"]}
    assert len(got["tags"]) == 2 and set(got["entry_tags"]) == {(t, tag["p", "x"]), (u, tag["q", "x"])} and len(got["entry_tags"]) == 2
    name = {r[2]: r[0] for r in got["entities"]}
    assert {r[2:] for r in got["entities"]} == {("a", "tool"), ("b", "")}
    a, b = name["a"], name["b"]
    assert {(r[:5]) + (r[5].timestamp(),) for r in got["relations"]} == {("p", a, "uses", b, None, 1), ("p", b, "uses", a, None, 1000), ("p", a, None, b, t, 1)} and len(got["relations"]) == 3
    assert got["entry_entities"] == [(t, a)] and set(got["entry_links"]) == {(t, u, "see"), (t, u, "also")} and len(got["entry_links"]) == 2

    migrate.commit_import(frames(spark), spark, path, now)
    assert held(spark, path) == got


def test_import_of_nothing(spark):
    empty = {t: df.limit(0) for t, df in frames(spark).items()}
    kb = {t: spark.createDataFrame([], kind) for t, kind in migrate.IMPORTED.items()}
    assert {r.table: r.migrated for r in migrate.import_counts(migrate.import_legacy(empty, kb)).collect()} == dict.fromkeys(migrate.IMPORTED, 0)
