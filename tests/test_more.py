import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamkit.functions.stem import porter, stem
from loamkit.operators import classify, filters, ingest, reports
from loamkit.plans.queries import _candidates, _judge
from loamkit.schemas import Settings
from loamkit.streaming import jobs


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("electrical", "electr"), ("replacement", "replac"), ("adoption", "adopt"), ("controll", "control"), ("roll", "roll"), ("at", "at")])
def test_porter(word, want):
    assert porter(word) == want


def test_romance_stems():
    assert stem("trabalhando", "portuguese") == stem("trabalhar", "portuguese") == "trabalh"
    assert stem("trabajando", "spanish") == stem("trabajar", "spanish") == "trabaj"


def test_judge_is_asked_once_per_identity(spark, sf):
    c = _candidates(spark, sf).where("id < 40").withColumn("project_id", F.lit("p"))
    twice = c.unionByName(c.withColumn("id", F.col("id") + 1000))
    none = spark.createDataFrame([], "id long, project_id string, candidate_hash string, model string, prompt_version string, rules_version string, status string, semantic_score int")
    out, cache = classify.classify(twice, none.drop("id"), _judge, Settings(mode="enforce"), "m", "p")
    rows = out.collect()
    assert len(rows) == 80 and not any(r.cache_hit for r in rows)
    identities = {r.candidate_hash for r in rows if not r.vetoed}
    assert cache.count() == len(identities)
    again, _ = classify.classify(twice, cache.select(*none.columns[1:]), _judge, Settings(mode="enforce"), "m", "p")
    assert {(r.id, r.final_score, r.status) for r in again.collect()} == {(r.id, r.final_score, r.status) for r in rows}
    linked = classify.link_assessments(out, cache.withColumn("id", F.monotonically_increasing_id()))
    assert linked.where("importance_assessment_id IS NULL AND NOT vetoed").count() == 0


def test_gates_do_not_pass_on_nothing(spark):
    row = ("p", 60, 0, 0, 0, 0, 0, 0, 0, None, None)
    names = "project_id string, reviewed long, approved long, approved_would_reject long, would_reject long, classified long, stale long, computable long, false_approvals long, must_keep_rejects long, must_reject_eligible long"
    got = {r.gate: r.passes for r in reports.readiness_gates(spark.createDataFrame([row], names)).collect()}
    assert got == {"sample": True, "must_keep": False, "false_rejects": False, "reduction": False, "stale": True, "false_auto_approvals": False, "must_reject": False}
    off = {r.gate: r.passes for r in reports.readiness_gates(spark.createDataFrame([row], names), auto_threshold=None).collect()}
    assert off["false_auto_approvals"] and off["must_reject"]
    good = ("p", 60, 20, 1, 30, 60, 0, 10, 0, 0, 0)
    assert all(r.ready for r in reports.readiness_gates(spark.createDataFrame([good], names)).collect())


def test_corpus_figures(spark):
    rows = [("t", "TBD", []), ("t", "We decided that the worker must keep all of its jobs in the same queue as before.", [("Redis", "")]), ("t", "maybe", [])]
    f = spark.createDataFrame(rows, "title string, content string, entities array<struct<name:string,type:string>>")
    r = reports.corpus_figures(f).first()
    assert (r.vetoed, r.eligible) == (1, 1) and reports.corpus_figures(None) is None


def test_bulk_review_refuses_what_is_being_classified(spark):
    e = spark.createDataFrame([(1, "pending"), (2, "classifying"), (3, "pending")], "id long, status string")
    changed, counts = filters.review(e, spark.createDataFrame([(1,), (2,)], "id long"), False)
    assert {r.id: r.status for r in changed.collect()} == {1: "rejected", 2: "classifying", 3: "pending"}
    assert tuple(counts.first()) == (1, 1)


def test_condense_drops_known_knowledge(spark):
    from loamkit.functions.vectors import hashing_embedder

    embed = hashing_embedder(64)
    have = spark.createDataFrame([(1, "p", "Queue\nthe queue lives in redis")], "entry_id long, project_id string, content string").withColumn("embedding", embed(F.col("content")))
    said = spark.createDataFrame([("s1", "p", '[{"title":"Queue","content":"the queue lives in redis"}]'), ("s2", "p", '[{"title":"New","content":"workers restart nightly"}]'), ("s3", "p", "nothing")], "session_id string, project_id string, transcript string")
    kept, runs = ingest.condense(said, lambda c: c, embed, have, Settings())
    assert [r.title for r in kept.collect()] == ["New"]
    assert {r.session_id: (r.status, r.entries_created) for r in runs.collect()} == {"s1": ("skipped", 0), "s2": ("done", 1), "s3": ("skipped", 0)}


def feed(spark, path, schema, slices):
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_turns_are_taken_once_over_restarts(spark, tmp_path):
    """New objects take up from the folders; the rest of a session that began in an earlier batch is
    taken, turns that come again are not, in the same batch or a later one."""
    schema = T.StructType.fromDDL("session_id string, turn int, text string")
    log = lambda: jobs.Log(spark, str(tmp_path / "log"), schema)
    for rows in ([("a", 1, "x"), ("a", 2, "y"), ("a", 1, "x")], [("b", 1, "z"), ("a", 1, "x")], [("a", 3, "w"), ("c", 1, "v"), ("b", 1, "z")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.sessions_once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), log(), str(tmp_path / "ckpt"))
    assert sorted(tuple(r) for r in log().read().collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "w"), ("b", 1, "z"), ("c", 1, "v")]


def test_index_and_counters_follow_the_newest_state(spark, tmp_path):
    """Entry 1 is edited, 2 rejected, 3 approved after being classified, 4 rejected and approved
    again unchanged; old rows that come late, and repeated ones, do nothing."""
    from loamkit.functions.vectors import hashing_embedder

    schema = T.StructType.fromDDL("id long, project_id string, content string, status string, updated_at timestamp")
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    chunks = lambda: jobs.Log(spark, f"{tmp_path}/chunks", T.StructType.fromDDL("entry_id long, project_id string, chunk_index int, content string, embedding array<float>"))
    changes = lambda: jobs.Log(spark, f"{tmp_path}/changes", T.StructType.fromDDL("id long, action string"))
    moves = lambda: jobs.Log(spark, f"{tmp_path}/moves", T.StructType.fromDDL("project_id string, status string, n long"))
    batches = [
        [(1, "p", "one", "pending", at(0)), (2, "p", "two", "approved", at(0)), (3, "p", "three", "classifying", at(0)), (4, "p", "four", "approved", at(0))],
        [(1, "p", "new one", "approved", at(1)), (3, "p", "three", "approved", at(1)), (4, "p", "four", "rejected", at(1)), (1, "p", "one", "pending", at(0))],
        [(2, "p", "gone", "rejected", at(2)), (1, "p", "new one", "approved", at(3)), (4, "p", "four", "approved", at(2)), (3, "p", "late", "classifying", at(0))],
        [(3, "p", "three", "classifying", at(5))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        if n < 3:
            jobs.incremental_index(stream, chunks(), changes(), hashing_embedder(8), f"{tmp_path}/c1")
        jobs.live_entries(stream, moves(), f"{tmp_path}/c2")
        if n == 1:
            assert sorted(r.entry_id for r in jobs.indexed(chunks(), changes()).collect()) == [1, 2, 3]
            jobs.compact(chunks(), changes())
            assert chunks().read().count() == 3
    want = [(1, "new one"), (3, "three"), (4, "four")]
    assert sorted((r.entry_id, r.content) for r in jobs.indexed(chunks(), changes()).collect()) == want
    jobs.compact(chunks(), changes())
    assert sorted((r.entry_id, r.content) for r in chunks().read().collect()) == want
    # an approved entry is not classified again
    assert [(r.total, r.approved, r.rejected, r.classifying) for r in jobs.live_counts(moves()).collect()] == [(4, 3, 1, 0)]


def test_stream_classification_matches_batch(spark, sf, tmp_path):
    c = _candidates(spark, sf).where("id < 30").withColumn("project_id", F.lit("p"))
    c.where("id < 15").coalesce(1).write.parquet(f"{tmp_path}/in")
    c.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    none = T.StructType.fromDDL("project_id string, candidate_hash string, model string, prompt_version string, rules_version string, status string, semantic_score int")
    cache, out = jobs.Log(spark, f"{tmp_path}/cache", none), jobs.Log(spark, f"{tmp_path}/out", T.StructType.fromDDL("id long, final_score int, status string"))
    jobs.classify_stream(stream, cache, out, _judge, Settings(mode="enforce"), "m", "p", f"{tmp_path}/ckpt")
    batch, _ = classify.classify(c, spark.createDataFrame([], none), _judge, Settings(mode="enforce"), "m", "p")
    key = lambda df: sorted((r.id, r.final_score, r.status) for r in df.select("id", "final_score", "status").collect())
    assert key(out.read()) == key(batch)
    assert cache.read().groupBy("candidate_hash").count().where("count > 1").count() == 0


def test_staleness_alert_fires_after_the_watermark(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = T.StructType.fromDDL("id long, project_id string, status string, updated_at timestamp")
    stream = feed(spark, tmp_path, schema, [[(1, "p", "classifying", at(0)), (2, "p", "classifying", at(0))], [(2, "p", "pending", at(5))], [(3, "p", "classifying", at(60))], [(3, "p", "pending", at(61))]])
    alerts = jobs.staleness_alerts(stream)
    q = alerts.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.read.schema(alerts.schema).parquet(f"{tmp_path}/out").collect()] == [1]


def test_content_is_told_by_its_json_type(spark):
    from loamkit.functions import text as tx
    from loamkit.sources import files

    rows = [("f", 1, '{"type":"user","message":{"role":"user","content":"[INFO] up"}}'), ("f", 2, '{"type":"assistant","message":{"content":[{"type":"text","text":"yes"},{"type":"tool"}]}}')]
    got = files.transcript_events(spark.createDataFrame(rows, "path string, line long, value string")).collect()
    assert [(r.role, r.text) for r in got] == [("user", "[INFO] up"), ("assistant", "yes")]
    r = spark.range(1).select(tx.metadata_split(F.lit('{"a":"[x","b":[1],"c":{"d":1},"e":3,"f":null}')).alias("s")).first().s
    assert r.editable == {"a": "[x", "e": "3", "f": None} and r.machine == {"b": "[1]", "c": '{"d":1}'}


def test_session_without_reply_fails(spark):
    said = spark.createDataFrame([("a", "p", '[{"title": "T", "content": "C"}]'), ("b", "p", "[]"), ("c", "p", None)], "session_id string, project_id string, transcript string")
    have = spark.createDataFrame([], "project_id string, entry_id long, chunk_index int, embedding array<double>")
    _, runs = ingest.condense(said, lambda c: c, lambda c: F.array(F.lit(1.0), F.lit(0.5)), have, Settings())
    assert {r.session_id: (r.status, r.entries_created) for r in runs.collect()} == {"a": ("done", 1), "b": ("skipped", 0), "c": ("failed", 0)}


def test_metadata_keeps_its_other_keys(spark):
    from loamkit.operators.classify import with_key

    rows = [('{"a":[1,{"b":null}],"importance":{"old":1},"z":"q"}', '{"s":2}'), ("{}", "5"), (None, "{}"), ("no object", '"x"'), ('{"importance":3}', None)]
    got = [r.m for r in spark.createDataFrame(rows, "m string, v string").select(with_key(F.col("m"), "importance", F.col("v")).alias("m")).collect()]
    assert got == ['{"a":[1,{"b":null}],"z":"q","importance":{"s":2}}', '{"importance":5}', '{"importance":{}}', '{"importance":"x"}', '{"importance":3}']


def test_a_hub_is_walked_once(spark):
    """1000 seeds around one hub with 1000 more neighbours: a row an entity, not one a pair."""
    from loamkit.operators.graph import explore_once

    n = spark.range(1, 1001)
    relations = n.select(F.col("id").alias("subject_id"), F.lit(0).cast("long").alias("object_id")).union(n.select(F.lit(0).cast("long"), F.col("id") + 5000)).union(n.select("id", F.lit(0).cast("long")))
    out = explore_once(n.select(F.col("id").alias("seed"), F.col("id").alias("entity_id")), relations, 2)
    assert sorted((r.hop, r["count"]) for r in out.groupBy("hop").count().collect()) == [(0, 1000), (1, 1), (2, 1000)]
    assert {r["from"] for r in out.where("hop > 0").collect()} == {1}


def test_evaluation_runs_the_search_and_matches_titles(spark):
    """Titles match whatever their case, accents' form and white space; the first of equal ones counts."""
    from loamkit.operators.evaluate import evaluate_retrieval

    cases = spark.createDataFrame([(1, "x", ["Caf\u00e9 ", "Other"]), (2, "y", ["Nothing"])], "query_id long, terms string, expected_titles array<string>")
    asked = []

    def find(q):
        asked.append(q.columns)
        return spark.createDataFrame([(1, 0, "Else"), (1, 1, " cafe\u0301"), (1, 2, "CAF\u00c9"), (1, 3, "other")], "query_id long, rank int, title string")

    got = {r.query_id: r for r in evaluate_retrieval(cases, find, 3).collect()}
    assert asked == [["query_id", "terms"]]
    assert (got[1].recall, got[1].reciprocal_rank, got[1].zero_results) == (0.5, 0.5, False)
    assert (got[2].recall, got[2].reciprocal_rank, got[2].zero_results) == (0.0, 0.0, True)
    with pytest.raises(ValueError):
        evaluate_retrieval(cases, find, 11)
