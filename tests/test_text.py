import math

import pytest
from pyspark.sql import functions as F

from loamkit.functions import replies, rules, vectors
from loamkit.functions import text as tx
from loamkit.operators import evaluate, filters, graph, ingest, projects, search
from loamkit.schemas import Settings
from loamkit.sources import files, legacy, tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def packed(spark, text, limit):
    return [c["content"] for c in one(spark, text, lambda c: tx.chunks(c, limit))]


def test_chunking(spark):
    assert packed(spark, "  \n ", 0) == [] and packed(spark, None, 0) == []
    assert packed(spark, "a\n\nb\n \nc", 0) == ["a", "b", "c"]
    assert packed(spark, "aaaa\n\nbbbb\n\ncccc", 11) == ["aaaa\n\nbbbb", "cccc"]
    assert packed(spark, "aaaa\n\nbbbb", 9) == ["aaaa", "bbbb"]  # the open chunk counts its blank line
    assert packed(spark, "éé\n\nbb", 7) == ["éé", "bb"]  # bytes, not characters
    assert packed(spark, "# H", 0) == []
    assert packed(spark, "# One\n\na\n\n## Two\n\nb", 100) == ["## Two\n\na\n\nb"]
    assert packed(spark, "# One\n\na\n\n## Two\n\nb", 0) == ["## Two\n\na", "## Two\n\nb"]  # the heading in force when a chunk closes
    assert packed(spark, "# One\nmore", 0) == ["# One\nmore"]


def test_markdown_sections(spark):
    split = lambda t: [(s["title"], s["content"]) for s in one(spark, t, tx.sections)]
    assert split("lost\n# A\nx\n## B\ny\n### C\nz\n# D\n\n## E\nw") == [("A", "x"), ("A / B", "y\n### C\nz"), ("D / E", "w")]
    assert split("## B\ny") == [("B", "y")]
    assert split("no headings\r\nhere") == [("Imported Document", "no headings\r\nhere")]
    assert split("# A\n# B\n") == [("Imported Document", "# A\n# B\n")]


def test_normalised(spark):
    assert one(spark, " a\t b \r\n c\r\n\n\n\nd \0\n", tx.normalised) == "a b\nc\n\nd"


@pytest.mark.parametrize(
    "title,content,tags,want",
    [
        ("Session scratch", "--- *** ### ---", [], "366b606df75af5f6013e14548cbc354ffd4e42ad910f086ad1a3b995d8cd0feb"),
        ("Snippet", "```\n\n```", [], "ef5a2be763df5346792579f2ea3948af82925a987ebe8f710a019d24c94b523a"),
        ("Deployment notes", "TBD", ["deployment"], "b800137fbcfef32ad1e7d80157dc8612be5ebf034f2841ab3f05952643f9334e"),
    ],
)
def test_candidate_hash_golden(spark, title, content, tags, want):
    kind = "title string, content string, category string, source string, tags array<string>, entities array<struct<name:string,type:string>>, relations array<struct<subject:string,predicate:string,object:string>>"
    df = spark.createDataFrame([(title, content, {"Session scratch": "insight", "Snippet": "insight"}.get(title, "documentation"), "condense" if title == "Session scratch" else "mcp", tags, [], [])], kind)
    assert df.select(tx.candidate_hash(F.struct(*df.columns)).alias("h")).first()["h"] == want


def judged(spark, title, content, entities=()):
    df = spark.createDataFrame([(title, content, [(e, "") for e in entities])], "t string, c string, e array<struct<name:string,type:string>>")
    r = df.select(rules.evaluate(F.col("t"), F.col("c"), F.col("e")).alias("r")).first()["r"]
    return r["vetoed"], r["adjustment"], [x["id"] for x in r["rules"]]


@pytest.mark.parametrize(
    "title,content,want",
    [
        ("A", "--- ***", ["empty_content"]),
        ("A", " TBD. ", ["placeholder_only"]),
        ("A", "Why is it so? And (how)?", ["unanswered_question"]),
        ("Note", "I ran the tests.", ["agent_operation_only"]),
        ("Ran the tests", "Done.\n- All tests pass, everything is green", ["agent_operation_only"]),
        ("Nota", "Vou executar os testes", ["agent_operation_only"]),
        ("Note", "Let me check the logs", ["agent_operation_only"]),
    ],
)
def test_vetoes(spark, title, content, want):
    assert judged(spark, title, content) == (True, -100, want)


@pytest.mark.parametrize(
    "title,content",
    [
        ("The worker restarts", "I checked the logs."),
        ("Note", "I checked the logs (the worker restarts on every deploy)."),
        ("Note", "I ran the tests because they fail."),
        ("Note", "Let's Encrypt certificates renew 30 days before expiry."),
        ("A", "Why? It is so."),
    ],
)
def test_no_veto(spark, title, content):
    assert not judged(spark, title, content)[0]


def test_signals(spark):
    text = "We decided that the queue must stay in Redis because otherwise jobs are lost on every single deploy of app.py."
    assert judged(spark, "Queue", text) == (False, 22, ["explicit_decision", "normative_restriction", "causal_rationale", "actionable_consequence"])
    assert judged(spark, "Queue", "maybe it works for now") == (False, -38, ["speculative_language", "generic_without_context", "transient_status", "insufficient_substance"])
    assert "generic_without_context" not in judged(spark, "Queue", "maybe it works", ["Redis"])[2]
    assert judged(spark, "X", "mustard " * 12)[2] == ["generic_without_context"]


def test_scores(spark):
    df = spark.createDataFrame([(90, False, 22), (90, True, -100), (5, False, -8), (60, False, 6)], "s int, v boolean, a int")
    assert [r[0] for r in df.select(rules.final_score(F.col("s"), F.col("v"), F.col("a"))).collect()] == [100, 0, 0, 66]
    d = spark.createDataFrame([(90, [(6,)]), (90, [(6,), (-8,)]), (90, []), (10, [(6,)]), (None, [(6,)])], "s int, r array<struct<adjustment:int>>")
    assert [r[0] for r in d.select(rules.eligible(F.col("s"), F.col("r"), 90)).collect()] == [True, False, False, False, False]
    assert not d.select(rules.eligible(F.col("s"), F.col("r"), None).alias("e")).where("e").count()


GOOD = '{"durability":25,"actionability":20,"specificity":20,"non_obviousness":20,"future_value":15,"recommended_verdict":"important","reasons":[{"criterion":"durability","explanation":"x"}]}'


@pytest.mark.parametrize(
    "raw,error",
    [
        (GOOD, None),
        ("nope", "invalid_json"),
        ("[1]", "invalid_schema"),
        (GOOD.replace("25", "26"), "invalid_schema"),
        (GOOD.replace(":20,", ":20.0,", 1), "invalid_schema"),
        (GOOD.replace("25", '"25"'), "invalid_schema"),
        (GOOD.replace("important", "maybe"), "invalid_schema"),
        (GOOD.replace('"reasons"', '"reason"'), "invalid_schema"),
        (GOOD.replace("}]}", "}],\"more\":1}"), "invalid_schema"),
        (GOOD.replace('[{"criterion":"durability","explanation":"x"}]', "[]"), "invalid_schema"),
        (GOOD.replace('"x"', '"' + "x" * 281 + '"'), "invalid_schema"),
        (GOOD.replace('"criterion":"durability"', '"criterion":"luck"'), "invalid_schema"),
    ],
)
def test_assessment_reply(spark, raw, error):
    got = one(spark, raw, replies.assessment)
    assert got["error_code"] == error and got["semantic_score"] == (100 if error is None else None)


def test_candidates_reply(spark):
    raw = 'Sure:\n[{"title":" A ","content":"c","category":"odd","entities":[{"name":" N "},{"name":""}],"relations":[{"subject":"s","predicate":"p","object":"o"},{"subject":"s"}]},{"title":"","content":"x"},5,{"title":"B","content":"d","category":"constraint"}] ok'
    got = one(spark, raw, replies.candidates)
    assert [(c["title"], c["category"]) for c in got] == [("A", "insight"), ("B", "constraint")]
    assert [e["name"] for e in got[0]["entities"]] == ["N"] and len(got[0]["relations"]) == 1
    assert one(spark, "none", replies.candidates) == []


def test_fences_and_envelopes(spark):
    assert one(spark, "```json\n{}\n```", replies.unfenced) == "{}"
    assert one(spark, "```\na\n```\nb\n```\n", replies.unfenced) == "```\na\n```\nb\n```"
    assert one(spark, '{"subtype":"success","result":"r"}', replies.envelope)["result"] == "r"
    assert one(spark, '{"subtype":"success","is_error":true,"result":"r"}', replies.envelope)["error_code"] == "process_error"


def test_small_text_functions(spark):
    assert [one(spark, p, tx.slug) for p in ("/a/My App_2/", "/x/Ünï", "///", "/a/!!")] == ["my-app-2", "uni", "project", "project"]
    assert [one(spark, c, tx.text_config) for c in ("pt_BR", "PT", "pty", "es-MX", None)] == ["portuguese", "portuguese", "english", "spanish", "english"]
    assert one(spark, "a, ,b ", tx.csv_list) == ["a", "b"]
    assert [tuple(t) for t in one(spark, ["s:p:o:x", "a:b", "a::c"], tx.triples, "array<string>")] == [("s", "p", "o:x")]
    assert one(spark, " PT_br", lambda c: tx.language_code(c, ["en", "pt-BR"])) == "pt-BR"
    got = one(spark, ["PHP ", "cobol", "php", ""], lambda c: tx.technologies(c, ["php"]), "array<string>")
    assert (got["technologies"], got["unknown"]) == (["php", "other"], ["cobol"])
    assert one(spark, "Café ", lambda c: tx.nfc_title()(c)) == "café"
    assert one(spark, "Say hello to the World", lambda c: tx.snippet(c, F.array(F.lit("world")))) == "Say hello to the <b>World</b>"


def test_settings():
    Settings()
    for bad in ({"mode": "x"}, {"threshold": 101}, {"auto_approve_threshold": 10}, {"dedup_score": 2}, {"max_transcript_chars": 5}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([0.0, 0.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.6) < 1e-6 and got[1:] == [None, None]


def test_fusion_and_order(spark):
    v = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id long, entry_id long, rank int")
    k = spark.createDataFrame([(1, 10, 0), (1, 12, 1)], "query_id long, entry_id long, rank int")
    fused = {r.entry_id: r for r in search.fuse(v, k).collect()}
    assert math.isclose(fused[10].fusion, 2 / 60) and fused[10].matched_by == ["vector", "keyword"]
    assert [r.entry_id for r in search.limited(search.fuse(v, k).select("query_id", "entry_id", "fusion", "matched_by")).orderBy("rank").collect()] == [10, 11, 12]


def test_graph_parent_is_first_in_walking_order(spark):
    fused = spark.createDataFrame([(1, 1, 0.010, ["vector"], 0), (1, 2, 0.033, ["vector", "keyword"], 1)], "query_id long, entry_id long, fusion double, matched_by array<string>, iter_order int")
    ee = spark.createDataFrame([(1, 100), (2, 100), (3, 200)], "entry_id long, entity_id long")
    rel = spark.createDataFrame([(100, 200)], "subject_id long, object_id long")
    got = {r.entry_id: r.fusion for r in search.expand_graph(fused, ee, rel).collect()}
    assert math.isclose(got[3], 0.003) and len(got) == 3


def test_best_chunk_and_zero_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(1, 0, [0.8, 0.6]), (1, 1, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, [0.0, 1.0]), (4, 0, [1.0, 0.0])], "entry_id long, chunk_index int, embedding array<float>")
    e = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    got = [(r.entry_id, r.chunk_index, r.rank) for r in search.vector_search(q, c, e, 20).orderBy("rank").collect()]
    assert got == [(1, 1, 0), (4, 0, 1)]
    assert search.vector_search(q, c, e, 1).count() == 1


def test_metrics_golden(spark):
    cases = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id long, key string")
    results = spark.createDataFrame([(1, "noise", 1), (1, "b", 2), (1, "a", 3), (1, "a", 1 + 3)], "query_id long, key string, position int")
    got = {r.query_id: r for r in evaluate.retrieval_metrics(cases, results, 3).collect()}
    want = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert (got[1].recall, got[1].reciprocal_rank) == (1.0, 0.5) and abs(got[1].ndcg - want) < 1e-8 and not got[1].zero_results
    assert (got[2].recall, got[2].ndcg, got[2].zero_results) == (0.0, 0.0, True)
    assert not evaluate.retrieval_summary(spark.createDataFrame(list(got.values()))).first()["passes"]


def test_explore(spark):
    rel = spark.createDataFrame([(1, 1, 2), (2, 3, 2), (3, 3, 4), (4, 4, 5)], "id long, subject_id long, object_id long")
    seeds = spark.createDataFrame([("s", 1), ("none", 99)], "seed string, entity_id long")
    near = {(r.seed, r.entity_id) for r in graph.explore(seeds, rel, 1)[0].collect()}
    far, walked = graph.explore(seeds, rel, 9)
    assert near == {("s", 1), ("s", 2), ("none", 99)}
    assert {(r.seed, r.entity_id) for r in far.collect()} == near | {("s", 3)} and {r.id for r in walked.collect()} == {1, 2}


def test_find_or_create(spark):
    have = spark.createDataFrame([(5, "p", "Redis", "tool"), (9, "p", "Redis", "cache")], "id long, project_id string, name string, type string")
    want = spark.createDataFrame([("p", "Redis", None), ("p", "Redis", "tool"), ("p", "Redis", "new"), ("p", "Kafka", "tool"), ("p", "Kafka", None), ("p", "Lone", "")], "project_id string, name string, type string")
    got = {(r.name, r.type): (r.id, r.created) for r in graph.find_or_create_entities(want, have).collect()}
    assert got["Redis", ""] == (5, False) and got["Redis", "tool"] == (5, False) and got["Redis", "new"][1]
    assert got["Kafka", ""] == (got["Kafka", "tool"][0], False) and got["Lone", ""][1]
    new = [i for i, made in got.values() if made]
    assert len(new) == len(set(new)) and min(new) > 9


def test_resolve_projects(spark):
    req = spark.createDataFrame([(1, "x", None, "/a/b"), (2, None, "r", "/a/b"), (3, None, None, "/a/b/c/"), (4, None, None, "/a/bc"), (5, None, None, "/w/App"), (6, " ", "", "/no/where"), (7, None, None, "/a_c/d")], "request_id long, explicit_id string, route_id string, cwd string")
    paths = spark.createDataFrame([("/a", "pa"), ("/a/b/", "pb"), ("/a%", "odd"), ("/axc", "wild")], "path string, project_id string")
    known = spark.createDataFrame([("app",)], "id string")
    got = {r.request_id: (r.project_id, r.via) for r in projects.resolve_projects(req, paths, known).collect()}
    assert got == {1: ("x", "explicit"), 2: ("r", "route"), 3: ("pb", "path"), 4: ("pa", "path"), 5: ("app", "slug"), 6: (None, None), 7: (None, None)}


def test_filters(spark):
    e = spark.createDataFrame([(1, "p", True), (2, "p", False), (3, "q", None)], "id long, project_id string, flag boolean")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(e.where(filters.auto_approved(F.col("flag"), False))) == [2, 3] and ids(e.where(filters.flag_is(F.col("flag"), False))) == [2]
    assert ids(filters.entry_filter(e, " ")) == [1, 2, 3] and ids(filters.entry_filter(e, "q")) == [3]
    got = one(spark, [("a", "x"), (" ", "y")], lambda c: filters.valid_items(c, ["n", "t"]), "array<struct<n:string,t:string>>")
    assert len(got["items"]) == 1 and got["skipped"] == 1


def test_transcripts(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type":"user","message":{"role":"user","content":"hi"}}\n\nnot json\n{"type":"system","message":{"role":"system","content":"no"}}\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool","text":"t"},{"type":"text","text":"b"}]}}\n')
    got = files.flatten_transcript(files.read_transcripts(spark, str(tmp_path))).first()["transcript"]
    assert got == "USER: hi\n\nASSISTANT: a\nb"


def test_documents_and_eval_set(spark, tmp_path):
    for name, body in (("a.MD", "# T\nbody"), ("b.txt", "plain"), ("c.pdf", "x")):
        (tmp_path / name).write_text(body)
    docs, bad = files.read_documents(spark, str(tmp_path))
    got = {(r.title, r.content) for r in ingest.import_documents(docs, "p").collect()}
    assert got == {("T", "body"), ("b.txt", "plain")} and bad.count() == 1
    (tmp_path / "e.json").write_text('{"project_id":" p ","queries":[{"query":" q ","expected_titles":["t"," "]},{"query":"","expected_titles":["t"]},{"query":"x","expected_titles":[" "]}]}')
    assert [(r.query, r.valid) for r in files.read_eval_set(spark, str(tmp_path / "e.json")).orderBy("query_id").collect()] == [("q", True), ("", False), ("x", False)]
    assert files.read_calibration_corpus(spark, str(tmp_path / "missing.json")) is None


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.invalidate_on_model_change(old, ("p", "m", 2), ("p", "n", 2), 2)[0].count() == 0
    with pytest.raises(ValueError):
        tables.invalidate_on_model_change(old, None, ("p", "n", 3), 2)


def test_legacy(spark):
    have = spark.createDataFrame([(4, "p", "x")], "id long, project_id string, name string")
    old = spark.createDataFrame([("u1", "p", "x"), ("u2", "p", "y"), ("u3", "p", "y")], "uuid string, project_id string, name string")
    ids, fresh = legacy.id_map(old, have, ["project_id", "name"])
    got = {r.uuid: r.id for r in ids.collect()}
    assert got["u1"] == 4 and got["u2"] == got["u3"] > 4 and fresh.count() == 1
    dep = spark.createDataFrame([("u1",), ("gone",)], "entity string")
    assert [r.entity for r in legacy.remap(dep, {"entity": ids}).collect()] == [4]


def test_store_entries(spark):
    kind = "project_id string, title string, content string, category string, source string, tags array<string>, entities array<struct<name:string,type:string>>, relations array<struct<subject:string,predicate:string,object:string>>"
    c = spark.createDataFrame([("p", "t", "c", "insight", "mcp", ["x", "x", ""], [("Redis", "tool")], [("Redis", "stores", "Jobs")])], kind)
    from loamkit.schemas import schema

    kb = {t: spark.createDataFrame([], schema(t)) for t in ("entries", "tags", "entities", "relations")}
    got = {t: df.collect() for t, df in ingest.store_entries(c, kb, "shadow").items()}
    assert {t: len(r) for t, r in got.items()} == {"entries": 1, "tags": 1, "entry_tags": 1, "entities": 2, "entry_entities": 1, "relations": 1}
    assert got["entries"][0].status == "classifying"
