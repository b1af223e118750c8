import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from loamkit.functions.stem import stem, stemmer
from loamkit.operators import term_index as ti

ENTRY = "id long, project_id string, title string, content string, category string, status string"
TAG = "entry_id long, name string"
PROJECTS = [("en", "en-GB"), ("es", "es"), ("none", None)]
ROWS = [
    (1, "en", "Walking on walls", "the walkers walked and the walls stood", "pattern", "approved"),
    (2, "en", None, "walls of the city", "decision", "approved"),
    (3, "es", "Los muros", "los muros de la ciudad", "pattern", "approved"),
    (4, "gone", "The city", None, "pattern", "approved"),
    (5, "none", "", "", "pattern", "approved"),
    (6, "en", "Walls", "walls walls", "pattern", "pending"),
]
TAGS = [(2, "city"), (2, "brick"), (2, "brick"), (3, "the")]


@pytest.fixture
def made(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    ti.create(spark, path)
    return path, spark.createDataFrame(ROWS, ENTRY), spark.createDataFrame(TAGS, TAG), spark.createDataFrame(PROJECTS, "id string, language string")


def held(spark, path):
    return sorted((r.entry_id, r.term, r.tf, r.len) for r in ti.postings(spark, path).collect())


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, text string, project_id string, category string")


def test_stop_words_are_those_of_spark(spark):
    for config in ti.CONFIGS:
        whole = {w for w in StopWordsRemover.loadDefaultStopWords(config) if w.isalnum()}
        assert whole <= set(ti.stop_words(config))


def test_terms_of_title_content_and_tags_by_language(spark, made):
    path, e, tags, projects = made
    ti.update(path, e, tags, projects)
    got = held(spark, path)
    assert [g for g in got if g[0] == 2] == [(2, "brick", 1, 4), (2, "city", 2, 4), (2, "walls", 1, 4)]
    assert [g[1] for g in got if g[0] == 3] == ["ciudad", "muros", "the"]  # an English stop word is none in Spanish
    assert [g[1] for g in got if g[0] == 4] == ["city"]
    assert ti.statistics(spark, path) == (6.0, sum({g[0]: g[3] for g in got}.values()) / 6)


def test_stemmed_search_is_bm25(spark, made):
    path, e, tags, projects = made
    ti.update(path, e, tags, projects, stemmer())
    queries = ti.query_terms(asked(spark, [(1, "a walking wall", None, None), (2, "walls", "en", "decision"), (3, "muro", "es", None), (4, "the", None, None), (5, None, None, None)]), projects, stemmer())
    got = {(r.query_id, r.entry_id): r.score for r in ti.find(spark, path, queries, e).collect()}
    words = {1: "walking walls walkers walked walls stood", 2: "walls city brick city", 4: "city", 5: "", 6: "walls walls walls"}
    docs = {i: [stem(w, "english") for w in t.split()] for i, t in words.items()} | {3: [stem(w, "spanish") for w in "muros muros ciudad the".split()]}
    mean = sum(map(len, docs.values())) / len(docs)

    def score(i, query):
        tf, out = Counter(docs[i]), 0.0
        for t in query:
            df = sum(t in d for d in docs.values())
            out += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
        return out

    want = {(1, 1): score(1, ["walk", "wall"]), (2, 2): score(2, ["wall"]), (3, 3): score(3, ["mur"])}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_updates_equal_a_new_index(spark, made, tmp_path):
    path, e, tags, projects = made
    old = e.withColumn("content", F.concat_ws(" ", F.lit("former words"), "content"))
    ti.update(path, old, tags, projects.withColumn("language", F.lit("en")))
    ti.update(path, e.where("id <> 6"), tags, projects, removed=e.where("id = 6").select("id"))
    fresh = f"file://{tmp_path}/fresh"
    ti.create(spark, fresh)
    ti.update(fresh, e.where("id <> 6"), tags, projects)
    assert held(spark, path) == held(spark, fresh) and ti.statistics(spark, path) == ti.statistics(spark, fresh)
    ti.compact(spark, path, f"{path}/small")
    assert held(spark, f"{path}/small") == held(spark, fresh)
    ti.update(f"{path}/small", e, tags, projects)
    assert {g[0] for g in held(spark, f"{path}/small")} == {1, 2, 3, 4, 6}


def test_half_an_update_is_not_seen(spark, made, monkeypatch):
    path, e, tags, projects = made
    ti.update(path, e, tags, projects)
    before = held(spark, path)
    put = ti._put

    def fails(rows, where):
        put(rows, where)
        raise OSError("lost")

    monkeypatch.setattr(ti, "_put", fails)
    with pytest.raises(OSError, match="lost"):
        ti.update(path, e.withColumn("content", F.lit("other")), tags, projects)
    monkeypatch.undo()
    assert held(spark, path) == before
    ti.update(path, e.limit(0), tags, projects)
    assert held(spark, path) == before


def test_an_empty_index_finds_nothing(spark, made):
    path, e, _, projects = made
    queries = ti.query_terms(asked(spark, [(1, "walls", None, None)]), projects)
    assert ti.find(spark, path, queries, e).count() == 0 and ti.statistics(spark, path) == (0.0, 1.0)


def test_queries_are_found_where_the_jars_of_spark_lie_elsewhere(tmp_path):
    code = f"import pyspark; pyspark.__file__ = {str(tmp_path / '__init__.py')!r}; import __spark_entry__ as e; print(len(e.queries()))"
    root = Path(ti.__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    assert int(out.stdout) > 100
