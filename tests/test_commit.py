import pytest
from pyspark.sql import DataFrameWriter

from loamkit.operators import ingest

CANDIDATE = "project_id string, title string, content string, category string, source string, tags array<string>, entities array<struct<name:string,type:string>>, relations array<struct<subject:string,predicate:string,object:string>>"
ROW = ("p", "t", "c", "insight", "cli", ["a", "b", ""], [("x", "kind"), ("y", None)], [("x", "uses", "z")])


def held(spark, path):
    return {t: sorted(map(tuple, df.collect()), key=repr) for t, df in ingest.read_committed(spark, path).items()}


def test_commits_appear_whole(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/kb"
    ingest.create_store(spark, path)
    tied = spark.createDataFrame([ROW] * 3, CANDIDATE)
    ingest.commit_entries(tied, path, "shadow")
    first = held(spark, path)
    ids = {r[0] for r in first["entries"]}
    assert len(first["entries"]) == len(ids) == 3 and {r[2] for r in first["tags"]} == {"a", "b"}
    assert {r[0] for r in first["entry_tags"]} == {r[0] for r in first["entry_entities"]} == {r[5] for r in first["relations"]} == ids
    assert {r[2:] for r in first["entities"]} == {("x", "kind"), ("y", ""), ("z", "")}

    write = DataFrameWriter.parquet

    def fails(self, where, *args, **kw):
        if where.endswith("/relations"):
            raise OSError("lost")
        write(self, where, *args, **kw)

    monkeypatch.setattr(type(tied.write), "parquet", fails)
    with pytest.raises(OSError, match="lost"):
        ingest.commit_entries(tied, path, "shadow")
    monkeypatch.undo()
    assert held(spark, path) == first
    ingest.commit_entries(tied.limit(1), path, "off")
    again = held(spark, path)
    assert len(again["entries"]) == 4 and again["tags"] == first["tags"] and again["entities"] == first["entities"] and len(again["relations"]) == 4
    ingest.commit_entries(tied.limit(0), path, "off")
    assert held(spark, path) == again
