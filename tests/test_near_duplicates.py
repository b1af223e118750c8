import numpy as np

from loamkit.operators import search

CHUNK = "entry_id long, chunk_index int, project_id string, embedding array<double>"


def test_grid_equals_brute_force_and_splits_a_hot_project(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(900, 8))
    vectors[500:520] = vectors[3]
    project = ["hot" if i % 3 else f"p{i % 7}" for i in range(900)]
    rows = [(i, 0, project[i], vectors[i].tolist()) for i in range(900)]
    odd = [(1000, 0, "hot", None), (1001, 0, "hot", [0.0] * 8), (1002, 0, "hot", [1.0, None] * 4), (1003, 0, "hot", [1.0]), (1004, 0, None, [1.0] * 8), (1005, 0, "hot", [float("nan")] * 8)]
    chunks = spark.createDataFrame(rows + odd, CHUNK)
    asked = chunks.where("entry_id % 5 = 0 OR entry_id >= 1000").withColumnRenamed("entry_id", "query_id").withColumn("entry_id", search.F.col("query_id")).drop("chunk_index")
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for block in (50, 4096):
        got = {r.query_id: (r.best, r.duplicate) for r in search.near_duplicates(asked, chunks, 0.6, block, own="entry_id").collect()}
        assert set(got) == set(range(0, 900, 5)) | set(range(1000, 1006))
        for q, (best, duplicate) in got.items():
            near = max([round(float(units[q] @ units[j]), 9) for j in range(900) if j != q and project[j] == project[q]], default=-1) if q < 900 else -1
            assert duplicate == (near >= 0.6) and (best is None if near < 0.6 else abs(best - near) < 1e-8), q
    assert search.near_duplicates(asked.where("query_id = 1003"), chunks).collect()[0].duplicate
    none = search.near_duplicates(asked.limit(0), chunks.limit(0))
    assert none.count() == 0 and none.columns == ["query_id", "best", "duplicate"]
