"""The inverted file: exact with all cells, recall and pruning with few, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.dense_index import ALL, DenseIndex, centroids

VEC = "vec_id long, embedding array<float>, extra string"


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.35 * rng.normal(size=(3000, 24))
    rows = spark.createDataFrame([(i, v.tolist(), f"e{i}") for i, v in enumerate(x)], VEC).repartition(6).cache()
    index = DenseIndex(spark, f"file://{tmp_path_factory.mktemp('dense')}")
    index.build(rows, "vec_id", "embedding", cells=48)
    return rows, index


def asked(rows):
    return rows.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))


def test_all_cells_are_the_exact_search(spark, clustered):
    rows, index = clustered
    want = search.knn(asked(rows), rows, 40, "q_vec", "embedding", "query_id", "vec_id")
    got = index.search(asked(rows), "query_id", "q_vec", "vec_id", "embedding", 40, ALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recall_with_the_measured_probes(spark, clustered):
    rows, index = clustered
    probes = index.quantiser()[1]
    assert probes <= 24, "on clustered vectors half of the cells are more than enough"
    want = search.knn(asked(rows), rows, 40, "q_vec", "embedding", "query_id", "vec_id").select("query_id", "vec_id")
    got = index.search(asked(rows), "query_id", "q_vec", "vec_id", "embedding").select("query_id", "vec_id")
    assert want.join(got, ["query_id", "vec_id"], "left_semi").count() >= 0.9 * want.count()


def test_a_search_reads_only_the_cells_it_probes(spark, clustered):
    rows, index = clustered
    one = asked(rows).filter("query_id = 60")
    plan = index.search(one, "query_id", "q_vec", "vec_id", "embedding", 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell#" in plan.split("PartitionFilters")[1][:80]
    read = index.search(one, "query_id", "q_vec", "vec_id", "embedding", 5, 2)
    assert read.count() == 5
    assert index.lists.read().select("cell").distinct().count() > 30


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "b"), (3, [], "c"), (4, [1.0, 2.0, 3.0], "d"), (None, [0.0, 1.0], "e"), (5, [0.0, 0.0], "f"), (6, [0.0, None], "g")], VEC)
    index = DenseIndex(spark, f"file://{tmp_path}/odd")
    index.build(rows, "vec_id", "embedding")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id long, q_vec array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in index.search(q, "query_id", "q_vec", "vec_id", "embedding", 10, ALL).collect()}
    assert got[0, 1] == 1.0 and got[0, None] == 0.0 and got[0, 4] == 0.0 and got[1, 1] == 0.0
    assert len(index.search(q, "query_id", "q_vec", "vec_id", "embedding", 10, ALL).collect()) == 16
    empty = DenseIndex(spark, f"file://{tmp_path}/none")
    empty.build(rows.limit(0), "vec_id", "embedding")
    assert empty.search(q, "query_id", "q_vec", "vec_id", "embedding").count() == 0


def test_centroids_of_few_and_equal_rows():
    assert centroids(np.zeros((0, 3)), 4).shape == (0, 3)
    assert len(centroids(np.array([[1.0, 0.0]] * 5), 3)) == 3
    x = np.vstack([np.eye(4)[i % 4] + 0.01 for i in range(40)])
    at = centroids(x, 4)
    assert sorted((at @ np.eye(4)).argmax(axis=1).tolist()) == [0, 1, 2, 3]


def test_embedding_bounds_the_batches_of_a_worker(spark):
    """Without a bound a Python worker holds 10,000 texts of any length at once."""
    from textloom.embedders import HashingEmbedder, ModelEmbedder

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for embedder in (HashingEmbedder(8), ModelEmbedder(lambda: lambda texts: [[0.0]] * len(texts), 1)):
        spark.conf.unset(name)
        assert embedder.embed(spark.createDataFrame([("a",)], "t string"), "t", "v").count() == 1
        assert spark.conf.get(name) == "8m"
