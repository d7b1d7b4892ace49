"""kNN by bounded cells, and what lookups read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.library import Library
from lumenark.operators import vectors


def edges(df):
    return sorted((r.a, r.b, r.score) for r in df.collect())


@pytest.mark.parametrize("k, threshold", [(3, 0.9), (20, 0.42), (5, -1.0)])
def test_cells_give_the_same_edges(spark, k, threshold):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([c + 0.15 * rng.standard_normal((30, 16)) for c in centres] + [np.repeat(centres[:1], 25, 0), np.zeros((1, 16))])  # copies, and no direction
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "image_id bigint, vector array<double>").repartition(3)
    got = vectors.knn_by_cells(df, k, threshold, cells=12, part_rows=20)  # cells of several parts
    assert edges(got.edges) == edges(vectors.knn(df, k, threshold))
    assert got.made < got.pairs / 3 if threshold > 0 else got.made <= got.pairs
    assert vectors.knn_by_cells(df.limit(0)).edges.count() == 0
    if k == 3:
        assert edges(vectors.knn(df, k, threshold, broadcast_bytes=10)) == edges(got.edges)


@pytest.mark.parametrize("k", [4, 1000])
def test_blocks_of_cells_meet_without_copies(spark, monkeypatch, k):
    """Vectors are shuffled once, not for each pair of cells; several blocks of others a task, and several tasks."""
    monkeypatch.setattr(vectors, "HELD", 4 * 16 * 90)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    x = np.random.default_rng(6).standard_normal((240, 16)).astype(np.float32)
    x[100] = x[7] = x[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id bigint, vector array<float>").repartition(3)
    got = vectors.knn_by_cells(df, k, 0.1, cells=9, part_rows=30)
    u = vectors._unit(x)
    s = np.round(u @ u.T, vectors.PLACES)
    want = [(a, b) for a in range(240) for b in sorted((b for b in range(240) if b != a and s[a, b] >= 0.1), key=lambda b: (-s[a, b], b))[:k]]
    rows = got.edges.collect()
    assert sorted((r.a, r.b) for r in rows) == sorted(want)
    assert max(abs(r.score - s[r.a, r.b]) for r in rows) < 1e-11
    plan = got.edges._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan


def scanned(df):
    """Rows that the scans of a plan of one stage give."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectAsList()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_lookups_skip_row_groups(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib", buckets=2)
    small = {"parquet.block.size": "4096", "parquet.page.size.row.check.min": "50", "parquet.page.size.row.check.max": "50"}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in small.items():
        conf.set(k, v)
    try:
        n = 8000
        images = spark.range(n).select(F.col("id").alias("image_id"), F.concat(F.lit("/p/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"), F.md5(F.col("id").cast("string")).alias("content_hash"))
        faces = spark.range(n).select(F.col("id").alias("face_id"), (F.col("id") % 4000).alias("image_id"), (F.col("id") % 50).cast("int").alias("person_id"))
        lib.commit({"images": images, "faces": faces}, at=lib.snapshot())
    finally:
        for k in small:
            conf.unset(k)
    path = images.where("image_id = 77").first().path
    for where, rows in ((F.col("path") == path, 1), (F.col("content_hash") == "nothing", 0), (F.col("image_id") == 4321, 1)):
        df = lib.table("images", ("image_id", "path", "content_hash")).where(where)
        assert df.count() == rows and scanned(df) < n / 4, where
    df = lib.table("faces", ("face_id", "person_id")).where("person_id = 7")
    assert df.count() == 160 and scanned(df) < n / 4
    df = lib.table("faces", ("face_id",)).where("face_id = 123456")
    assert df.count() == 0 and scanned(df) < n / 4
