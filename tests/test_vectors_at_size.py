"""Products of vectors by tiles, the cell search by groups, rounding as SQL does."""

import math

import numpy as np
from pyspark.sql import functions as F

from lumenark.operators import vectors as V


def test_negative_zero_is_kept(spark):
    df = spark.createDataFrame([([-1e-9, 1e-9, -0.0, 0.0, -0.1234565, 0.5],)], "v array<double>")
    got = df.select(F.transform("v", lambda x: V.rounded(x, 6))).first()[0]
    assert got == [0.0, 0.0, 0.0, 0.0, -0.123457, 0.5]
    assert [math.copysign(1, x) for x in got] == [-1, 1, -1, 1, -1, 1]


def test_tiles_give_the_whole_product(monkeypatch):
    x = V._unit(np.random.default_rng(3).normal(size=(300, 5)))
    x[7] = x[250] = x[100]  # ties across tiles
    ids = np.arange(300)
    whole = V._best(ids, x, ids, x, 4, 0.1)
    monkeypatch.setattr(V, "BLOCK", 16)
    pieces = list(V._pieces(ids, x, ids, x, 4, 0.1))
    got = {tuple(r) for p in pieces for r in p[["a", "b"]].itertuples(index=False)}
    assert got == {tuple(r) for r in whole[["a", "b"]].itertuples(index=False)} and len(got) == 1200
    full = list(V._pieces(ids, x, ids, x, 1 << 30, 0.1))  # nothing is held
    sizes = [len(p) for p in full]
    assert max(sizes) <= 16 * 16 and sum(sizes) == int((np.round(x @ x.T, 12) >= 0.1).sum()) - 300


def test_search_by_groups_is_the_search_of_each_query(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 25)  # several groups of cells and of queries
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "image_id bigint, vector array<float>")
    index, asked = V.CellIndex(spark, df, cells=9), df.where("image_id % 5 = 0")
    got = {}
    for r in index.search_all(asked, 6, 3).orderBy("query_id", F.desc("score"), "image_id").collect():
        got.setdefault(r.query_id, []).append(r.image_id)
    assert len(got) == 80
    for r in asked.limit(3).collect():
        assert got[r.image_id] == [x.image_id for x in index.search(list(r.vector), 6, 3, exclude=r.image_id).collect()]
