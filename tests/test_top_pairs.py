"""The best pairs of rows, and suggestions that take more of them only when vetoes leave too few."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.operators import identity, vectors


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal((90, 6)), np.repeat(rng.standard_normal((1, 6)), 6, 0)])  # copies: many ties
    return v, spark.createDataFrame([(i, f"n{i}", x.tolist(), i % 11 == 5) for i, x in enumerate(v)], "person_id int, name string, centroid array<float>, hidden boolean")


def brute(v, keep, threshold):
    x = np.stack([np.float32(r).astype(float) for r in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, vectors.PLACES)
    return sorted(((-s[a, b], a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if keep(a) and keep(b) and s[a, b] >= threshold))


@pytest.mark.parametrize("bytes_", [vectors.BROADCAST_BYTES, 2000])  # one block, and many
@pytest.mark.parametrize("n", [1, 10, 40, 100_000])
def test_top_pairs(people, bytes_, n):
    v, df = people
    got = [(r.a, r.b) for r in vectors.top_pairs(df.repartition(3), n, 0.3, "person_id", "centroid", bytes_).collect()]
    assert got == [(a, b) for _, a, b in brute(v, lambda i: True, 0.3)][:n]


def test_suggestions_go_on_past_vetoes(spark, people, monkeypatch):
    v, df = people
    want = brute(v, lambda i: i % 11 != 5, identity.CLUSTER)
    dismissed = [(a, b) for _, a, b in want[:45]]  # more than the first try takes
    together = [(a, b) for _, a, b in want[45:60:2]]
    images = spark.createDataFrame([(i, [a, b]) for i, (a, b) in enumerate(together)] + [(1000, []), (1001, None)], "image_id bigint, people_ids array<int>")
    taken = []
    top = vectors.top_pairs
    monkeypatch.setattr(vectors, "top_pairs", lambda rows, n, *a: taken.append(n) or top(rows, n, *a))
    got = identity.merge_suggestions(df, images, limit=5, dismissed=spark.createDataFrame(dismissed, "a bigint, b bigint")).collect()
    left = [(a, b) for _, a, b in want if (a, b) not in dismissed and (a, b) not in together][:5]
    assert {frozenset((r.source_id, r.target_id)) for r in got} == {frozenset(p) for p in left} and taken == [40, 320]
    assert identity.merge_suggestions(df.limit(0), images, limit=5).count() == 0
    assert identity.merge_suggestions(df, images, limit=5).where(F.col("score") < identity.CLUSTER).count() == 0


@pytest.mark.parametrize("few", [identity.FEW, 3])  # candidates as constants, and joined
def test_only_candidates_are_looked_up(spark, people, monkeypatch, few):
    """Filters for candidates reach the tables that photos and dismissed pairs are joined from, and no other photos are counted."""
    v, df = people
    monkeypatch.setattr(identity, "FEW", few)
    want = brute(v, lambda i: i % 11 != 5, identity.CLUSTER)
    ids = spark.range(len(v)).select(F.col("id").alias("p"), F.pmod("id", F.lit(3)).alias("r"))
    later = ids.select(F.col("p").alias("b"), "r")
    photos = ids.join(F.broadcast(later), "r").where("p < b AND p % 7 = 0").select((F.col("p") + 500).alias("image_id"), F.array(F.col("p").cast("int"), F.col("b").cast("int")).alias("people_ids"))
    gone = ids.select(F.col("p").alias("a")).crossJoin(later.select("b")).where("a < b AND (a + b) % 5 = 0")
    kept, save = {}, identity.saved
    monkeypatch.setattr(identity, "saved", lambda s, d, name: kept.setdefault(name, d) and save(s, d, name))
    got = [tuple(r) for r in identity.merge_suggestions(df, photos, limit=4, dismissed=gone).collect()]
    count = lambda p: sum(p == a or p == b for a in range(0, len(v), 7) for b in range(a + 1, len(v)) if a % 3 == b % 3)
    shares = lambda a, b: a % 3 == b % 3 and any(p % 3 == a % 3 for p in range(0, a + 1, 7))
    left = [(a, b, -s) for s, a, b in want if (a + b) % 5 and not shares(a, b)]
    pairs = [((b, a) if (count(a), -a) >= (count(b), -b) else (a, b)) + (s,) for a, b, s in left]
    assert [(a, b, round(s, vectors.SHOWN)) for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))[:4]] == got
    if few > 3:
        plan = kept["photos"]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("arrays_overlap") >= 1 and plan.index("Join") < plan.index("arrays_overlap")
        assert "FlatMapCoGroups" not in vectors.top_pairs(df, 5, 0.3, "person_id", "centroid", 2000)._jdf.queryExecution().optimizedPlan().toString()


def test_ties_of_many_copies_are_not_all_taken(spark, monkeypatch):
    """Copies tie; those whose source comes before all others of the score end the search."""
    df = spark.createDataFrame([(i, "x", [float(i % 40 + 1), 1.0], False) for i in range(160)], "person_id int, name string, centroid array<float>, hidden boolean")
    images = spark.createDataFrame([(i, [i] * i) for i in range(160)], "image_id bigint, people_ids array<int>")  # the later are on more photos
    taken, top = [], vectors.top_pairs
    monkeypatch.setattr(vectors, "top_pairs", lambda rows, n, *a: taken.append(n) or top(rows, n, *a))
    got = [(r.source_id, r.target_id) for r in identity.merge_suggestions(df, images, limit=5).collect()]
    assert got == [(0, 40), (0, 80), (0, 120), (1, 41), (1, 81)] and taken == [40]
