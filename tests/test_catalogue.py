"""Every registered core query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lumenark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def flat(v):
    return [flat(x) for x in v] if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([flat(r[c]) for c in cols]) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if not sql:
        assert got
        return
    r = con.sql(sql)
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(str([flat(x[i]) for i in at]) for x in r.fetchall())


def test_words_of_whole_texts(spark):
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_words for r in catalogue.word_function(spark, SF).collect()}
    assert any(len(t) > 2000 for t in docs.values())
    assert got == {i: len(re.findall("[a-z0-9]+", t.lower())) for i, t in docs.items()}


def test_people_of_every_image(spark):
    faces = catalogue.W.faces(spark, SF).where("person_id >= 0").join(catalogue.W.people(spark, SF), "person_id")
    want = {(r.image_id, r.person_id) for r in faces.collect()}
    assert {(r.image_id, r.person_id) for r in catalogue.people_on_images(spark, SF).collect()} == want
    assert {r.person_id for r in catalogue.people_in_images(spark, SF).collect()} == {p for _, p in want}


@pytest.mark.parametrize("source", ["texts", "numbers"])  # fingerprints of texts; packed numbers, of which nearly all are near
def test_near_duplicates_at_the_default_distance(spark, source):
    D, numbers = catalogue.D, catalogue._hashes(spark, SF)
    rows = catalogue._prints(spark, SF) if source == "texts" else numbers
    pairs, grouped = (catalogue.near_duplicate_pairs_whole(spark, SF), catalogue.near_duplicate_groups_whole(spark, SF)) if source == "texts" else (D.exact_pairs(numbers), D.hash_groups(numbers))
    h = {r.image_id: r.phash for r in rows.collect() if r.phash}
    want = {(a, b, n) for a in h for b in h if a < b and (n := ((h[a] ^ h[b]) & (1 << 64) - 1).bit_count()) <= 6}
    assert any(n > 3 for _, _, n in want)
    assert {tuple(r) for r in pairs.select("a", "b", "distance").collect()} == want
    low = {i: i for i in h}
    while (nxt := {i: min([low[i], *(low[b if a == i else a] for a, b, _ in want if i in (a, b))]) for i in h}) != low:
        low = nxt
    groups = {g: sorted(i for i in low if low[i] == g) for g in set(low.values())}
    assert {r.group_id: r.ids for r in grouped.collect()} == {g: x for g, x in groups.items() if len(x) > 1}


def test_cell_search_reaches_its_recall(spark):
    import numpy as np

    V = catalogue.V
    rng = np.random.default_rng(7)
    blobs = [(i, (np.eye(16)[i % 16] * 3 + rng.normal(size=16) * 0.3).tolist()) for i in range(1200)]
    for df in (catalogue.W.vectors(spark, SF), spark.createDataFrame(blobs, "image_id bigint, vector array<float>")):
        asked = df.where("image_id % 50 = 0")
        index = V.CellIndex(spark, df)
        probes = index.probes_for(asked, 20)
        assert probes < len(index.centres)
        rows = df.collect()
        ids, x = np.array([r.image_id for r in rows]), V._unit([r.vector for r in rows])
        true = {(a, b) for a, b in V._best(ids, x, ids, x, 20, -2.0)[["a", "b"]].itertuples(index=False) if a % 50 == 0}
        got = {(r.query_id, r.image_id) for r in index.search_all(asked, 20, probes).collect()}
        assert {q for q, _ in got} == set(ids[ids % 50 == 0].tolist()) and len(true & got) >= 0.9 * len(true)
    assert {r.query_id for r in catalogue.cell_search(spark, SF).select("query_id").distinct().collect()} == {i for i in range(0, 500, 50)}


def test_flagship_pushes_its_filter_down(spark):
    plan = catalogue.filter_dates(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderdate" in plan and "Exchange" not in plan


def test_entry_point_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalogue.__file__).parents[2]
    shutil.copytree(root / "lumenark", tmp_path / "lumenark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for pipeline in (True, False):  # left behind, and removed as well
        if pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        else:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert said.returncode == 0, said.stderr
        assert "False" in said.stdout
