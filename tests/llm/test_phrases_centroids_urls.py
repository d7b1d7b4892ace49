"""Operators 11 to 13 against brute force, with nulls, empties, ties, repeats, hot keys and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenark.llm import centroids, oracles, phrases, queries, url_filter


# Phrases.
def brute_phrases(rows, spec):
    """rows: (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        count = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, spec.longest + 1):
                count.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= spec.least}
        best = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= spec.inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((spec.scale * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out |= {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[: spec.top], 1)}
    return out


def mined(df, spec):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.mine(df, spec).collect()}


def phrase_rows(seed):
    r = random.Random(seed)
    words = ["the", "of", "a", "a", "New", "york", "É", "zz\x00", "x\u00a0y", "日本"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n", "! "]) for _ in range(r.randrange(40)))
    rows = [(r.choice(["en", "en", "fr", None]), text()) for _ in range(120)]
    return [*rows, *[("en", "New York of the  a a a a, the end")] * 30, ("en", None), ("fr", ""), ("xx", " \t\n"), (None, "a " * 4000), ("de", "w" * 20_000)]


def test_phrases(spark, monkeypatch):
    rows = phrase_rows(3)
    df = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], "lang string, text string, n bigint, phrase string, unit int").repartition(5)
    for spec in (phrases.Spec(least=5), phrases.Spec(least=2, top=7, inside=50), phrases.Spec(least=300)):  # 300: counts wider than a byte
        want = brute_phrases(rows, spec)
        assert mined(df, spec) == want and want
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 90)
    monkeypatch.setattr(phrases, "UNIT_BYTES", 700)  # units of a few texts, long texts cut between pieces
    assert mined(df, phrases.Spec(least=5)) == brute_phrases(rows, phrases.Spec(least=5))
    assert phrases.mine(df.limit(0)).count() == 0
    long = [("en", "alpha beta gamma. " * 800), ("en", "alpha beta, " * 3)]
    assert mined(spark.createDataFrame(long, "lang string, text string"), phrases.Spec(least=5)) == brute_phrases(long, phrases.Spec(least=5))


def test_sketch_only_saves_work(spark, monkeypatch):
    """With every run in a few cells all are candidates, and counts are the same."""
    rows = phrase_rows(4)
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrases, "SLICE_BITS", 3)
    assert mined(df, phrases.Spec(least=4)) == brute_phrases(rows, phrases.Spec(least=4))


def test_sketch_prunes(spark):
    rows = [("en", " ".join(f"r{i}x{j}" for j in range(50))) for i in range(100)] + [("en", "very common words")] * 40
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    from lumenark.llm.bytekit import arrow_batches

    arrow_batches(spark)
    spec, src = phrases.Spec(), phrases.units(df, "lang", "text").cache()
    cells = phrases.candidate_cells(src, spec, phrases.SLICE_BITS + 6)
    found = sum(len(phrases._unplaned(r.cells)) for r in cells.collect())
    assert found == 6 * src.count()  # each unit's own six runs of the common text and nothing else
    counted = phrases.unit_counts(src, cells, spec, phrases.SLICE_BITS + 6, 5).where("phrase IS NOT NULL")
    assert counted.select("phrase").distinct().count() == 6


def test_many_runs_in_one_bucket(spark):
    rows = [("en", " ".join(f"r{i}" for i in range(15_000)))] * 2
    src = phrases.units(spark.createDataFrame(rows, "lang string, text string"), "lang", "text").cache()
    spec = phrases.Spec(least=2, longest=2)
    counted = phrases.unit_counts(src, phrases.candidate_cells(src, spec, phrases.SLICE_BITS + 6), spec, phrases.SLICE_BITS + 6, 1).cache()
    assert counted.where("n = 2").count() == 29_999 and counted.where("phrase IS NULL").first().n == 30_000


def test_scores_are_exact_beyond_64_bits(spark):
    big = 6 * 10**12
    rows = [("en", None, 0, 10 * big), ("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n bigint")).collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 2_000_000 * big // (5 * big + 1))]


def test_planes():
    x = np.array([0, 1, 5, 70_000, 2**20 - 1], np.uint32)
    assert phrases._unplaned(phrases._planes(x)).tolist() == x.tolist()


# Centroids.
def brute_clusters(rows, spec):
    """rows: (id, vector) that are kept, all ids different."""
    v = {i: [math.floor(spec.scale * float(x)) for x in q] for i, q in rows}
    c = [list(v[i]) for i in sorted(v, key=lambda i: hashlib.sha256(f"{spec.prefix}{i}".encode()).hexdigest())[: spec.k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((far(q, m), j) for j, m in enumerate(c))
    for _ in range(spec.rounds):
        own = [[] for _ in c]
        for q in v.values():
            own[near(q)[1]].append(q)
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(own, c, strict=True)]
    return {i: (near(q)[1], near(q)[0]) for i, q in v.items()}, c


@pytest.mark.parametrize("spread", [0.02, 1.0, 3000.0])  # ties and small moves; usual; beyond doubles' exact products
def test_clusters(spark, spread):
    r = random.Random(5)
    spec = centroids.Spec(k=7, dim=4, rounds=4)
    at = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [spread * (x + r.choice([0, 0, 0.01, -0.3]) * r.random()) for x in r.choice(at)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(400, 450)]  # copies
    bad = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [0.0, float("inf"), 0.0, 0.0]), (905, []), (906, [1e9, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + bad], "vec_id bigint, embedding array<double>, cluster int, q int, id string").repartition(4)
    found = centroids.cluster(df, spec)
    want, c = brute_clusters(rows, spec)
    assert {x.id: (x.cluster, x.distance) for x in found.rows.collect()} == want and found.centroids.tolist() == c
    got = centroids.described(found).collect()
    assert {x.inertia for x in got} == {sum(d for _, d in want.values())}
    one = got[0]
    assert one.cluster_inertia == sum(d for j, d in want.values() if j == one.cluster) and one.centroid_sha256 == hashlib.sha256(",".join(map(str, c[one.cluster])).encode()).hexdigest()


def test_bounds_save_comparisons(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.01, (300, 8)) for m in np.eye(8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = centroids.cluster(df, centroids.Spec(k=5, dim=8))
    assert found.scanned[-1] < len(x) / 4, found.scanned


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 6))
def test_moved_bounds_hold(seed, k):
    """After any moves clusters are those of a full comparison, and bounds enclose the distances."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-6, 7, (60, 3)), rng.integers(-6, 7, (k, 3))
    now, upper, lower = centroids.scan(x, c)
    for _ in range(4):
        new = c + rng.integers(-2, 3, c.shape)
        now, upper, lower, _ = centroids.Moved(c, new).assign(x, now, upper, lower)
        c = new
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert now.tolist() == d.argmin(1).tolist()
        assert (upper**2 >= d.min(1) - 1e-6).all() and (lower**2 <= np.sort(d, 1)[:, 1] + 1e-6).all()


def test_clusters_of_few_and_none(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert centroids.described(centroids.cluster(empty)).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 64), (None, [0.25] * 64), (1, [0.5] * 64)], "vec_id bigint, embedding array<float>")
    got = centroids.described(centroids.cluster(one)).collect()
    assert len(got) == 3 and {r.inertia for r in got} == {sum(r.distance for r in got)}


# Urls.
URLS = ["http://A.Example.NET/en/1", "https://a.example.net", "https://a.example.net?x=/en/", "x://net/", "//example.net/en/", "ftp://b.example.com/de/x?utm_a=1", "http://example.com/de", "http://notexample.com/de/9", "http://k.org/fr/2#://y", "http://k.org/fr/2?utm_x=1", "http://K.org/fr/3", None, "", "://", "http://?q", "http://e.f/ö\n/x?u", "http://" + "a." * 2000 + "net/z", "http://..//x", "http://m.site.example.org/p1?utm_x=2", "http://m.site.example.org/p1", "http://m.site.example.org:80/p1", "http://u@h.de/a b"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def brute_keys(host, path):
    labels = host.split(".")
    names = [".".join(labels[i:]) for i in range(len(labels))] if len(host) <= url_filter.MAX_HOST else [host]
    return [*names, host + (path or "/")] if host else []


def brute_rule(host, path):
    fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


@pytest.mark.parametrize("shard_keys, block", [(url_filter.SHARD_KEYS, url_filter.BLOCK_BYTES), (40, 600)])  # one block, and several
def test_urls(spark, shard_keys, block):
    r = random.Random(2)
    made = [f"http://{r.choice(['a.', 'b.', ''])}h{r.randrange(30)}.{r.choice(['net', 'org', 'com', 'example.com'])}/{r.choice(['en', 'de', 'fr'])}/{r.randrange(60)}{r.choice(['', '?utm_s=1', '#x'])}" for _ in range(1500)]
    made += ["http://hot.example.org/page"] * 800
    rows = list(enumerate(URLS + made)) + [(0, URLS[0]), (None, "http://x.org/1")]
    pages = spark.createDataFrame([(i, u, "h", "k", True, 3) for i, u in rows], "page_id bigint, url string, html string, host string, listed boolean, x int").repartition(6)
    listed = [k for i, u in rows for k in brute_keys(*brute_parts(u))[-1:] if i is not None and i % 3 == 0] + ["h7.com", "example.org", None]
    table = spark.createDataFrame([(k,) for k in listed], "key string")
    made_ = url_filter.cascade(url_filter.all_keys(pages), table, shard_keys=shard_keys)
    got = Counter((x.page_id, x.host, x.path, x.rule, x.listed, x.verdict) for x in url_filter.judge(pages, queries.URL_RULES, made_, block_bytes=block).collect())
    want = Counter()
    for i, u in rows:
        host, path = brute_parts(u)
        hit, rule = any(k in listed for k in brute_keys(host, path)), brute_rule(host, path)
        want[i, host, path, rule and rule.text, hit, rule.verdict if rule else "block" if hit else "allow"] += 1
    assert got == want
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, made_).count() == 0
    none = url_filter.cascade(url_filter.all_keys(pages.limit(0)), table.limit(0))
    assert url_filter.judge(pages, [], none).where("verdict = 'block' OR rule IS NOT NULL").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 400), st.integers(0, 400))
def test_cascade_is_exact(seed, n_listed, n_other):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 2**64, n_listed + n_other, np.uint64), rng.integers(0, 2**64, n_listed + n_other, np.uint64)
    on = np.arange(len(x)) < n_listed
    bits = 3
    shard = (x >> np.uint64(64 - bits)).astype(int)
    packed = {s: url_filter._packed(url_filter.build(x[shard == s], y[shard == s], on[shard == s])) for s in set(shard.tolist())}
    block = url_filter.Block(bits, 0, {s: b for s, b in packed.items() if b}, 1 << bits)
    assert block.listed(x, y).tolist() == on.tolist()


def test_cascade_is_smaller_than_its_keys(spark):
    n = 40_000
    universe = spark.range(n).select(F.concat(F.lit("host/"), "id").alias("key"))
    made = url_filter.cascade(universe, universe.where("key LIKE '%7'"))
    size, keys, listed, levels = made.shards.agg(F.sum(F.octet_length("filters")), F.sum("n_keys"), F.sum("n_listed"), F.max("n_levels")).first()
    assert (keys, listed) == (n, n // 10) and levels > 1 and size < 4 * listed  # 16 listed keys a shard; a listed key itself has 16 bytes of hashes


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op11_phrases", "op12_centroids", "op13_url_filter"):
        got = queries.queries()[name](spark, sf)
        cols = ", ".join(sorted(got.columns))
        want = con.execute(f"SELECT {cols} FROM ({oracles.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want))
