"""All near pairs and groups against brute force, and how many pairs meet."""

import random

import pytest
from pyspark.sql import functions as F

from lumenark.functions import fingerprints
from lumenark.operators import duplicates

SIGNED = 1 << 63


def hashes(seed, n):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 8)]
    out = []
    for _ in range(n):
        h = r.choice(base)
        for b in r.sample(range(64), r.choice([0, 0, 1, 2, 3, 5, 6, 7, 9, 12])):
            h ^= 1 << b
        out.append(h - (1 << 64) if h >= SIGNED else h)
    return out


def brute(rows, d):
    return {(a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for a, x in rows for b, y in rows if a < b and x and y and bin((x ^ y) & (2**64 - 1)).count("1") <= d}


def brute_groups(rows, d):
    label = {a: a for a, x in rows if x}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b, _ in brute(rows, d):
        x, y = sorted((root(a), root(b)))
        label[y] = x
    out = {}
    for a in label:
        out.setdefault(root(a), []).append(a)
    return {(g, tuple(sorted(m))) for g, m in out.items() if len(m) > 1}


@pytest.mark.parametrize("d", [0, 2, 3, 6, 9, 13])
def test_pairs_are_all_pairs(spark, d):
    rows = list(enumerate(hashes(d, 300))) + [(900, 0), (901, None), (902, -1), (903, -1), (904, -2)]
    df = spark.createDataFrame(rows, "image_id bigint, phash bigint")
    got = [(r.a, r.b, r.distance) for r in duplicates.exact_pairs(df, d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, d)
    if d in (3, 6):
        assert {(r.group_id, tuple(r.ids)) for r in duplicates.hash_groups(df, d).collect()} == brute_groups(rows, d)


def test_few_pairs_meet(spark):
    r = random.Random(1)
    n = 6000
    rows = [(i, r.getrandbits(63) + 1) for i in range(n)]
    df = spark.createDataFrame(rows, "image_id bigint, phash bigint")
    met = duplicates.near_hashes(df, 6, count=True).count()
    nine_bits = 7 * (n * n / 2) / 2**9  # what seven parts, one of them equal, would make meet
    assert met < nine_bits / 8 and met < n * n / 2 * 4 * 17 / 2**16 * 1.3
    # A third of all rows with one hash: one node.
    same = spark.range(3000).select((F.col("id") + n).alias("image_id"), F.lit(77).cast("bigint").alias("phash"))
    assert duplicates.near_hashes(df.unionByName(same), 6, count=True).count() <= met + 2000
    big = duplicates.hash_groups(df.unionByName(same), 6).where("n > 100").collect()
    assert [(g.group_id, g.n) for g in big] == [(n, 3000)]


def test_text_prints(spark):
    base = [f"w{i}" for i in range(300)]
    near = " ".join(base[:-2] + ["other", "words"])
    rows = [(1, " ".join(base)), (2, near), (3, "\n".join(reversed(base))), (4, None), (5, " \t\n"), (6, "é " * 5000), (7, " ".join(f"v{i}" for i in range(300)))]
    got = {r.doc: r.phash for r in fingerprints.text_prints(spark.createDataFrame(rows, "doc bigint, text string"), "doc", "text").collect()}
    apart = lambda a, b: bin((got[a] ^ got[b]) & (2**64 - 1)).count("1")
    assert got[4] is None and got[5] is None and got[6] is not None
    assert apart(1, 3) == 0 and apart(1, 2) <= 6 and apart(1, 7) > 12


def test_groups_of_packed_numbers_make_no_pairs_of_copies(spark):
    """The query's own hashes: 1500 equal ones, and as many of one link, are nodes and links of hashes; before, all pairs of rows were made."""
    from lumenark.plans import catalogue

    made = []
    whole, catalogue.D.exact_pairs = catalogue.D.exact_pairs, lambda *a, **k: made.append(a) or whole(*a, **k)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.when(F.col("id") < 1500, 4).otherwise(5).cast("bigint").alias("n_chars"))
    table, catalogue.W.table = catalogue.W.table, lambda *_: docs
    try:
        got = catalogue.near_duplicate_groups(spark, "").collect()
        rows = [(r.image_id, r.phash) for r in catalogue._hashes(spark, "").where("image_id < 1700 AND image_id > 1400").collect()]
    finally:
        catalogue.D.exact_pairs, catalogue.W.table = whole, table
    assert not made and sum(r.n for r in got) <= 3000
    df = spark.createDataFrame(rows, "image_id bigint, phash bigint")
    assert {(r.group_id, tuple(r.ids)) for r in duplicates.hash_groups(df, 2).collect()} == brute_groups(rows, 2)


def test_bits_that_all_hashes_share_make_no_pairs_meet(spark):
    """Numbers in bit fields: before, the constant part alone made all pairs meet."""
    n = 4000
    rows = [(i, (i * 7919 % 3001 << 32) | (i % 40 << 16) | i % 97) for i in range(1, n)]
    df = spark.createDataFrame(rows, "image_id bigint, phash bigint")
    for d in (2, 3):
        assert duplicates.near_hashes(df, d, count=True).count() < n * n / 2 / 20
    few = rows[:400]
    assert {(r.a, r.b, r.distance) for r in duplicates.exact_pairs(spark.createDataFrame(few, "image_id bigint, phash bigint"), 3).collect()} == brute(few, 3)


def test_a_key_of_very_many_hashes_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TILE", 40)
    monkeypatch.setattr(duplicates, "FEW", 4)
    rows = list(enumerate(hashes(5, 300)))
    df = spark.createDataFrame(rows, "image_id bigint, phash bigint")
    for d in (2, 6):
        got = [(r.a, r.b, r.distance) for r in duplicates.exact_pairs(df, d).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, d)
    close = [(i, i + 1) for i in range(200)]  # eight bits: all are near
    df = spark.createDataFrame(close, "image_id bigint, phash bigint")
    assert {(r.a, r.b, r.distance) for r in duplicates.exact_pairs(df, 6).collect()} == brute(close, 6)
    assert {(r.group_id, tuple(r.ids)) for r in duplicates.hash_groups(df, 6).collect()} == brute_groups(close, 6)


def test_a_text_costs_its_own_words_alone():
    """Before, every text went through all words met by its task."""

    class Known(dict):
        def keys(self):
            raise AssertionError("all words are read")

        __iter__ = keys

    known = Known((f"w{i}".encode(), bytes(8)) for i in range(10))
    assert fingerprints.text_print(b"w1 w2", known) == 0 and len(known) == 10
    assert fingerprints.text_print(b" other\nw1\tother ", known) == fingerprints.text_print(b"other w1", {b"w1": bytes(8)}) and len(known) == 11
    assert fingerprints.text_print(b" \n", known) is None and fingerprints.text_print(None, known) is None


@pytest.mark.parametrize("exact", [True, False])
def test_a_listing_makes_its_images_once(spark, tmp_path, exact):
    """Before, content hashes and fingerprints were made anew for exact groups, for members and for near groups."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = [(1, "a", 7 << 20), (2, "a", 7 << 20), (3, "b", 7 << 40), (4, "c", 7 << 40 | 1), (5, "d", -9), (6, "", 7 << 40), (7, None, None)]
    df = spark.createDataFrame(rows, "image_id bigint, content_hash string, phash bigint")
    got = duplicates.duplicates(df.mapInPandas(counted, df.schema), 2, exact=exact).collect()
    assert [(r.kind, r.ids) for r in got] == [("exact", [1, 2]), ("near", [3, 4, 6])]
    assert made.value == len(rows)


def test_pairs_are_never_broadcast(spark):
    """Many pairs of few hashes: before, Spark took them to be as small as the hashes and sent them all through the driver."""
    df = spark.range(40000).select(F.col("id").alias("image_id"), (F.col("id") % 200 + 1).alias("phash"))
    got = duplicates.exact_pairs(df, 3)
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    inside = None
    for x in lines:
        inside = None if inside is not None and depth(x) <= inside else inside
        inside = depth(x) if inside is None and "BroadcastExchange" in x else inside
        assert inside is None or "FlatMapGroupsInArrow" not in x
    assert sum("ShuffledHashJoin" in x for x in lines) == 2


def test_texts_of_a_batch_are_hashed_together(monkeypatch):
    """As text by text, but each different word of the batch is hashed once; before, a task of more words than it kept hashed them anew."""
    import pyarrow as pa

    r = random.Random(3)
    texts = [" ".join(r.choice(["w", "é", "\x00\x85", " "]) + str(r.randrange(900)) for _ in range(r.choice([1, 2, 5, 40, 300, 3000]))) for _ in range(80)]
    rows = [None, "", " \t\n\v\f\r", "one", "  one ", *texts, "a\x1cb a\x1cb", None]
    rows = [x and x.encode() for x in rows] + [b"\xff\xfe \xc3 word"]
    want = [fingerprints.text_print(x, {}) for x in rows]
    hashed = []
    md5 = fingerprints.md5
    monkeypatch.setattr(fingerprints, "md5", lambda w: hashed.append(w) or md5(w))
    array = pa.array(rows, pa.binary())
    for together in (1 << 22, 2000, 1):
        monkeypatch.setattr(fingerprints, "TOGETHER", together)
        hashed.clear()
        assert fingerprints.prints(array).to_pylist() == want
        assert together < 1 << 22 or len(hashed) == len(set(hashed))
        assert fingerprints.prints(array.slice(3, 50)).to_pylist() == want[3:53]
    assert fingerprints.prints(array.slice(0, 0)).to_pylist() == fingerprints.prints(pa.array([], pa.binary())).to_pylist() == [] and fingerprints.prints(array.slice(0, 3)).to_pylist() == [None] * 3


def test_a_listing_of_texts_reads_them_once(spark):
    """Before, the table was read for content hashes and again for fingerprints, and both were joined."""
    from lumenark.plans import catalogue

    read = []
    table, catalogue.W.table = catalogue.W.table, lambda s, d, t: read.append(t) or s.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d e f"), (4, "d\te f"), (5, None), (6, " ")], "doc_id bigint, text string")
    try:
        got = [(r.kind, r.ids) for r in catalogue.duplicates_listing_whole(spark, "").collect()]
    finally:
        catalogue.W.table = table
    assert got == [("exact", [1, 2]), ("near", [3, 4])] and read == ["documents"]
