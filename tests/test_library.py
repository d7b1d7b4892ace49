
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.functions import backends, parsing
from lumenark.library import Library, NotFound, SchemaMismatch
from lumenark.operators import albums, browse, details, duplicates, graph, identity, online, vectors
from lumenark.sources import media
from lumenark.streaming import ingest


def unit(seed, dim=8, near=None, noise=0.05):
    r = np.random.default_rng(seed)
    v = r.standard_normal(dim) if near is None else near + noise * r.standard_normal(dim)
    return (v / np.linalg.norm(v)).tolist()


@pytest.fixture
def lib(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    lib.create({"dim": "8"})
    when = [datetime(2018, 7, 4), datetime(2018, 7, 5), datetime(2019, 8, 12), None, datetime(2023, 5, 30)]
    rows = [(i, unit(i), f"/p/{'a' if i < 2 else 'b/c'}/{i}.jpg", f"/p/{'a' if i < 2 else 'b/c'}", t, 100 + i, float(i), f"h{i % 4}") for i, t in enumerate(when)]
    images = spark.createDataFrame(rows, "image_id bigint, vector array<float>, path string, folder string, taken_at timestamp_ntz, file_size bigint, mtime double, content_hash string")
    a, b, c = np.eye(8)[:3]
    faces = [(0, unit(1, near=a), 0, 0, 0.9, False), (1, unit(2, near=a), 1, 0, 0.8, False), (2, unit(3, near=b), 1, 1, 0.7, False), (3, unit(4, near=b), 2, 1, 0.6, False), (4, unit(5, near=b), 4, -1, 0.5, False), (5, c.tolist(), 4, -1, 0.1, False)]
    faces = spark.createDataFrame(faces, "face_id bigint, vector array<float>, image_id bigint, person_id int, quality float, confirmed boolean")
    people = spark.createDataFrame([(0, "Ann", a.tolist(), 2, 0, False), (1, "", b.tolist(), 2, 2, False)], "person_id int, name string, centroid array<float>, face_count int, cover_face_id bigint, hidden boolean")
    lib.append({"images": images, "faces": faces, "people": people})
    lib.commit({"images": identity.denormalised(lib.table("images"), lib.table("faces"))}, at=lib.snapshot())
    return lib


def ids(df, c="image_id"):
    return [r[c] for r in df.collect()]


def people_of(lib):
    return {r.image_id: r.people_ids for r in lib.table("images").collect()}


def test_gates_and_versions(spark, lib, tmp_path):
    with pytest.raises(NotFound):
        Library(spark, f"file://{tmp_path}/none").require_ready()
    lib.verify_compatible({"dim": "8"})
    with pytest.raises(SchemaMismatch):
        lib.verify_compatible({"dim": "9"})
    before = lib.version("people")
    identity.People(lib).rename(0, " Anna ")
    assert lib.version("people") > before and lib.row("people", "person_id", 0).name == "Anna"
    with pytest.raises(NotFound):
        identity.People(lib).rename(9, "x")
    lib.compact()
    assert lib.table("images").count() == 5
    assert lib.next_id("images", "image_id") == 5  # T23
    got = lib.allocate(spark.range(7).select(F.col("id").alias("x")).repartition(3), "images", "image_id")
    assert sorted(ids(got)) == list(range(5, 12))


def test_undated_last_both_ways(lib):  # T3, T4
    df = lib.table("images")
    assert ids(df.orderBy(*browse.ordering("date_desc"))) == [4, 2, 1, 0, 3]
    assert ids(df.orderBy(*browse.ordering("date_asc"))) == [0, 1, 2, 4, 3]
    f = browse.Filters(start=datetime(2018, 7, 4), end=datetime(2019, 8, 12))
    assert sorted(ids(browse.select(df, f))) == [0, 1, 2]
    zoned = browse.Filters(start=datetime(2018, 7, 5, 2, tzinfo=timezone(timedelta(hours=2))), end=datetime(2018, 7, 5))  # T5
    assert ids(browse.select(df, zoned)) == [1]


def test_pages_join_to_the_order_and_all_is_within_any(lib):
    df = lib.table("images")
    whole = ids(df.orderBy(*browse.ordering("random", 3)))
    assert [i for n in (1, 2, 3) for i in ids(browse.page(df, browse.ordering("random", 3), n, 2))] == whole
    assert ids(browse.page(df, browse.ordering("date_desc"), 9)) == []
    both = set(ids(browse.select(df, browse.Filters(people=(0, 1), people_mode="all"))))
    some = set(ids(browse.select(df, browse.Filters(people=(0, 1)))))
    assert both == {1} and both <= some == {0, 1, 2}
    assert ids(browse.select(df, browse.Filters(people=(0, 77), people_mode="all"))) == []  # T30
    assert sorted(ids(browse.select(df, browse.Filters(people=(0, 77))))) == [0, 1]


def test_folders_and_short_tokens(lib):  # T8, T14
    df = lib.table("images")
    assert sorted(ids(browse.select(df, browse.Filters(folder="/p/b")))) == [2, 3, 4]
    assert ids(browse.select(df, browse.Filters(folder="/p/B"))) == []
    assert browse.select(df, browse.Filters(folder="/")).count() == 5
    assert browse.text_match(df.select("image_id", F.lit("a b").alias("text")), "a b").count() == 0


def test_merge_detach_delete(lib):
    p = identity.People(lib)
    with pytest.raises(ValueError):
        p.merge(0, 0)
    assert people_of(lib) == {0: [0], 1: [0, 1], 2: [1], 3: [], 4: []}
    p.detach([3])
    assert people_of(lib)[2] == []
    new = p.assign([4, 5], name="Bob")
    assert people_of(lib)[4] == [new] and lib.row("people", "person_id", new).face_count == 2  # T18
    p.merge(1, 0)
    assert people_of(lib)[1] == [0]
    old = lib.row("people", "person_id", 0).centroid
    p.detach([0, 1, 2])
    row = lib.row("people", "person_id", 0)
    assert (row.face_count, row.cover_face_id, row.centroid) == (0, -1, old)  # T19
    assert p.delete(new) == [4] and people_of(lib)[4] == []


def test_details_and_trash(spark, lib):
    got = details.image_details(lib, 1)
    assert [p["person_id"] for p in got["people"]] == [0, 1] and [f["face_id"] for f in got["faces"]] == [1, 2] and got["text"] == ""
    with pytest.raises(NotFound):
        details.ocr_text(lib, 77)

    def send(path):
        if path.endswith("/0.jpg"):
            raise OSError(path)
        return None if path.endswith("/2.jpg") else True

    assert details.trash_images(lib, [0, 1, 2, 2], send) == {"trashed": 1, "missing": 1, "failed": 1, "removed": 2}
    assert sorted(ids(lib.table("images"))) == [0, 3, 4] and lib.row("people", "person_id", 1).face_count == 0


def test_recluster_keeps_names_and_confirmed_faces(lib):  # T20, T21
    p = identity.People(lib)
    p.assign([0], 0)
    p.detach([5])
    p.recluster()
    f = {r.face_id: r.person_id for r in lib.table("faces").collect()}
    assert f[0] == f[1] == 0 and f[2] == f[3] == f[4] > 0 and f[5] not in (-1, f[0], f[2])
    assert lib.row("people", "person_id", 0).name == "Ann"


def test_albums_cascade_and_curation(spark, lib):  # T9, T26
    a = albums.Albums(lib)
    one = a.create(" ")
    assert lib.row("albums", "album_id", one).name == f"Album {one}"
    assert a.add(one, [0, 0, 1, 99]) == 2 and a.add(one, [1, 2]) == 1
    assert ids(albums.album_images(lib.table("album_items"), lib.table("images"), one)) == [2, 1, 0]
    assert a.remove(one, [7, 2]) == 2
    who, what = albums.export_curation(lib.table("images"), lib.table("people"), lib.table("albums"), lib.table("album_items"))
    assert [(r.person_id, r.hashes) for r in who.collect()] == [(0, ["h0", "h1"])] and what.head().hashes == ["h0", "h1"]
    shared = albums.overlap(who, lib.table("images"))
    assert [tuple(r) for r in shared.collect()] == [(0, 0, 2), (0, 1, 1)]
    bare = lib.table("people").withColumn("name", F.lit(""))
    named, counts = albums.import_people(bare, lib.table("images"), who)
    assert {r.person_id: r.name for r in named.collect()} == {0: "Ann", 1: ""} and counts == {"people_restored": 1, "people_skipped": 0}
    lib.remove_images(spark.createDataFrame([(0,)], "image_id bigint"))
    assert lib.table("album_items").count() == 1 and lib.table("faces").count() == 5
    a.delete(one)
    assert lib.table("album_items").count() == 0


def test_incremental_ingest(spark, lib):  # T24
    found = spark.createDataFrame([("/p/a/0.jpg", 100, 0.5), ("/p/a/1.jpg", 101, 3.5), ("/p/new.jpg", 5, 9.0)], "path string, file_size bigint, mtime double")
    status = {r.path: r.status for r in media.changes(found, lib.table("images")).collect()}
    assert status["/p/a/0.jpg"] == "same" and status["/p/a/1.jpg"] == "changed" and status["/p/new.jpg"] == "new" and status["/p/b/c/2.jpg"] == "missing"
    make = lambda df: {"images": df.withColumn("media_type", F.lit("image"))}
    assert ingest.ingest(lib, found, make, prune=True, root="/p") == {"added": 2, "removed": 4}
    left = ids(lib.table("images"))
    assert 0 in left and len(set(left)) == 3
    assert ingest.ingest(lib, found, make) == {"added": 0, "removed": 0}


def test_streamed_ingest(spark, lib, tmp_path):
    spark.createDataFrame([("/q/1.jpg", 5, 9.0)], "path string, file_size bigint, mtime double").write.parquet(f"{tmp_path}/in")
    make = lambda df: {"images": df}
    for _ in range(2):
        ingest.ingest_stream(spark, lib, f"{tmp_path}/in", "path string, file_size bigint, mtime double", f"{tmp_path}/ck", make).awaitTermination()
    assert lib.table("images").where("path = '/q/1.jpg'").count() == 1


def test_banded_and_exact_near_duplicates(spark):  # T1, T2
    base = 0x0123456789ABCDEF
    far = base ^ 0b1 ^ (1 << 16) ^ (1 << 32) ^ (1 << 48)
    rows = spark.createDataFrame([(1, base), (2, base ^ 0b11), (3, 77), (4, base ^ 0b1), (5, far), (6, 0), (7, None)], "image_id bigint, phash bigint")
    pairs = {(r.a, r.b) for r in duplicates.near_pairs(rows).collect()}
    assert pairs == {(1, 2), (1, 4), (2, 4), (4, 5)}
    assert {(r.a, r.b) for r in duplicates.exact_pairs(rows, 6).collect()} == {(1, 2), (1, 4), (2, 4), (1, 5), (2, 5), (4, 5)}
    assert [r.ids for r in duplicates.groups(rows, duplicates.near_pairs(rows)).collect()] == [[1, 2, 4, 5]]
    crowd = spark.range(600).select(F.col("id").alias("image_id"), (F.shiftleft("id", 16) + 5).alias("phash"))
    assert duplicates.near_pairs(crowd).where("a < 2 AND b < 2").count() == 0 and duplicates.exact_pairs(crowd, 1).where("a = 0 AND b = 1").count() == 1
    assert spark.range(1).select(duplicates.hamming(F.lit(-6172840429334713785), F.lit(-6172840429334713785 ^ 0b111)).alias("d")).head().d == 3


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select((F.col("id") * 11 % 301).alias("a"), ((F.col("id") + 1) * 11 % 301).alias("b"))
    got = graph.components(spark, edges).collect()
    assert {r.label for r in got} == {0} and len(got) == 301
    assert graph.components(spark, edges.limit(0)).count() == 0


def test_knn_blocks_agree_with_broadcast(spark):
    rows = spark.createDataFrame([(i, unit(i, near=np.ones(8), noise=0.8)) for i in range(60)], "image_id bigint, vector array<float>")
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(vectors.knn(rows, 5)) == order(vectors.knn(rows, 5, broadcast_bytes=1000))
    index = vectors.CellIndex(spark, rows, cells=4)
    q = unit(3)
    want = {r.image_id for r in vectors.top_k(rows, q, 10).collect()}
    assert len(want & {r.image_id for r in index.search(q, 10, probes=4).collect()}) == 10
    assert vectors.ivf_params(10_000, 768) == (100, 96)


def test_assignment_rules():
    a = online.Assigner([], 0)
    v, w = np.array(unit(1)), np.array(unit(2))
    assert a.assign([(1, v, 0.9, 1.0)]) == [(1, 0)]
    assert a.assign([(2, v, 0.9, 1.0), (3, v, 0.8, 1.0)]) == [(2, 0), (3, 1)]  # one person once an image
    assert a.assign([(4, -v - w, 0.05, 1.0)]) == [(4, -1)]  # unusable and unknown


def test_parsing(spark):
    df = spark.createDataFrame([("IMG_20180704_153000", "2018:07:04 15:30:00", 0.0, 0.0), ("holiday-2018-07-04", "0000:00:00 00:00:00", 51.5, -0.12), ("x123456789", "nonsense", 91.0, 0.0)], "stem string, exif string, lat double, lon double")
    got = df.select(parsing.filename_date(F.col("stem")).alias("n"), parsing.exif_date(F.col("exif")).alias("e"), parsing.valid_coordinates(F.col("lat"), F.col("lon")).alias("v")).collect()
    assert [r.n for r in got] == [datetime(2018, 7, 4, 15, 30), datetime(2018, 7, 4), None]
    assert [r.e for r in got] == [datetime(2018, 7, 4, 15, 30), None, None] and [r.v for r in got] == [False, True, False]
    banner = F.lit("Duration: 00:01:02.50, start\n Stream Video: h264, yuv420p, 1920x1080\n rotate : 90\n creation_time : 2020-01-02T03:04:05")
    r = spark.range(1).select(parsing.duration_ms(banner).alias("d"), parsing.video_size(banner).alias("s"), parsing.camera(F.lit("Canon"), F.lit("Canon EOS")).alias("c"), parsing.canonical_text(F.lit("A  b,C!")).alias("t")).head()
    assert (r.d, tuple(r.s), r.c, r.t) == (62500, (1080, 1920), "Canon EOS", "a bc")
    assert backends.laplacian_variance(np.ones((5, 5))) == 0 and backends.phash_pixels(np.arange(1024).reshape(32, 32)) != 0
    got = spark.range(1).select(parsing.dms(F.lit(180.0), F.lit(0.0), F.lit(1.0), F.lit("E")).alias("a"), parsing.dms(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("s")).alias("b")).head()
    assert (got.a, got.b) == (None, -10.5)


def test_phash_literal_values():
    from math import cos, pi, sqrt

    pictures = [np.random.default_rng(s).integers(0, 256, (32, 32)) for s in range(3)]
    for p in pictures:  # the sum for each coefficient, written out
        b = [[cos(pi * (2 * i + 1) * k / 64) / (sqrt(2) if i == 0 else 1) for k in range(32)] for i in range(8)]
        low = [sum(b[u][y] * b[v][x] * float(p[y][x]) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        middle = sorted(low[1:])[31]
        value = int("".join("1" if c > middle else "0" for c in low), 2)
        assert backends.phash_pixels(p) == value - (1 << 64) * (value >> 63)


def test_export_names_are_free(spark):
    rows = [(1, "/x/a.jpg"), (2, "/y/A.jpg"), (3, "/z/a (2).jpg"), (4, "/x/b.png"), (5, "/y/b.png"), (6, "/z/b.png"), (7, "/x/.hidden"), (8, "/x/c.gif")]
    df = spark.createDataFrame(rows, "image_id bigint, path string")
    got = {r.image_id: r.target for r in albums.export_names(df, "/out/").collect()}
    assert got == {1: "/out/a.jpg", 2: "/out/A (2).jpg", 3: "/out/a (2) (2).jpg", 4: "/out/b.png", 5: "/out/b (2).png", 6: "/out/b (3).png", 7: "/out/.hidden", 8: "/out/c.gif"}
    there = spark.createDataFrame([("C.gif",), ("b (3).png",), ("other",)], "name string")
    got = {r.image_id: r.target for r in albums.export_names(df, "/out", there).collect()}
    assert (got[6], got[8], got[1]) == ("/out/b (4).png", "/out/c (2).gif", "/out/a.jpg")


def test_appends_write_their_own_rows(spark, lib):
    for i in range(10):
        lib.append({"people": spark.createDataFrame([(100 + i, "p")], "person_id int, name string")})
    dirs = lib.pointers()["people"]["dirs"]
    rows = [spark.read.parquet(f"{lib.root}/people/{x}").count() for x in dirs[-10:]]
    assert rows == [1] * 10 and lib.table("people").count() == 12
    lib.compact(grace=0)
    dirs = lib.pointers()["people"]["dirs"]
    assert len({x.split("/")[0] for x in dirs}) == 1 and lib.table("people").count() == 12
    assert len(lib._fs.listStatus(lib._path(f"{lib.root}/people"))) == 1
    before = len(lib._commits())
    lib.compact(grace=0)  # nothing to do
    assert len(lib._commits()) == before


def test_search_filters_before_ranking(spark):
    rows = [(i, None if i % 3 else 1.0, unit(i), datetime(2020, 1, 1 + i % 28)) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id bigint, lat double, vector array<float>, taken_at timestamp_ntz").withColumns({"people_ids": F.array().cast("array<int>"), "face_count": F.lit(0), "media_type": F.lit("image")})
    texts = spark.createDataFrame([(3, "a word"), (4, "a word"), (9, "a word")], "image_id bigint, text string")
    all_, first = browse.search(df, texts, "word", df, unit(5), browse.Filters(has_location=True), candidates=10)
    got = first.collect()
    near = {r.image_id for r in vectors.top_k(df, unit(5), 10, allowed=F.col("lat").isNotNull()).collect()}
    assert [r.image_id for r in got[:2]] == [9, 3] and {r.image_id for r in got} == near | {3, 9} and all_.count() == len(near | {3, 9})
    scores = [r.score for r in got[2:]]
    assert scores == sorted(scores, reverse=True) and all(r.image_id % 3 == 0 for r in got)
    assert browse.search(df, None, "word", df, unit(5), min_score=2.0)[0].count() == 0


def test_recluster_without_regard_to_people_keeps_confirmed_clusters(lib):
    identity.People(lib).assign([5], 1)  # alone and of poor quality
    got = identity.recluster(lib.table("faces"), lib.table("people"), respect_confirmed=False)
    f = {r.face_id: r.person_id for r in got.faces.collect()}
    assert f[5] >= 0 and f[5] not in (f[0], f[2]) and {r.name for r in got.people.collect()} == {""}


def test_two_confirmed_people_in_a_cluster_make_a_fresh_one(spark, lib):
    p = identity.People(lib)
    p.assign([0], 0)
    p.assign([1], 1)
    p.recluster()
    f = {r.face_id: r.person_id for r in lib.table("faces").collect()}
    assert f[0] == f[1] > 1
    row = lib.row("people", "person_id", f[0])
    assert row.face_count == 2 and row.cover_face_id == 0 and row.name == ""


def test_files_and_backends(spark, tmp_path):
    for n in ("with-ann-bob.jpg", "a/one.png", "a/.hidden/two.png", "@eaDir/three.jpg", "note.txt"):
        (tmp_path / "m" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / n).write_bytes(b"text of " + n.encode())
    files = media.media_files(spark, f"file:{tmp_path}/m", content=True)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in files.collect()) == ["one.png", "with-ann-bob.jpg"]
    assert backends.detect_faces(files, backends.StubFaces).count() == 2
    assert {len(r.vector) for r in backends.embed_files(files, backends.StubEmbedder).collect()} == {64}
    assert backends.recognise(files, backends.StubOcr, "stub").where("text LIKE 'text of%'").count() == 2
