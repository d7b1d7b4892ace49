"""Restoring curation, indexing a folder, scanning texts, reading metadata."""

import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.functions import backends, metadata
from lumenark.library import Library
from lumenark.operators import albums, vectors
from lumenark.sources import media
from lumenark.streaming import ingest


def directory(entries, at, order):
    base, body, extra = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, n, raw in entries:
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value, extra = struct.pack(order + "I", base + len(extra)), extra + raw
        body += struct.pack(order + "HHI", tag, kind, n) + value
    return struct.pack(order + "H", len(entries)) + body + bytes(4) + extra


def tiff(order="<", original=b"2018:07:04 15:30:00\0"):
    ratio = lambda *v: b"".join(struct.pack(order + "II", x, 1) for x in v)
    number = lambda f, v: struct.pack(order + f, v)
    main = [(metadata.MAKE, 2, 6, b"Canon\0"), (metadata.MODEL, 2, 10, b"Canon EOS\0"), (metadata.ORIENTATION, 3, 1, number("H", 6)), (metadata.EXIF_PART, 4, 1, number("I", 400)), (metadata.GPS_PART, 4, 1, number("I", 600))]
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, ratio(10, 30, 36)), (3, 2, 2, b"E\0"), (4, 5, 3, ratio(20, 0, 0))]
    out = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + directory(main, 8, order)
    out = out.ljust(400, b"\0") + directory([(metadata.ORIGINAL, 2, len(original), original)], 400, order)
    return out.ljust(600, b"\0") + directory(gps, 600, order)


def jpeg(block):
    exif = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 400) + bytes(10)


def png(block):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 400, 300) + bytes(5)) + chunk(b"eXIf", block) + chunk(b"IEND", b"")


def test_metadata_of_formats(spark):
    files = [("/x/a.jpg", jpeg(tiff())), ("/x/b.png", png(tiff(">"))), ("/x/c.dng", tiff()), ("/x/IMG_20200103.jpg", b"\xff\xd8"), ("/x/e.jpg", None), ("/x/f.jpg", jpeg(tiff()[:650])), ("/x/g.gif", b"GIF89a" + struct.pack("<HH", 7, 8)), ("/x/h.jpg", jpeg(tiff(original=b"0000:00:00 00:00:00\0")))]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r.path: r for r in metadata.metadata(metadata.read_tags(df)).collect()}
    for p in ("/x/a.jpg", "/x/b.png", "/x/c.dng"):
        assert (got[p].taken_at, got[p].lat, got[p].lon, got[p].camera) == (datetime(2018, 7, 4, 15, 30), -10.51, 20.0, "Canon EOS")
    assert (got["/x/a.jpg"].width, got["/x/a.jpg"].height) == (300, 400) == (got["/x/b.png"].width, got["/x/b.png"].height)  # on their side
    assert got["/x/IMG_20200103.jpg"].taken_at == datetime(2020, 1, 3) and got["/x/e.jpg"].taken_at is None
    assert got["/x/f.jpg"].lat is None and got["/x/f.jpg"].camera == "Canon EOS" and got["/x/h.jpg"].taken_at is None
    assert (got["/x/g.gif"].width, got["/x/g.gif"].height) == (7, 8)
    assert len(got) == len(files) and metadata.metadata(metadata.read_tags(df.limit(0))).count() == 0


@pytest.fixture
def folder(tmp_path):
    def put(name, data):
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_bytes(data)

    put("with-ann-bob-20180704.jpg", b"hello")
    put("a/with-ann.jpg", b"word")
    put("a/two.png", b"\xff\xff")
    return put


def test_index_directory_and_texts(spark, tmp_path, folder):
    class PickyOcr:
        def extract(self, image, name):
            if name.endswith("two.png"):
                raise ValueError(name)
            return image.decode()

    lib, root = Library(spark, f"file://{tmp_path}/lib"), f"file:{tmp_path}/m"
    lib.create({})
    run = lambda prune=False: ingest.index_directory(lib, root, backends.StubEmbedder, backends.StubFaces, prune)
    assert run() == {"added": 3, "removed": 0, "faces": 3, "people_created": 2}
    images = {r.filename: r for r in lib.table("images").collect()}
    assert len(images["with-ann-bob-20180704.jpg"].people_ids) == 2 and images["with-ann-bob-20180704.jpg"].taken_at == datetime(2018, 7, 4)
    assert set(images["a/with-ann.jpg".split("/")[1]].people_ids) < set(images["with-ann-bob-20180704.jpg"].people_ids)
    assert images["two.png"].face_count == 0 and len(images["two.png"].content_hash) == 32
    counts = sorted(r.face_count for r in lib.table("people").collect())
    assert counts == [1, 2] and all(r.cover_face_id >= 0 and len(r.centroid) == 32 for r in lib.table("people").collect())
    commits = len(lib._commits())
    assert run() == {"added": 0, "removed": 0, "faces": 0, "people_created": 0} and len(lib._commits()) == commits

    files = media.media_files(spark, root, content=True)
    assert ingest.ocr_backfill(lib, files, PickyOcr, "picky", batch=2) == {"scanned": 3, "with_text": 2, "failed": 1, "already_scanned": 0}
    assert ingest.ocr_backfill(lib, files, PickyOcr, "picky") == {"scanned": 0, "with_text": 0, "failed": 0, "already_scanned": 3}
    assert sorted(r.text for r in lib.table("ocr").collect()) == ["", "hello", "word"]

    folder("later-with-bob.jpg", b"new")  # one known person more: updated, not made
    (tmp_path / "m" / "a" / "two.png").unlink()
    assert run(prune=True) == {"added": 1, "removed": 1, "faces": 1, "people_created": 0}
    assert sorted(r.face_count for r in lib.table("people").collect()) == [2, 2] and lib.table("images").count() == 3 and lib.table("ocr").count() == 2
    ids = [r.image_id for r in lib.table("images").collect()]
    assert len(set(ids)) == 3 and lib.table("faces").select("face_id").distinct().count() == 4


def test_index_in_batches_goes_on_where_it_was(spark, tmp_path, folder):
    for i in range(5):
        folder(f"b/{i}-with-ann.jpg", b"picture %d" % i)
    lib, root = Library(spark, f"file://{tmp_path}/lib"), f"file:{tmp_path}/m"
    lib.create({})

    begun, finish = [], ingest._index_batch

    def twice(*a):
        begun.append(a[2].count())
        if len(begun) == 3:
            raise KeyboardInterrupt
        return finish(*a)

    ingest._index_batch = twice
    try:
        with pytest.raises(KeyboardInterrupt):
            ingest.index_directory(lib, root, backends.StubEmbedder, backends.StubFaces, batch=2)
    finally:
        ingest._index_batch = finish
    assert begun == [2, 2, 2] and lib.table("images").count() == 4
    done = {r.path: r.image_id for r in lib.table("images").collect()}
    counts = ingest.index_directory(lib, root, backends.StubEmbedder, backends.StubFaces, batch=3)
    assert counts["added"] == 4 and counts["removed"] == 0
    rows = {r.path: r for r in lib.table("images").collect()}
    assert len(rows) == 8 and len({r.image_id for r in rows.values()}) == 8 and all(rows[p].image_id == i for p, i in done.items())
    assert lib.table("people").count() == 2 and sorted(r.face_count for r in lib.table("people").collect()) == [1, 7]
    commits = len(lib._commits())
    folder("b/0-with-ann.jpg", b"another")  # changed: the old row goes in the commit of the new one
    assert ingest.index_directory(lib, root, backends.StubEmbedder, backends.StubFaces)["removed"] == 1
    assert len(lib._commits()) == commits + 1 and lib.table("images").count() == 8 and lib.table("faces").count() == 8


def test_import_curation(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    lib.create({})
    rows = [(i, f"/p/{i}.jpg", f"h{i // 2}", [p for p, s in ((0, range(6)), (1, range(6, 10)), (2, range(8, 10))) if i in s]) for i in range(12)]
    images = spark.createDataFrame(rows, "image_id bigint, path string, content_hash string, people_ids array<int>")
    people = spark.createDataFrame([(0, "", False), (1, "Kept", False), (2, "", False)], "person_id int, name string, hidden boolean")
    lib.append({"images": images, "people": people})
    one = albums.Albums(lib)
    trip = one.create("Trip")
    one.add(trip, [0])
    stored = spark.createDataFrame([(70, "Ann", True, ["h0", "h1", "h9"]), (71, "Ben", False, ["h3", "h4"]), (72, "Cy", False, ["h5"]), (73, "", False, ["h0"]), (74, "Dee", False, None)], "person_id int, name string, hidden boolean, hashes array<string>")
    kept = spark.createDataFrame([(5, " Trip ", ["h0", "h1", ""]), (6, "New", ["h5", "none"]), (7, " ", ["h0"]), (8, "New", ["h4"]), (9, "Empty", None)], "album_id int, name string, hashes array<string>")
    media.write_backup(f"file://{tmp_path}/backup", stored, kept, ["/x/", "/y"])
    who, what, roots = media.read_backup(spark, f"file://{tmp_path}/backup")
    assert sorted(roots) == ["/x", "/y"] and media.with_root(roots, "/X/") == roots and media.without_root(roots, "/X") == ["/y"]
    # 71's best is person 1, who has another name: skipped. 72's photos show nobody; 74 has none.
    mine = ["/X", "/z"]
    assert albums.import_curation(lib, who, what, roots, mine) == {"albums_created": 2, "album_items_added": 3 + 4, "roots_added": 1, "people_restored": 1, "people_skipped": 3} and mine == ["/X", "/z", "/y"]
    assert {r.person_id: (r.name, r.hidden) for r in lib.table("people").collect()} == {0: ("Ann", True), 1: ("Kept", False), 2: ("", False)}
    named = {r.name: r.album_id for r in lib.table("albums").collect()}
    items = {(r.album_id, r.image_id) for r in lib.table("album_items").collect()}
    assert set(named) == {"Trip", "New", "Empty"} and items == {(trip, i) for i in range(4)} | {(named["New"], i) for i in (8, 9, 10, 11)}
    assert albums.import_curation(lib, who, what) == {"albums_created": 0, "album_items_added": 0, "roots_added": 0, "people_restored": 1, "people_skipped": 3}


def test_text_queries_and_golden_vectors(spark):
    model, names = backends.StubEmbedder(), ["beach sunset", "birthday cake", "city lights"]
    v = model.embed_texts(names)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "image_id bigint, vector array<double>")
    got = vectors.text_top_k(df, model, "a birthday", 3).collect()
    q = model.embed_texts(["a birthday"])[0]
    assert [r.image_id for r in got] == sorted(range(3), key=lambda i: -float(v[i] @ q)) and np.isclose(got[0].score, v[1] @ q)
    assert backends.self_check(model, dict(zip(names, v.tolist(), strict=True))) < 1e-9
    with pytest.raises(ValueError):
        backends.self_check(model, {"beach sunset": (v[0] + 0.1).tolist()})
    assert backends.self_check(model, {}) == 0.0
