"""Commits: what they write, and what happens beside another writer."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenark.library import KEYS, Conflict, Library, bucket_of
from lumenark.operators import albums, details, identity


def people_rows(spark, rows):
    return spark.createDataFrame(rows, "person_id int, name string")


@pytest.fixture
def lib(spark, tmp_path):
    """200 images with two faces each, of 20 people, in 64 buckets."""
    lib = Library(spark, f"file://{tmp_path}/lib", buckets=64)
    lib.create({"dim": "4"})
    eye = np.eye(4)
    faces = [(2 * i + k, eye[(i + k) % 4].tolist(), i, (i + 7 * k) % 20, 0.5 + k / 10) for i in range(200) for k in (0, 1)]
    f = spark.createDataFrame(faces, "face_id bigint, vector array<float>, image_id bigint, person_id int, quality float")
    images = spark.range(200).select(F.col("id").alias("image_id"), F.concat(F.lit("/p/"), "id").alias("path"))
    people = spark.createDataFrame([(i, f"n{i}", eye[0].tolist(), 20) for i in range(20)], "person_id int, name string, centroid array<float>, face_count int")
    lib.commit({"images": identity.denormalised(images, f), "faces": f, "people": people}, at=lib.snapshot())
    return lib


def folders(lib, table):
    return set(lib.pointers()[table]["dirs"])


def of(lib, table, **where):
    df = lib.table(table)
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    return df


def test_writes_touch_only_their_buckets(spark, lib):
    assert len(folders(lib, "images")) > 55 and all(bucket_of(x) is not None for t in KEYS if lib.has(t) for x in lib.pointers()[t]["dirs"])
    p = identity.People(lib)
    before = {t: folders(lib, t) for t in ("images", "faces", "people")}

    def new():
        now = {t: folders(lib, t) for t in before}
        out = {t: len(now[t] - before[t]) for t in before}
        assert all(len(now[t]) == len(before[t]) for t in before)
        before.update(now)
        return out

    p.rename(3, "Cy")
    assert new() == {"images": 0, "faces": 0, "people": 1}
    face = of(lib, "faces", face_id=40).first()
    p.detach([40])
    assert new() == {"images": 1, "faces": 1, "people": 1}
    images = {r.image_id for r in of(lib, "faces", person_id=1).collect()}
    buckets = set(lib.snapshot().touched("faces", F.col("person_id") == 1))
    p.merge(1, 2)
    got = new()
    assert got["images"] == got["faces"] == len(buckets) < 25 and got["people"] <= 2
    # The lists are those of a whole remake, and people are counted right.
    want = identity.denormalised(lib.table("images"), lib.table("faces"))
    show = lambda df: sorted((r.image_id, tuple(r.people_ids)) for r in df.select("image_id", "people_ids").collect())
    assert show(lib.table("images")) == show(want) and all(2 in r.people_ids and 1 not in r.people_ids for r in lib.table("images").collect() if r.image_id in images)
    assert lib.row("people", "person_id", 2).face_count == of(lib, "faces", person_id=2).count() == 40
    assert of(lib, "people", person_id=1).count() == 0 and lib.row("people", "person_id", face.person_id).face_count == 19
    n = len(lib._commits())
    new_id = p.assign([40], name="Dora")  # person and faces in one commit
    assert len(lib._commits()) == n + 1 and lib.row("people", "person_id", new_id).face_count == 1
    details.trash_images(lib, [20], lambda path: True)  # so are images and their people
    assert len(lib._commits()) == n + 2 and lib.table("faces").count() == 398 and lib.row("people", "person_id", new_id).face_count == 0
    a = albums.Albums(lib)
    album = a.create("x")
    a.add(album, list(range(50)))
    was = folders(lib, "album_items")
    assert a.remove(album, [7]) == 1 and lib.table("album_items").count() == 48  # image 20 is gone
    assert len(was - folders(lib, "album_items")) == 1


def test_lost_updates_are_refused(spark, lib):
    at = lib.snapshot()
    ann = lib.updated("people", F.col("person_id") == 0, {"name": F.lit("Ann")})
    identity.People(Library(spark, lib.root)).rename(5, "Ben")
    with pytest.raises(Conflict):
        lib.commit({"people": ann}, at=at)
    with pytest.raises(ValueError):
        lib.commit({"people": ann})
    assert lib.row("people", "person_id", 5).name == "Ben"
    # Different buckets do not disturb each other, the same one does.
    which = at.touched("people", F.col("person_id") == 0)
    lib.commit({}, patched={"people": (which, at.table("people", buckets=which).withColumn("name", F.lit("Ann")))}, at=at)
    assert {r.person_id: r.name for r in lib.table("people").collect()}[5] == "Ben" and lib.row("people", "person_id", 0).name == "Ann"
    with pytest.raises(Conflict):
        lib.commit({}, patched={"people": (which, at.table("people", buckets=which))}, at=at)
    # Two writers that take the same new id.
    with pytest.raises(Conflict):
        lib.append({"people": people_rows(spark, [(20, "late")])}, at=at, unchanged=("people",))


def test_one_number_one_commit(spark, lib, monkeypatch):
    other = Library(spark, lib.root)
    write = lib._write

    def slowly(*a):
        other.append({"people": people_rows(spark, [(50, "first")])})
        return write(*a)

    monkeypatch.setattr(lib, "_write", slowly)
    with pytest.raises(Conflict):
        lib.append({"people": people_rows(spark, [(51, "second")])})
    monkeypatch.undo()
    assert {r.person_id for r in lib.table("people").collect()} == {*range(20), 50}


def test_compaction_leaves_other_writers_folders(spark, lib, monkeypatch):
    """An append that has written its rows, but not its pointer, when another library compacts and cleans."""
    other = Library(spark, lib.root, buckets=64)
    lib.append({"people": people_rows(spark, [(30, "x")])})
    create = lib._fs.create
    late = {}

    class Late:
        def __getattr__(self, name):
            return getattr(fs, name)

        def create(self, *a):
            if not late:
                late["done"] = True
                other.compact()
                raise RuntimeError("stopped")
            return create(*a)

    fs = lib._fs
    lib._fs = Late()
    with pytest.raises(RuntimeError):
        lib.append({"people": people_rows(spark, [(31, "y")])})
    lib._fs = fs
    written = {x.getPath().getName() for x in fs.listStatus(lib._path(f"{lib.root}/people"))}
    named = {x.split("/")[0] for x in lib.pointers()["people"]["dirs"]}
    assert late and any(x.endswith("-add") for x in written - named)  # the rows are still there
    lib.append({"people": people_rows(spark, [(31, "y")])})
    assert of(lib, "people", person_id=31).count() == 1
    other.compact(grace=0)
    assert lib.table("people").count() == 22 and len(lib._commits()) == 1


def test_a_pointer_without_end_is_passed_over(spark, lib):
    n = lib.snapshot().n
    out = lib._fs.create(lib._commit_file(n + 1), False)
    out.write(bytearray(json.dumps({"people": {}}).encode()[:7]))
    out.close()
    lib._fs.setTimes(lib._commit_file(n + 1), 0, -1)
    assert lib.snapshot().n == n and lib.table("people").count() == 20
    lib.append({"people": people_rows(spark, [(20, "z")])})
    assert lib.snapshot().n == n + 2 and lib.table("people").count() == 21


def test_reading_the_pointer_starts_no_job(spark, lib):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pointer", "")
    fresh = Library(spark, lib.root)
    assert fresh.ready() and fresh.version("people") > 0
    plan = fresh.table("people")
    assert not jobs.getJobIdsForGroup("pointer") and plan.columns
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_lookup_by_key_reads_one_bucket(lib):
    at = lib.snapshot()
    which = at.touched("images", lib.spark.range(17, 18).select(F.col("id").alias("image_id")))
    assert len(which) == 1 and len(at.dirs("images", which)) == 1 and lib.row("images", "image_id", 17).path == "/p/17"
