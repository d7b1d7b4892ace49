"""Incremental work: ingest of files, text backfill, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import backends, metadata
from ..functions import parsing as P
from ..library import Library, without
from ..operators import identity, online
from ..sources.media import changes, is_video, media_files
from ..storage import saved


def upsert_plan(found: DataFrame, known: DataFrame, prune: bool = False, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to add, ids to delete): a changed file is deleted and added anew; missing ones go only if asked."""
    status = changes(found, known, root)
    todo = found.join(status.where(F.col("status").isin("new", "changed")).select("path"), "path", "left_semi")
    gone = ("changed", "missing") if prune else ("changed",)
    return todo, status.where(F.col("status").isin(*gone)).select("image_id")


def ingest(library: Library, found: DataFrame, to_rows: Callable[[DataFrame], dict[str, DataFrame]], prune: bool = False, root: str | None = None) -> dict[str, int]:
    """One incremental pass. to_rows makes the rows of each table from new files, without image ids."""
    at = library.snapshot()
    known = at.table("images", ("image_id", "path", "file_size", "mtime"))
    todo, stale = upsert_plan(found, known, prune, root)
    todo, stale = todo.cache(), stale.cache()
    counts = {"added": todo.count(), "removed": stale.count()}
    rows = to_rows(todo) if counts["added"] else {}
    if rows:
        rows = rows | {"images": library.allocate(rows["images"], "images", "image_id")}
    if rows or counts["removed"]:
        library.replace_images(stale if counts["removed"] else None, rows, at=at)
    todo.unpersist(), stale.unpersist()
    return counts


def ingest_stream(spark: SparkSession, library: Library, directory: str, schema: str, checkpoint: str, to_rows: Callable[[DataFrame], dict[str, DataFrame]], files_per_batch: int = 256):
    """Ingests what is new in a folder of listings and stops; it goes on where it was after a failure."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest(library, df, to_rows)).start()


def image_rows(files: DataFrame, make_embedder) -> DataFrame:
    """Rows of images, but for ids and people, from files (path, file_size, mtime, content). Pictures that cannot be embedded give no row."""
    vectors = backends.embed_files(files, make_embedder).where("vector IS NOT NULL")
    known = metadata.metadata(metadata.read_tags(files)).withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    facts = files.select("path", "file_size", "mtime", P.content_key(F.col("content")).alias("content_hash"))
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/[^/]*$", "")
    kind = F.when(is_video(F.col("path")), "video").otherwise("image")
    return facts.join(vectors, "path").join(known, "path").select("*", name.alias("filename"), folder.alias("folder"), F.localtimestamp().alias("added_at"), kind.alias("media_type"), F.lit("").alias("place"))


def index_directory(library: Library, root: str, make_embedder, make_faces, prune: bool = False, batch: int = 4096) -> dict[str, int]:
    """New and changed files under root become images, faces and people, `batch` files a commit in order of path; what was there is kept.

    A changed file's old rows go in the commit that brings its new ones, so no reader
    misses it, and a stopped run goes on where it was. Contents are read for the files of
    one commit alone. Their faces go to people in order of image; the task that decides
    holds a batch of faces and the people near them.
    """
    spark, at = library.spark, library.snapshot()
    known = at.table("images", ("image_id", "path", "file_size", "mtime"))
    todo, stale = upsert_plan(media_files(spark, root), known, prune, root)
    todo = saved(spark, todo, "todo")
    stale = saved(spark, known.select("image_id", "path").join(stale, "image_id"), "stale")
    counts, last = {"added": 0, "removed": 0, "faces": 0, "people_created": 0}, None
    missing = saved(spark, stale.join(todo.select("path"), "path", "left_anti"), "missing")
    if n := missing.count():
        library.remove_images(missing.select("image_id"), cascade=False)
        counts["removed"] += n
    while True:
        left = todo if last is None else todo.where(F.col("path") > last)
        part = saved(spark, left.orderBy("path").limit(batch), "todo-part")
        last = part.agg(F.max("path")).first()[0]
        if last is None:
            return counts
        for k, n in _index_batch(library, root, part, saved(spark, stale.join(part.select("path"), "path", "left_semi"), "stale-part"), make_embedder, make_faces).items():
            counts[k] += n


def _index_batch(library: Library, root: str, todo: DataFrame, stale: DataFrame, make_embedder, make_faces) -> dict[str, int]:
    """One commit of index_directory."""
    spark, at = library.spark, library.snapshot()
    counts = {"added": 0, "removed": stale.count(), "faces": 0, "people_created": 0}
    files = media_files(spark, root, content=True).join(F.broadcast(todo.select("path")), "path", "left_semi")
    rows = saved(spark, library.allocate(image_rows(files, make_embedder), "images", "image_id"), "image-rows")
    found = backends.detect_faces(files, make_faces).join(rows.select("path", "image_id"), "path")
    found = saved(spark, library.allocate(found.repartitionByRange("image_id").sortWithinPartitions("image_id", F.desc("quality")), "faces", "face_id"), "face-rows")
    counts |= {"added": rows.count(), "faces": found.count()}
    if not (counts["added"] or counts["removed"]):
        return counts
    old_faces = without(at.table("faces"), stale, "image_id")
    people = at.table("people")
    states = saved(spark, online.assign_states(found, people, old_faces.where("person_id >= 0"), library.next_id("people", "person_id")), "states")
    given = found.join(states.where("face_id IS NOT NULL").select("face_id", "person_id"), "face_id").withColumns({"confirmed": F.lit(False), "crop_path": F.lit("")})
    counts["people_created"] = states.where("fresh").count()
    of_image = identity.people_of_images(given)
    images = rows.join(of_image, "image_id", "left").withColumns({"people_ids": F.coalesce("people_ids", F.array().cast("array<int>")), "face_count": F.coalesce("face_count", F.lit(0))})
    gone = library.parts_without(at, stale, ["images", "faces", "ocr"]) if counts["removed"] else {}
    changed = states.where("face_id IS NULL").select("person_id").distinct()
    if (which := at.touched("people", changed)) != []:
        gone["people"] = which, identity.flushed(at.table("people", buckets=which), states)
    library.commit({}, added={"images": images, "faces": given}, patched=gone, at=at, unchanged=("images", "faces", "people"))
    return counts


def ocr_backfill(library: Library, files: DataFrame, make, engine: str, batch: int = 4096) -> dict[str, int]:
    """Scans images without a text, newest first, `batch` a commit, so that a stopped run goes on where it was.

    Each image gets one row: a file that fails, or is not among files (path, content), an empty text.
    """
    library.ensure("ocr")
    before = library.table("ocr").select("image_id").distinct().count()
    todo = saved(library.spark, ocr_todo(library.table("images", ("image_id", "path")), library.table("ocr")), "ocr-todo")
    out, last = {"scanned": 0, "with_text": 0, "failed": 0, "already_scanned": before}, None
    while True:
        left = todo if last is None else todo.where(F.col("image_id") < last)
        part = saved(library.spark, left.orderBy(F.desc("image_id")).limit(batch), "ocr-part")
        n, last = part.agg(F.count("*"), F.min("image_id")).first()
        if not n:
            return out
        texts = backends.recognise(files.join(part.select("path"), "path", "left_semi"), make, engine).drop("engine")
        rows = part.join(texts, "path", "left").select("image_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(engine).alias("engine"), F.localtimestamp().alias("updated_at"), F.coalesce("failed", F.lit(True)).alias("failed"))
        rows = saved(library.spark, rows, "ocr-rows")
        library.append({"ocr": rows.drop("failed")})
        some, bad = rows.agg(F.count_if(F.col("text") != ""), F.count_if("failed")).first()
        out |= {"scanned": out["scanned"] + n, "with_text": out["with_text"] + some, "failed": out["failed"] + bad}


def ocr_todo(images: DataFrame, ocr: DataFrame) -> DataFrame:
    """Images without a scan, newest id first."""
    return images.join(ocr.select("image_id"), "image_id", "left_anti").orderBy(F.desc("image_id"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the same plan for a batch and for a stream with a watermark."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
