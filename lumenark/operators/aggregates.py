"""Aggregates over images, faces, people, texts and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .browse import under


def folder_counts(images: DataFrame) -> DataFrame:
    return images.groupBy(F.coalesce("folder", F.lit("")).alias("folder")).agg(F.count("*").alias("n")).orderBy("folder")


def camera_counts(images: DataFrame) -> DataFrame:
    return images.where(F.coalesce("camera", F.lit("")) != "").groupBy("camera").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "camera")


def photos_per_person(images: DataFrame) -> DataFrame:
    return images.select(F.explode("people_ids").alias("person_id")).groupBy("person_id").agg(F.count("*").alias("photos"))


def people_listing(people: DataFrame, photos: DataFrame, include_hidden: bool = False, named_only: bool = False, min_photos: int = 0) -> DataFrame:
    """People with photo counts; named first, then by photos, then by id."""
    df = people.join(photos, "person_id", "left").withColumn("photos", F.coalesce("photos", F.lit(0)).cast("bigint"))
    named = F.trim(F.coalesce("name", F.lit(""))) != ""
    if not include_hidden:
        df = df.where(~F.coalesce("hidden", F.lit(False)))
    if named_only:
        df = df.where(named)
    return df.where(F.col("photos") >= min_photos).orderBy(F.desc(named), F.desc("photos"), "person_id")


def library_stats(images: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """One row; each table is scanned once."""
    visible = people.where(~F.coalesce("hidden", F.lit(False))).select("person_id")
    seen = photos_per_person(images).join(visible, "person_id", "left_semi").agg(F.count("*").alias("total_people"))
    i = images.agg(
        F.count("*").alias("total_images"),
        F.count_if(F.col("taken_at").isNull()).alias("undated"),
        F.count_if(F.col("lat").isNotNull()).alias("with_location"),
        F.count_if(F.coalesce("face_count", F.lit(0)) > 0).alias("with_faces"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
        F.min("taken_at").alias("first_taken"),
        F.max("taken_at").alias("last_taken"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
    )
    f = faces.agg(F.count("*").alias("total_faces"), F.count_if(F.col("person_id") < 0).alias("unassigned_faces"), F.count_if("confirmed").alias("confirmed_faces"))
    return i.crossJoin(f).crossJoin(seen)  # three rows of one


def ocr_coverage(ocr: DataFrame, images: DataFrame) -> DataFrame:
    o = ocr.agg(F.count("*").alias("scanned"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("with_text"))
    return o.crossJoin(images.agg(F.count("*").alias("total")))


def root_counts(images: DataFrame, roots: DataFrame) -> DataFrame:
    """Images under each root; the folders are grouped first, so only distinct folders meet the few roots."""
    folders = images.groupBy("folder").agg(F.count("*").alias("n"))
    return roots.join(folders, under(F.col("folder"), F.col("root")), "left").groupBy("root").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def album_listing(albums: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of raw membership and the cover: the chosen one, or the first added."""
    got = items.groupBy("album_id").agg(F.count("*").alias("n"), F.min(F.struct("added_at", "image_id")).alias("f"))
    df = albums.join(got, "album_id", "left")
    cover = F.coalesce(F.when(F.col("cover_image_id") >= 0, F.col("cover_image_id")), F.col("f.image_id"))
    return df.select("album_id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), cover.alias("cover")).orderBy(F.desc("n"), "album_id")


def exact_duplicates(images: DataFrame, key: str = "content_hash", id_: str = "image_id") -> DataFrame:
    """Groups of equal content: sorted ids and their number."""
    keyed = images.where(F.coalesce(F.col(key), F.lit("")) != "")
    return keyed.groupBy(key).agg(F.array_sort(F.collect_list(id_)).alias("ids"), F.count("*").alias("n")).where("n > 1")


def keep_largest(groups: DataFrame, images: DataFrame, size: str = "file_size", id_: str = "image_id") -> DataFrame:
    """Of each group the largest file is kept (ties: the smallest id), the others go."""
    each = groups.select(F.explode("ids").alias(id_), F.element_at("ids", 1).alias("group_id")).join(images.select(id_, size), id_)
    best = F.max_by(id_, F.struct(F.coalesce(size, F.lit(0)), -F.col(id_))).alias("keep")
    return each.groupBy("group_id").agg(best, F.array_sort(F.collect_list(id_)).alias("ids")).select("group_id", "keep", F.array_remove("ids", F.col("keep")).alias("losers"))


def people_in_images(images: DataFrame, ids: DataFrame) -> DataFrame:
    return images.join(ids, "image_id", "left_semi").select(F.explode("people_ids").alias("person_id")).distinct()


def centroids(faces: DataFrame, group: str = "person_id") -> DataFrame:
    """Quality-weighted mean direction, number of faces and best face of each group. Sums are taken by vector position, so a group is never gathered; weights are floored."""
    w = F.greatest(F.coalesce(F.col("quality").cast("double"), F.lit(0.0)), F.lit(1e-3))
    rows = faces.where(F.col("vector").isNotNull()).select(group, "face_id", w.alias("w"), "vector")
    sums = rows.select(group, "w", F.posexplode("vector").alias("pos", "v")).groupBy(group, "pos").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w")).alias("v"))
    mean = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("m"))
    best = rows.groupBy(group).agg(F.count("*").alias("face_count"), F.max_by("face_id", F.struct("w", -F.col("face_id"))).alias("cover_face_id"))
    norm = F.greatest(F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return mean.join(best, group).select(group, F.transform("m", lambda x: x / norm).alias("centroid"), "face_count", "cover_face_id")
