"""File sources: which files are media, what changed, roots, JSON backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings and folders that are never read.
RASTER = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
HEIF = ("heic", "heif", "hif")
RAW = ("arw", "cr2", "cr3", "dng", "nef", "orf", "raf", "rw2")
VIDEO = ("3gp", "avi", "m2ts", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "mts", "webm", "wmv")
SKIPPED_FOLDERS = (".thumbnails", "@eaDir", "__pycache__")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEO)


def is_supported(path: Column, avif: bool = False, videos: bool = True) -> Column:
    return extension(path).isin(*RASTER, *HEIF, *RAW, *(["avif"] if avif else []), *(VIDEO if videos else []))


def visible(path: Column) -> Column:
    """No part of the path is hidden or a service folder."""
    bad = "|".join(s.replace(".", r"\.") for s in SKIPPED_FOLDERS)
    return ~path.rlike(rf"(^|/)(\.[^/]+|{bad})(/|$)")


def media_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, file_size, mtime (and content) of all media under root; contents are read only if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.regexp_replace("path", F.lit("^" + root.rstrip("/").replace("\\", "\\\\")), F.lit(""))
    cols = [F.col("path"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime")]
    return df.where(is_supported(F.col("path")) & visible(inside)).select(*cols, *(["content"] if content else []))


def changes(found: DataFrame, known: DataFrame, root: str | None = None, tolerance: float = 1.0) -> DataFrame:
    """path and status: new, changed (size, or time by more than the tolerance), same, or missing (known under root, no longer found)."""
    a, b = found.alias("f"), known.alias("k")
    j = a.join(b, F.col("f.path") == F.col("k.path"), "full_outer")
    moved = (F.col("f.file_size") != F.col("k.file_size")) | (F.abs(F.col("f.mtime") - F.col("k.mtime")) > tolerance)
    status = F.when(F.col("k.path").isNull(), "new").when(F.col("f.path").isNull(), "missing").when(F.coalesce(moved, F.lit(True)), "changed").otherwise("same")
    out = j.select(F.coalesce("f.path", "k.path").alias("path"), "k.image_id", status.alias("status"))
    if root is not None:
        inside = F.startswith("path", F.lit(root.rstrip("/") + "/"))
        out = out.where((F.col("status") != "missing") | inside)
    return out


def read_roots(spark: SparkSession, path: str) -> list[str]:
    """Roots stored as JSON lines; a name counts once, whatever its case."""
    rows = spark.read.schema("root string").json(path).where("root IS NOT NULL").collect()
    return list({r.root.rstrip("/").lower(): r.root.rstrip("/") for r in reversed(rows)}.values())[::-1]


def write_roots(spark: SparkSession, path: str, roots: list[str]) -> None:
    spark.createDataFrame([(r,) for r in roots], "root string").coalesce(1).write.mode("overwrite").json(path)


def with_root(roots: list[str], root: str) -> list[str]:
    """Roots with one more; a name that is there in other case stays as it is."""
    root = root.rstrip("/")
    return roots if root.lower() in {r.lower() for r in roots} else [*roots, root]


def without_root(roots: list[str], root: str) -> list[str]:
    return [r for r in roots if r.lower() != root.rstrip("/").lower()]


def read_curation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("person_id int, name string, hidden boolean, hashes array<string>").json(path)


def write_backup(path: str, people: DataFrame, albums: DataFrame, roots: list[str]) -> None:
    """A curation backup: people and albums as JSON lines, one a person or album, and the roots."""
    people.select("person_id", "name", "hidden", "hashes").write.mode("overwrite").json(f"{path}/people")
    albums.select("album_id", "name", "hashes").write.mode("overwrite").json(f"{path}/albums")
    write_roots(people.sparkSession, f"{path}/roots", roots)


def read_backup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    albums = spark.read.schema("album_id int, name string, hashes array<string>").json(f"{path}/albums")
    return read_curation(spark, f"{path}/people"), albums, read_roots(spark, f"{path}/roots")
