"""Browsing: filters, orders, pages, histograms, text match, hydration."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..library import all_of
from . import vectors as V

PAGE, MAX_PAGE, CANDIDATES = 60, 200, 1000
KM_PER_DEGREE = 111.32


def _naive(t: datetime) -> datetime:
    """Bounds are UTC; a bound with a zone is converted."""
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def parse_bound(text: str) -> datetime:
    """A date or time as text, with `Z`, an offset or none (UTC)."""
    return _naive(datetime.fromisoformat(text.strip()))


def folder_key(c: Column) -> Column:
    return F.rtrim(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), F.lit("/"))


def under(folder: Column, root: Column) -> Column:
    """True for the root itself and all below it; case matters."""
    f, r = folder_key(folder), folder_key(root)
    return (f == r) | F.startswith(f, F.concat(r, F.lit("/")))


@dataclass(frozen=True)
class Filters:
    """Predicates that hold together; an unset one always holds."""

    start: datetime | None = None
    end: datetime | None = None
    people: tuple[int, ...] = field(default=())
    people_mode: str = "any"
    has_location: bool | None = None
    near: tuple[float, float] | None = None
    radius_km: float = 5.0
    has_faces: bool | None = None
    media: str | None = None
    untagged: bool = False
    camera: str | None = None
    folder: str | None = None

    def is_empty(self) -> bool:
        return self == Filters(people_mode=self.people_mode, radius_km=self.radius_km)

    def column(self, people: bool = True) -> Column:
        """As one predicate; without the people's if those are met by a join."""
        on, wanted = [], self.people if people else ()
        named = F.coalesce("people_ids", F.array().cast("array<int>"))
        located = F.col("lat").isNotNull() & ~F.isnan("lat")
        if self.start:
            on.append(F.col("taken_at") >= F.lit(_naive(self.start)).cast("timestamp_ntz"))
        if self.end:
            on.append(F.col("taken_at") <= F.lit(_naive(self.end)).cast("timestamp_ntz"))
        if wanted and self.people_mode == "all":
            on += [F.array_contains(named, p) for p in wanted]
        elif wanted:
            on.append(F.arrays_overlap(named, F.array(*[F.lit(p).cast("int") for p in wanted])))
        if self.has_location is not None:
            on.append(located if self.has_location else ~located)
        if self.near:
            lat, lon = self.near
            dy = (F.col("lat") - lat) * KM_PER_DEGREE
            dx = (F.col("lon") - lon) * KM_PER_DEGREE * F.cos(F.radians(F.lit(lat)))
            on.append(F.coalesce(dx * dx + dy * dy <= self.radius_km**2, F.lit(False)))
        if self.has_faces is not None:
            on.append((F.coalesce("face_count", F.lit(0)) > 0) == F.lit(self.has_faces))
        if self.media:
            video = F.coalesce(F.col("media_type"), F.lit("image")) == "video"
            on.append(video if self.media == "video" else ~video)
        if self.untagged:
            on.append((F.coalesce("face_count", F.lit(0)) > 0) & (F.size(named) == 0))
        if self.camera:
            on.append(F.lower(F.trim("camera")) == self.camera.strip().lower())
        if self.folder is not None:
            on.append(under(F.col("folder"), F.lit(self.folder)))
        return all_of(on)


def select(images: DataFrame, filters: Filters, faces: DataFrame | None = None) -> DataFrame:
    """Images that pass. With faces, people are looked up there: the other filters reach the scan of images, the people's that of faces, and no list of people is made."""
    if faces is None or not filters.people:
        return images.where(filters.column())
    left = images.where(filters.column(people=False))
    hits = faces.where(F.col("person_id").isin(*filters.people)).select("image_id", "person_id")
    if filters.people_mode == "all":
        hits = hits.groupBy("image_id").agg(F.countDistinct("person_id").alias("n")).where(F.col("n") == len(set(filters.people)))
    return left.join(hits.select("image_id"), "image_id", "left_semi")


ORDERS = {
    "date_desc": lambda: [F.desc_nulls_last("taken_at"), F.desc("image_id")],
    "date_asc": lambda: [F.asc_nulls_last("taken_at"), F.asc("image_id")],
    "added_desc": lambda: [F.desc(F.coalesce("added_at", F.lit("1970-01-01").cast("timestamp_ntz"))), F.desc("image_id")],
}


def ordering(sort: str, seed: int = 0) -> list[Column]:
    """Undated images come last in either direction; ties go by id; random depends on id and seed alone."""
    if sort == "random":
        return [F.xxhash64("image_id", F.lit(seed)), F.asc("image_id")]
    if sort == "relevance":
        sort = "date_desc"
    if sort not in ORDERS:
        raise ValueError(f"no order {sort}")
    return ORDERS[sort]()


def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int | None = None) -> DataFrame:
    """One page: a top-k with an offset, never a full sort."""
    size = max(1, min(per_page or PAGE, MAX_PAGE))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def hydrate(spark: SparkSession, images: DataFrame, ids: list[int], columns: list[str]) -> DataFrame:
    """Rows of the ids in the caller's order; unknown ids are left out. The ids are one page."""
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "image_id bigint, pos int")
    return images.select(*columns).join(F.broadcast(wanted), "image_id").orderBy("pos")


def tokens(query: str) -> list[str]:
    return [t for t in query.lower().split() if len(t) >= 2]


def text_match(texts: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows whose lower-cased text contains every token; a query of short tokens matches nothing."""
    words = tokens(query)
    if not words:
        return texts.limit(0)
    low = F.lower(F.col(text))
    return texts.where(all_of([F.contains(low, F.lit(w)) for w in words]))


def attach_text(images: DataFrame, ocr: DataFrame) -> DataFrame:
    """Orphaned texts are left out; unscanned images have none."""
    return images.join(ocr.select("image_id", "text"), "image_id", "left")


def month_histogram(images: DataFrame) -> DataFrame:
    return images.where("taken_at IS NOT NULL").groupBy(F.date_format("taken_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).orderBy("month")


def hybrid(text_hits: DataFrame, semantic: DataFrame) -> DataFrame:
    """Text hits first, then semantic hits that are not text hits, which alone have a score. Inputs: image_id, and image_id with score."""
    first = text_hits.select("image_id", F.lit(0).alias("tier"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("text_match"))
    rest = semantic.join(text_hits.select("image_id"), "image_id", "left_anti")
    return first.unionByName(rest.select("image_id", F.lit(1).alias("tier"), "score", F.lit(False).alias("text_match")))


def search(images: DataFrame, ocr: DataFrame | None, query: str | None, vectors: DataFrame | None = None, vector: list[float] | None = None, filters: Filters = Filters(), sort: str = "relevance", number: int = 1, per_page: int | None = None, min_score: float | None = None, candidates: int = CANDIDATES, faces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all hits, one page). Filters come first: text hits and the best `candidates` by vector (image_id, vector) are taken among images that pass.

    By relevance, text hits come before the rest, newest first, then the rest by score.
    With another order both kinds of hits are one set without scores.
    """
    chosen = select(images, filters, faces)
    if not (query and query.strip()):
        return chosen, page(chosen, ordering(sort), number, per_page)
    ids = chosen.select("image_id")
    hits = text_match(ocr, query).join(ids, "image_id", "left_semi").select("image_id") if ocr is not None else ids.limit(0)
    near = V.top_k(vectors, vector, candidates, allowed=ids, min_score=min_score) if vectors is not None and vector is not None else ids.limit(0).select("image_id", F.lit(0.0).alias("score"))
    found = chosen.join(hybrid(hits, near), "image_id")
    if sort != "relevance":
        found = found.drop("score", "tier", "text_match")
        return found, page(found, ordering(sort), number, per_page)
    order = [F.asc("tier"), F.desc_nulls_last("score"), *ordering("date_desc")]
    return V.shown(found), V.shown(page(found, order, number, per_page))


def card(images: DataFrame) -> DataFrame:
    """List rows: defaults for nulls, ISO dates, rounded coordinates, a file name from the path."""
    name = F.coalesce(F.nullif("filename", F.lit("")), F.regexp_extract(F.translate("path", "\\", "/"), r"([^/]*)$", 1))
    return images.select(
        "image_id", "path", name.alias("filename"), F.coalesce("folder", F.lit("")).alias("folder"), F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss").alias("taken_at"),
        F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        F.coalesce("camera", F.lit("")).alias("camera"), F.coalesce("people_ids", F.array().cast("array<int>")).alias("people_ids"), F.coalesce("face_count", F.lit(0)).alias("face_count"), F.coalesce("media_type", F.lit("image")).alias("media_type"),
    )
