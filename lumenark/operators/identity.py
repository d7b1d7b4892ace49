"""People: denormalisation, suggestions, reclustering, mutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..library import Library, NotFound, Snapshot, changed
from ..schemas import UNASSIGNED
from ..storage import saved
from . import vectors
from .aggregates import centroids
from .graph import with_components

MATCH, STRONG, MARGIN, MIN_QUALITY = 0.38, 0.55, 0.04, 0.25
CLUSTER, NEIGHBOURS = 0.42, 20
#: Candidates that are looked up as constants.
FEW = 4096
EXEMPLARS, SHORTLIST, EXEMPLAR_SLACK = 6, 5, 0.15


def people_of_images(faces: DataFrame) -> DataFrame:
    """Sorted distinct people and number of faces by image, unassigned faces counted but not named."""
    named = F.when(F.col("person_id") >= 0, F.col("person_id"))
    return faces.groupBy("image_id").agg(F.array_sort(F.collect_set(named)).alias("people_ids"), F.count("*").cast("int").alias("face_count"))


def denormalised(images: DataFrame, faces: DataFrame) -> DataFrame:
    """Images with people_ids made anew; an image without faces has an empty list."""
    got = people_of_images(faces).select("image_id", F.col("people_ids").alias("__p"))
    out = images.join(got, "image_id", "left")
    return out.withColumn("people_ids", F.coalesce("__p", F.array().cast("array<int>"))).drop("__p")


def best_faces(faces: DataFrame, person_id: int | None = None, limit: int = 60, min_quality: float | None = None) -> DataFrame:
    """A person's faces, or unassigned faces, best first."""
    df = faces.where(F.col("person_id") == (UNASSIGNED if person_id is None else person_id))
    if min_quality is not None:
        df = df.where(F.col("quality") >= min_quality)
    return df.orderBy(F.desc("quality"), F.asc("face_id")).limit(limit)


def exemplars(faces: DataFrame, per_person: int = EXEMPLARS) -> DataFrame:
    w = Window.partitionBy("person_id").orderBy(F.desc("quality"), F.asc("face_id"))
    return faces.where("person_id >= 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_person)


def face_search(faces: DataFrame, vector: list[float], limit: int = 60, min_similarity: float = 0.3, unassigned_only: bool = False) -> DataFrame:
    allowed = F.col("person_id") == UNASSIGNED if unassigned_only else None
    return vectors.top_k(faces, vector, limit, "face_id", allowed=allowed, min_score=min_similarity)


def person_suggestions(faces: DataFrame, centroid: list[float], limit: int = 60, min_similarity: float = MATCH) -> DataFrame:
    """Unassigned faces that nobody rejected, near a person."""
    allowed = (F.col("person_id") == UNASSIGNED) & ~F.coalesce("confirmed", F.lit(False))
    return vectors.top_k(faces, centroid, limit, "face_id", allowed=allowed, min_score=min_similarity)


def merge_suggestions(people: DataFrame, images: DataFrame, limit: int = 20, min_similarity: float = CLUSTER, dismissed: DataFrame | None = None, broadcast_bytes: int = vectors.BROADCAST_BYTES) -> DataFrame:
    """Pairs of visible people that look alike and never share a photo; the named, then the more photographed, then the older one is the target.

    The most similar pairs are taken first, a few times the limit, and vetoes applied to
    them alone; photos are counted for their people alone. Only if too few are left that
    go before all others are more taken, so pairs are never listed in full.
    """
    spark = people.sparkSession
    zero = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x) <= 0
    alive = people.where(~F.coalesce("hidden", F.lit(False)) & F.col("centroid").isNotNull() & ~zero)
    lists = images.select("image_id", F.col("people_ids").cast("array<bigint>").alias("ps"))
    n = 8 * limit
    while True:
        near = saved(spark, vectors.top_pairs(alive, n, min_similarity, "person_id", "centroid", broadcast_bytes), "pairs")
        # Only candidate pairs are looked up in the photos and among the dismissed; photo pairs are never made.
        wanted = near.select(F.explode(F.array("a", "b")).alias("p")).distinct()  # 2 n ids at most
        ids = [r.p for r in wanted.limit(FEW + 1).collect()]
        few, gone = lists, dismissed
        if len(ids) <= FEW:  # as constants they filter the tables that photos and dismissed pairs are made of
            few = few.where(F.arrays_overlap("ps", F.lit(ids).cast("array<bigint>")))
            gone = gone.where(F.col("a").isin(ids) & F.col("b").isin(ids)) if gone is not None else None
        few = saved(spark, few.select("image_id", F.explode("ps").alias("p")).join(F.broadcast(wanted), "p", "left_semi"), "photos")
        together = F.broadcast(near).join(few.withColumnRenamed("p", "a"), "a").select("a", "b", "image_id").join(few.withColumnRenamed("p", "b").hint("merge"), ["b", "image_id"], "left_semi").select("a", "b").distinct()
        pairs = near.join(together, ["a", "b"], "left_anti")
        if gone is not None:
            pairs = pairs.join(gone.join(F.broadcast(near.select("a", "b")), ["a", "b"], "left_semi"), ["a", "b"], "left_anti")
        photos = few.groupBy(F.col("p").alias("id")).agg(F.count("*").alias("photos"))
        who = people.select(F.col("person_id").cast("bigint").alias("id"), "name").join(F.broadcast(wanted.select(F.col("p").alias("id"))), "id", "left_semi").join(photos, "id", "left")
        who = who.select("id", F.struct((F.trim(F.coalesce("name", F.lit(""))) != "").alias("named"), F.coalesce("photos", F.lit(0)).alias("photos"), (-F.col("id")).alias("old")).alias("rank"))
        both = pairs.join(who.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(who.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
        first = F.col("ra") >= F.col("rb")
        out = saved(spark, both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("source_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("target_id"), "score"), "pairs-left")
        found, worst = near.agg(F.count("*"), F.min("score")).first()
        last = near.where(F.col("score") == worst).agg(F.max("a")).first()[0] if found else None
        # What was not taken is no better, and of the same score only with ids from the last one's on.
        ahead = (F.col("score") > worst) | (F.col("score") == worst) & (F.col("source_id") < last)
        if found < n or out.where(ahead).count() >= limit:
            break
        n *= 8
    return out.orderBy(F.desc("score"), "source_id", "target_id").limit(limit).transform(vectors.shown)


def mutual_knn_clusters(faces: DataFrame, k: int = NEIGHBOURS, threshold: float = CLUSTER, id_: str = "face_id", vector: str = "vector") -> DataFrame:
    """(id, label): components of edges that are among the k nearest of both ends."""
    edges = vectors.mutual(vectors.knn(faces, k, threshold, id_, vector)).select("a", "b")
    return with_components(faces.where(F.col(vector).isNotNull()).select(F.col(id_).cast("bigint").alias("node")), edges).select(F.col("node").alias(id_), "label")


@dataclass(frozen=True)
class Reclustered:
    people: DataFrame
    faces: DataFrame


def recluster(faces: DataFrame, people: DataFrame, k: int = NEIGHBOURS, threshold: float = CLUSTER, min_size: int = 2, respect_confirmed: bool = True) -> Reclustered:
    """People made anew from face clusters.

    A cluster stays if it has min_size usable faces or a confirmed one. If its confirmed
    members are of one person, that person anchors it and keeps the name; clusters with
    none, or with two, are numbered after the confirmed ids. Usable faces make the
    centroid and the cover, or all faces where none is usable.
    """
    spark = faces.sparkSession

    labelled = faces.join(mutual_knn_clusters(faces, k, threshold), "face_id")
    confirmed = F.coalesce("confirmed", F.lit(False)) & F.lit(respect_confirmed)
    anchors = labelled.where(confirmed & (F.col("person_id") >= 0)).groupBy("label").agg(F.min("person_id").alias("anchor"), F.max("person_id").alias("other")).where("anchor = other").drop("other")
    stat = labelled.groupBy("label").agg(F.count_if(F.coalesce("quality", F.lit(0.0)) >= MIN_QUALITY).alias("usable"), F.count_if(F.coalesce("confirmed", F.lit(False))).alias("confirmed"))
    kept = stat.where((F.col("usable") >= min_size) | (F.col("confirmed") > 0)).join(anchors, "label", "left")
    top = faces.where(confirmed).agg(F.max("person_id")).first()[0]
    start = (-1 if top is None else max(top, -1)) + 1
    fresh = kept.where("anchor IS NULL")
    ranged = saved(spark, fresh.select("label").repartitionByRange("label").withColumn("part", F.spark_partition_id()), "clusters")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # one row per partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy("label"))
    numbered = ranged.join(F.broadcast(offsets), "part").select("label", (F.lit(start - 1) + F.col("before") + nth).cast("int").alias("person_id"))
    ids = kept.where("anchor IS NOT NULL").select("label", F.col("anchor").alias("person_id")).unionByName(numbered)
    assigned = labelled.join(ids.withColumnRenamed("person_id", "new_id"), "label", "left")
    out = faces.join(assigned.select("face_id", "new_id"), "face_id", "left").withColumn("person_id", F.coalesce("new_id", F.lit(UNASSIGNED)).cast("int")).select(*faces.columns)
    out = saved(spark, out, "faces")
    names = people.join(anchors.select(F.col("anchor").alias("person_id")).distinct(), "person_id", "left_semi").select("person_id", "name")
    of, good = out.where("person_id >= 0"), F.coalesce("quality", F.lit(0.0)) >= MIN_QUALITY
    sizes = of.groupBy("person_id").agg(F.count("*").alias("members"), F.count_if(good).alias("usable"))
    defining = of.join(sizes.where("usable = 0").select("person_id", F.lit(True).alias("poor")), "person_id", "left").where(good | F.col("poor"))
    made = centroids(defining).drop("face_count").join(sizes.select("person_id", F.col("members").alias("face_count")), "person_id").join(names, "person_id", "left")
    rows = made.select("person_id", F.coalesce("name", F.lit("")).alias("name"), F.col("centroid").cast("array<float>").alias("centroid"), F.col("face_count").cast("int").alias("face_count"), "cover_face_id", F.localtimestamp().alias("created_at"), F.lit(False).alias("hidden"))
    return Reclustered(rows, out)


def flushed(people: DataFrame, states: DataFrame) -> DataFrame:
    """People with the centroids, counts and covers of their new states, and the new people."""
    new = states.where("face_id IS NULL").select("person_id", *(F.col(c).alias(f"__{c}") for c in ("centroid", "face_count", "cover_face_id")), F.col("fresh"))
    df = people.join(new.where("NOT fresh").drop("fresh"), "person_id", "left")
    old = df.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in df.columns else F.col(c) for c in people.columns])
    made = new.where("fresh").select("person_id", F.lit("").alias("name"), F.col("__centroid").alias("centroid"), F.col("__face_count").alias("face_count"), F.col("__cover_face_id").alias("cover_face_id"), F.localtimestamp().alias("created_at"), F.lit(False).alias("hidden"))
    return old.unionByName(made)


def merged(faces: DataFrame, source: int, target: int) -> DataFrame:
    """Faces with one person's given to another."""
    return changed(faces, F.col("person_id") == source, {"person_id": F.lit(target).cast("int")})


class People:
    """Mutations on people and their faces; each is one commit, which writes the buckets of the touched faces, their images and the people alone."""

    def __init__(self, library: Library):
        self.lib, self.spark = library, library.spark

    def commit_faces(self, at: Snapshot, hit: Column, values: dict[str, Column], recompute: tuple[int, ...] = (), gone: int | None = None, made: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Faces where `hit` holds get new values (or, removed: the faces of these images go, with all rows of them); lists of people of their images and the people to recompute follow; a person goes or is made."""
        which = at.touched("faces", removed if removed is not None else hit)
        patched = self.lib.parts_without(at, removed, ["images", "faces", "ocr", "album_items"]) if removed is not None else {}
        if which != [] and removed is None:
            faces = changed(at.table("faces", buckets=which), hit, values)
            patched["faces"] = which, faces
            shared = which if at.buckets("images") == at.buckets("faces") else None
            # Faces of an image are in its bucket.
            patched["images"] = shared, denormalised(at.table("images", buckets=shared), faces if shared is not None or which is None else patched_table(at, "faces", which, faces))
        added = {"people": made} if made is not None else {}
        mine = sorted({*recompute} | ({gone} if gone is not None else set()))
        if mine:
            where = at.touched("people", self.spark.createDataFrame([(i,) for i in mine], "person_id int"))
            people = at.table("people", buckets=where)
            if made is not None:  # a new person is counted with the others, in one write
                fresh = at.touched("people", made)
                where = None if where is None else sorted({*where, *fresh})
                people, added = at.table("people", buckets=where).unionByName(made, allowMissingColumns=True), {}
            now = patched_table(at, "faces", *patched["faces"]) if "faces" in patched else at.table("faces")
            patched["people"] = where, recounted(people if gone is None else people.where(F.col("person_id") != gone), now, recompute)
        self.lib.commit({}, added=added, patched=patched, at=at, unchanged=("faces", "people") if mine or made is not None else ("faces",))

    def _need(self, person_id: int) -> None:
        self.lib.row("people", "person_id", person_id, ("person_id",))

    def rename(self, person_id: int, name: str) -> None:
        self._need(person_id)
        self.lib.update("people", F.col("person_id") == person_id, {"name": F.lit(name.strip())})

    def hide(self, person_id: int, hidden: bool = True) -> None:
        self._need(person_id)
        self.lib.update("people", F.col("person_id") == person_id, {"hidden": F.lit(hidden)})

    def _fresh(self, at: Snapshot, name: str) -> tuple[int, DataFrame]:
        top = at.table("people").agg(F.max("person_id")).first()[0]
        new = 0 if top is None else top + 1
        return new, self.spark.range(1).select(F.lit(new).alias("person_id"), F.lit(name.strip()).alias("name"), F.lit(0).alias("face_count"), F.lit(-1).cast("bigint").alias("cover_face_id"), F.localtimestamp().alias("created_at"), F.lit(False).alias("hidden"))

    def create(self, name: str = "") -> int:
        at = self.lib.snapshot()
        new, row = self._fresh(at, name)
        self.lib.append({"people": row}, at=at, unchanged=("people",))
        return new

    def merge(self, source: int, target: int) -> None:
        if source == target:
            raise ValueError("a person cannot be merged with itself")
        at = self.lib.snapshot()
        self._need(source), self._need(target)
        self.commit_faces(at, F.col("person_id") == source, {"person_id": F.lit(target).cast("int")}, (target,), gone=source)

    def delete(self, person_id: int) -> list[int]:
        """Faces become unassigned; the images it was on."""
        at = self.lib.snapshot()
        self._need(person_id)
        images = sorted(r[0] for r in at.table("faces").where(F.col("person_id") == person_id).select("image_id").distinct().collect())
        self.commit_faces(at, F.col("person_id") == person_id, {"person_id": F.lit(UNASSIGNED)}, gone=person_id)
        return images

    def assign(self, face_ids: list[int], person_id: int | None = None, name: str = "") -> int:
        """Confirms faces as a person's, an existing or a new one."""
        at, hit = self.lib.snapshot(), F.col("face_id").isin(*face_ids)
        old = [r[0] for r in at.table("faces").where(hit).select("person_id").distinct().collect()]
        if not old:
            raise NotFound("faces")
        made = None
        if person_id is None:
            person_id, made = self._fresh(at, name)
        else:
            self._need(person_id)
        self.commit_faces(at, hit, {"person_id": F.lit(person_id), "confirmed": F.lit(True)}, tuple({*old, person_id} - {UNASSIGNED}), made=made)
        return person_id

    def detach(self, face_ids: list[int]) -> None:
        """Faces that are nobody's, and stay so."""
        at, hit = self.lib.snapshot(), F.col("face_id").isin(*face_ids)
        old = [r[0] for r in at.table("faces").where(hit).select("person_id").distinct().collect()]
        self.commit_faces(at, hit, {"person_id": F.lit(UNASSIGNED), "confirmed": F.lit(True)}, tuple({*old} - {UNASSIGNED}))

    def remove_images(self, ids: DataFrame) -> None:
        """Images with all their rows; people on them are counted anew, in the same commit."""
        at = self.lib.snapshot()
        touched = [r[0] for r in at.table("faces").join(F.broadcast(ids), "image_id").where("person_id >= 0").select("person_id").distinct().collect()]
        self.commit_faces(at, F.lit(True), {}, tuple(touched), removed=ids)

    def recluster(self, **kw) -> None:
        at = self.lib.snapshot()
        made = recluster(at.table("faces"), at.table("people"), **kw)
        self.lib.commit({"faces": made.faces, "people": made.people, "images": denormalised(at.table("images"), made.faces)}, at=at)


def patched_table(at: Snapshot, name: str, which: list[int] | None, rows: DataFrame) -> DataFrame:
    """A table with new rows in some buckets."""
    rest = [] if which is None else [b for b in range(at.buckets(name)) if b not in which]
    return rows.unionByName(at.table(name, buckets=rest)) if rest else rows


def recounted(people: DataFrame, faces: DataFrame, ids: tuple[int, ...]) -> DataFrame:
    """People with the centroids, counts and covers of their faces made anew for some; one who lost all faces keeps the old centroid."""
    if not ids:
        return people
    mine = F.col("person_id").isin(*ids)
    made = centroids(faces.where(mine)).select("person_id", F.col("centroid").alias("c"), F.col("face_count").alias("n"), F.col("cover_face_id").alias("f"))
    df = people.join(made, "person_id", "left")
    new = {"centroid": F.coalesce(F.col("c").cast("array<float>"), "centroid"), "face_count": F.coalesce(F.col("n").cast("int"), F.lit(0)), "cover_face_id": F.coalesce("f", F.lit(-1).cast("bigint"))}
    return df.select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in people.columns])
