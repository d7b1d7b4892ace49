"""Online assignment: faces go one after another to known or new people.

Order decides, so decisions are made in one task; but that task sees a batch of faces and
the people near them alone. All people are compared with the batch's faces in parallel
before (shortlists), and the task proves by the shortlists that no absent person could
have mattered; where it cannot, the batch ends there and the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import UNASSIGNED
from ..shipping import ship
from ..storage import discard, saved
from .identity import EXEMPLAR_SLACK, EXEMPLARS, MARGIN, MATCH, MIN_QUALITY, SHORTLIST, STRONG, exemplars

BATCH, KEPT, CHUNK = 4096, 8, 256  # faces a batch; people kept a face (SHORTLIST at least); people compared at a time
LISTED = 4  # a face's list is so many times as long as what it brings to the task: what follows proves who is absent
NO_IMAGE = -(1 << 63)


def unit(v) -> np.ndarray:
    v = np.asarray(v, float)
    return v / max(np.linalg.norm(v), 1e-12)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines, to 12 places: equal vectors tie whatever the shape of the product."""
    return np.round(a @ b, 12)


@dataclass
class PersonState:
    """Running weighted mean of a person on the unit sphere.

    image is the last one the person was on. shown is the centroid before that image, by
    which it is found while the image lasts: None if it has not changed since, empty if
    the person was made there.
    """

    person_id: int
    centroid: np.ndarray
    weight: float
    faces: int = 0
    cover: int = -1
    cover_quality: float = -1.0
    exemplars: list[tuple[float, np.ndarray]] = field(default_factory=list)
    fresh: bool = False
    dirty: bool = False
    image: int = NO_IMAGE
    shown: np.ndarray | None = None

    def absorb(self, v: np.ndarray, quality: float) -> None:
        w = max(quality, 1e-3)
        m = self.centroid * self.weight + v * w
        self.centroid, self.weight = m / max(np.linalg.norm(m), 1e-12), self.weight + w
        self.exemplars = sorted([*self.exemplars, (quality, v)], key=lambda e: -e[0])[:EXEMPLARS]


class Assigner:
    """Sequential assignment of observed faces to the people given. Centroids by which people are found change between images, not within one."""

    def __init__(self, people: list[PersonState], next_id: int, match: float = MATCH, strong: float = STRONG, min_quality: float = MIN_QUALITY, image: int | None = None):
        if strong < match:
            raise ValueError("strong is below match")
        self.people, self.next_id = {p.person_id: p for p in people}, next_id
        self.match, self.strong, self.min_quality, self.floor = match, strong, min_quality, match - EXEMPLAR_SLACK
        self.image = image
        self._ids, self._rows, self._at = np.zeros(0, np.int64), np.zeros((0, 0)), {}
        self._waiting: set[int] = set()
        for p in people:
            if p.image == image and p.shown is not None:
                self._waiting.add(p.person_id)
                if len(p.shown):
                    self._set(p.person_id, p.shown)
            else:
                p.shown = None
                self._set(p.person_id, p.centroid)

    def _set(self, person: int, v: np.ndarray) -> None:
        at = self._at.get(person)
        if at is None:
            at = self._at[person] = len(self._at)
            if at >= len(self._ids):
                more = max(64, 2 * at)
                ids, rows = np.zeros(more, np.int64), np.zeros((more, len(v)))
                ids[:at], rows[:at] = self._ids[:at], self._rows[:at, : len(v)] if at else 0
                self._ids, self._rows = ids, rows
        self._ids[at], self._rows[at] = person, v

    def begin(self, image: int | None) -> None:
        """Another image: what was learnt on the last one counts from now on."""
        for i in self._waiting:
            self._set(i, self.people[i].centroid)
            self.people[i].shown = None
        self._waiting = set()
        self.image = image

    def nearest(self, v: np.ndarray) -> list[tuple[float, int]]:
        """Best people by centroid. Those below the floor decide nothing: they cannot match, nor make a match doubtful."""
        n = len(self._at)
        if not n:
            return []
        sims = alike(self._rows[:n], v)
        near = np.nonzero(sims >= self.floor)[0]
        order = near[np.lexsort((self._ids[near], -sims[near]))][:SHORTLIST]
        return [(float(sims[i]), int(self._ids[i])) for i in order]

    def decide(self, face: int, v: np.ndarray, quality: float, absent: tuple[float, int] | None = None) -> int | None:
        """The person of a face; None where people that were not given, none before `absent` (cosine, id), may be among the nearest."""
        near = self.nearest(v)
        if absent is not None and (len(near) < SHORTLIST or (-near[-1][0], near[-1][1]) > (-absent[0], absent[1])):
            return None
        found = []
        for s, i in near:
            p = self.people[i]
            if p.image != self.image:  # once an image
                found.append((max([s, *(float(alike(e, v)) for _, e in p.exemplars)]), i))
        found.sort(key=lambda c: (-c[0], c[1]))
        best = found[0] if found else (-1.0, UNASSIGNED)
        second = found[1][0] if len(found) > 1 else -1.0
        usable = quality >= self.min_quality
        who, learn = UNASSIGNED, False
        if best[0] >= self.strong or best[0] >= self.match and best[0] - second >= MARGIN:
            who, learn = best[1], usable
        elif best[0] >= self.match:
            who = best[1]
        elif usable:
            who, learn = self.next_id, True
            self.people[who] = PersonState(who, np.zeros_like(v), 0.0, fresh=True)
            self.next_id += 1
        if who == UNASSIGNED:
            return who
        p = self.people[who]
        p.faces, p.dirty, p.image = p.faces + 1, True, self.image
        if quality > p.cover_quality:
            p.cover, p.cover_quality = face, quality
        if learn:
            p.shown = p.centroid if p.weight else np.zeros(0)
            p.absorb(v, quality)
            self._waiting.add(who)
        return who

    def assign(self, faces: list[tuple[int, np.ndarray, float, float]]) -> list[tuple[int, int]]:
        """(face id, person) of the faces (id, unit vector, quality, detector score) of one image, best first."""
        self.begin((-1 if self.image is None else self.image) + 1)
        return [(face, self.decide(face, v, q)) for face, v, q, _ in sorted(faces, key=lambda f: (-f[2], -f[3], f[0]))]


STATE = "centroid array<double>, weight double, face_count int, cover_face_id bigint, cover_quality double, exemplars array<struct<quality: double, vector: array<double>>>, fresh boolean, dirty boolean, image bigint, shown array<double>"
_COLUMNS = ["person_id", "centroid", "weight", "face_count", "cover_face_id", "cover_quality", "exemplars", "fresh", "dirty", "image", "shown"]


def _or_null(df: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers that may be missing, as pandas' own kind."""
    return df.astype({c: t for c, t in {"face_id": "Int64", "person_id": "Int32", "face_count": "Int32", "cover_face_id": "Int64", "fresh": "boolean", "dirty": "boolean", "image": "Int64"}.items() if c in df.columns})


def _read(r) -> PersonState:
    kept = [(float(e["quality"]), np.asarray(e["vector"], float)) for e in r.exemplars] if r.exemplars is not None else []
    return PersonState(int(r.person_id), np.asarray(r.centroid, float), float(r.weight), int(r.face_count), int(r.cover_face_id), float(r.cover_quality), kept, bool(r.fresh), bool(r.dirty), int(r.image), None if r.shown is None else np.asarray(r.shown, float))


def _written(p: PersonState) -> tuple:
    return p.person_id, p.centroid, p.weight, p.faces, p.cover, p.cover_quality, [{"quality": q, "vector": v} for q, v in p.exemplars], p.fresh, p.dirty, p.image, p.shown


def known_states(people: DataFrame, size: int) -> DataFrame:
    """States of stored people with centroids of `size` components: a weight of 0.6 a face, one face at least; exemplars are looked up when they are needed (null)."""
    count = F.coalesce("face_count", F.lit(0)).cast("int")
    return people.where(F.col("person_id").isNotNull() & (F.size("centroid") == size)).select(
        F.col("person_id").cast("int").alias("person_id"), F.col("centroid").cast("array<double>").alias("centroid"), (F.greatest(count, F.lit(1)) * 0.6).alias("weight"), count.alias("face_count"), F.coalesce("cover_face_id", F.lit(-1)).cast("bigint").alias("cover_face_id"),
        F.lit(-1.0).alias("cover_quality"), F.lit(None).cast("array<struct<quality: double, vector: array<double>>>").alias("exemplars"), F.lit(False).alias("fresh"), F.lit(False).alias("dirty"), F.lit(NO_IMAGE).cast("bigint").alias("image"), F.lit(None).cast("array<double>").alias("shown"),
    )


def shortlists(states: DataFrame, faces: pd.DataFrame, floor: float, kept: int = KEPT) -> DataFrame:
    """(nth, person_id, sim, rank): for each face (nth, image_id, unit vector; a batch) the `kept` people nearest by centroid, none below floor. Every part of the people is compared with the batch by matrix products."""
    spark = states.sparkSession
    given = spark.sparkContext.broadcast((faces.nth.to_numpy(), faces.image_id.to_numpy(), np.stack(list(faces.vector)).T))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, images, columns = given.value
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            for lo in range(0, len(b), CHUNK):
                part = b.iloc[lo : lo + CHUNK]
                sims = alike(np.stack([np.asarray(c, float) for c in part.centroid]), columns)
                for j, (image, shown) in enumerate(zip(part.image, part.shown)):
                    if shown is not None:  # on its last image a person is found as it was before
                        here = images == image
                        sims[j, here] = alike(np.asarray(shown, float), columns[:, here]) if len(shown) else -2
                p, f = np.nonzero(sims >= floor)
                face, person, sim = (np.concatenate(x) for x in zip(best, (f, part.person_id.to_numpy(np.int64)[p], sims[p, f])))
                order = np.lexsort((person, -sim, face))
                face, person, sim = face[order], person[order], sim[order]
                first = np.searchsorted(face, face)
                top = np.arange(len(face)) - first < kept
                best = face[top], person[top], sim[top]
        yield pd.DataFrame({"nth": ids[best[0]], "person_id": best[1], "sim": best[2]})

    w = Window.partitionBy("nth").orderBy(F.desc("sim"), "person_id")
    found = states.select("person_id", "centroid", "image", "shown").mapInPandas(near, "nth bigint, person_id int, sim double")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kept)


def _replay(match: float, strong: float, min_quality: float, next_id: int):
    def run(faces: pd.DataFrame, people: pd.DataFrame) -> pd.DataFrame:
        faces = faces.sort_values("nth")
        images = faces.image_id.to_numpy()
        a = Assigner([_read(r) for r in people.sort_values("person_id").itertuples(index=False)], next_id, match, strong, min_quality, int(images[0]) if len(images) else None)
        out = []
        for image, r in zip(images, faces.itertuples(index=False)):
            if image != a.image:
                a.begin(int(image))
            # On the first image people are as the shortlists saw them.
            absent = None if image == images[0] or pd.isna(r.last_id) else (float(r.last_sim), int(r.last_id))
            who = a.decide(int(r.face_id), unit(r.vector), float(r.quality), absent)
            if who is None:
                break
            out.append((int(r.face_id), who, *[None] * (len(_COLUMNS) - 1)))
        out += [(None, *_written(p)) for p in a.people.values() if p.dirty]
        return _or_null(pd.DataFrame(out, columns=["face_id", *_COLUMNS]))

    return run


def _known(size: int) -> Column:
    return F.coalesce((F.size("vector") == size) & F.col("image_id").isNotNull(), F.lit(False))


def _in_order(faces: DataFrame) -> DataFrame:
    """Faces with their place (nth) by image, then best first."""
    order = ["image_id", F.desc("quality"), F.desc("det_score"), "face_id"]
    plain = faces.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("face_id").cast("bigint").alias("face_id"), "vector", F.coalesce("quality", F.lit(0.0)).cast("double").alias("quality"), F.coalesce("det_score", F.lit(0.0)).cast("double").alias("det_score"))
    parts = saved(faces.sparkSession, plain.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "online-faces")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # one row a partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = parts.join(F.broadcast(offsets), "part").select("image_id", "face_id", "vector", "quality", (F.col("before") + nth - 1).alias("nth"))
    return saved(faces.sparkSession, placed.sortWithinPartitions("nth"), "online-order")


def assign_states(faces: DataFrame, people: DataFrame, known_faces: DataFrame | None = None, next_id: int | None = None, match: float = MATCH, strong: float = STRONG, min_quality: float = MIN_QUALITY, batch: int = BATCH, kept: int = KEPT) -> DataFrame:
    """(face_id, person_id) of new faces and, without a face id, the state of each person that is new or has changed.

    Faces (image_id, face_id, vector, quality, det_score) go in order of image, then best
    first; an image of any size may be cut between batches. A batch's task holds `batch`
    faces and at most `kept` people a face with their exemplars, however many people there
    are; known_faces are read for these people alone. Faces without an image or a vector,
    or with a shorter one than others, are nobody's; those without an id are left out; null
    qualities count as 0; repeated rows are faces of their own; no faces give no rows.
    Further columns are not read.
    """
    if kept < SHORTLIST:
        raise ValueError("fewer people kept than a face is compared with")
    spark = faces.sparkSession
    ship(spark)
    faces = faces.where("face_id IS NOT NULL")
    size = faces.agg(F.max(F.size("vector"))).first()[0] or 0
    todo, states = _in_order(faces.where(_known(size))), saved(spark, known_states(people, size), "online-people")
    if next_id is None:
        top = people.agg(F.max("person_id")).first()[0]
        next_id = 0 if top is None else top + 1
    total, done, given = todo.count(), 0, []
    while done < total:
        part = todo.where((F.col("nth") >= done) & (F.col("nth") < done + batch))
        held = part.select("nth", "image_id", "vector").toPandas()  # a batch
        held["vector"] = [unit(v) for v in held.vector]
        near = saved(spark, shortlists(states, held, match - EXEMPLAR_SLACK, kept * LISTED), "online-near")
        here = near.where(F.col("rank") <= kept).select("person_id").distinct()
        # People of the image that the last batch ended in are met as they stand there.
        loaded = states.join(here, "person_id", "left_semi")
        if known_faces is not None:
            wanted = known_faces.join(loaded.where("exemplars IS NULL").select("person_id"), "person_id", "left_semi").where("vector IS NOT NULL")
            kept_faces = exemplars(wanted).groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("quality", F.lit(0.0)).cast("double").alias("quality"), F.transform("vector", lambda x: x.cast("double")).alias("vector")))).alias("found"))  # six a person
            loaded = loaded.join(kept_faces, "person_id", "left").withColumn("exemplars", F.coalesce("exemplars", F.transform("found", lambda x: F.struct(x["quality"].alias("quality"), x["vector"].alias("vector")))))
        # No absent person comes before the first on a face's list that no face brings, nor before the end of a full list.
        bound = near.join(here.withColumn("here", F.lit(True)), "person_id", "left").where((F.col("rank") == kept * LISTED) | F.col("here").isNull())
        last = bound.groupBy("nth").agg(F.min_by(F.struct("sim", "person_id"), "rank").alias("last")).select("nth", F.col("last.sim").alias("last_sim"), F.col("last.person_id").alias("last_id"))
        asked = part.join(last, "nth", "left").withColumn("batch", F.lit(0))
        run = _replay(match, strong, min_quality, next_id)
        there = loaded.select(*_COLUMNS, F.lit(0).alias("batch"))
        out = saved(spark, asked.groupBy("batch").cogroup(there.groupBy("batch")).applyInPandas(run, f"face_id bigint, person_id int, {STATE}"), "online-given")
        told = out.where("face_id IS NULL").drop("face_id")
        n, most = out.agg(F.count("face_id"), F.max("person_id")).first()
        given.append(out.where("face_id IS NOT NULL").select("face_id", "person_id"))
        next_id = max(next_id, (UNASSIGNED if most is None else most) + 1)
        if not n:
            raise RuntimeError("no face was decided")
        old, states = states, saved(spark, states.join(told.select("person_id"), "person_id", "left_anti").unionByName(told), "online-people")
        discard(old), discard(near)
        done += n
        if len(given) > 64:  # keeps the plan of the result short
            given = [saved(spark, _union(given), "online-all")]
    blank = faces.where(~_known(size)).select(F.col("face_id").cast("bigint").alias("face_id"), F.lit(UNASSIGNED).cast("int").alias("person_id"))
    changed = states.where("dirty").select(F.lit(None).cast("bigint").alias("face_id"), "person_id", F.transform("centroid", lambda x: x.cast("float")).alias("centroid"), "face_count", "cover_face_id", "fresh")
    return _union([*given, blank]).unionByName(changed, allowMissingColumns=True)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assign_online(faces: DataFrame, people: DataFrame, known_faces: DataFrame | None = None, next_id: int | None = None, **kw) -> DataFrame:
    """(face_id, person_id) of new faces, as assign_states gives them."""
    return assign_states(faces, people, known_faces, next_id, **kw).where("face_id IS NOT NULL").select("face_id", "person_id")
