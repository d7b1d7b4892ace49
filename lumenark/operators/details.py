"""One image in full, its faces, its text; removal of originals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..library import Library, NotFound
from .identity import People

EXCERPT, FACE_LIMIT = 800, 256


def faces_in_image(faces: DataFrame, image_id: int, limit: int = FACE_LIMIT) -> DataFrame:
    """Faces with a box, best first."""
    box = F.array("x", "y", "w", "h").alias("bbox")
    df = faces.where(F.col("image_id") == image_id).orderBy(F.desc("quality"), F.asc("face_id")).limit(limit)
    return df.select("face_id", "person_id", box, F.round("det_score", 3).alias("det_score"), F.round("quality", 3).alias("quality"), "confirmed")


def people_on_images(faces: DataFrame, people: DataFrame, face_id: str = "face_id") -> DataFrame:
    """(image_id, person_id, name, first_face): each person once an image, with the first of their faces there."""
    first = faces.where("person_id >= 0").groupBy("image_id", "person_id").agg(F.min(face_id).alias("first_face"))
    return first.join(people.select("person_id", "name"), "person_id").select("image_id", "person_id", "name", "first_face")


def largest_face(faces: DataFrame) -> list[float] | None:
    """Vector of the largest face: the query of a search by an uploaded picture."""
    got = faces.where(F.col("vector").isNotNull()).agg(F.max_by("vector", F.struct(F.col("w") * F.col("h"), -F.col("face_id")))).head()
    return list(got[0]) if got and got[0] is not None else None


def image_details(lib: Library, image_id: int) -> dict:
    """The row, its people, its faces and the start of its text."""
    row = lib.row("images", "image_id", image_id)
    mine = lib.table("faces").where(F.col("image_id") == image_id)
    return {
        "image": row.asDict(),
        "people": [r.asDict() for r in people_on_images(mine, lib.table("people")).orderBy("person_id").collect()],
        "faces": [r.asDict() for r in faces_in_image(mine, image_id).collect()],
        "text": ocr_text(lib, image_id)[:EXCERPT],
    }


def ocr_text(lib: Library, image_id: int) -> str:
    """All text of an image; empty if it was never scanned."""
    lib.row("images", "image_id", image_id, ("image_id",))
    if not lib.has("ocr"):
        return ""
    got = lib.table("ocr").where(F.col("image_id") == image_id).select("text").head()
    return (got.text or "") if got else ""


def trash_images(lib: Library, ids: list[int], send: Callable[[str], bool | None]) -> dict[str, int]:
    """Sends originals away through `send` (true: gone, none: was missing, an exception: failed), removes the rows of all that are gone and brings people up to date. The ids are one user's selection."""
    wanted = lib.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "image_id bigint")
    rows = lib.table("images", ("image_id", "path")).join(F.broadcast(wanted), "image_id").collect()
    if not rows:
        raise NotFound("images")
    out, gone = {"trashed": 0, "missing": 0, "failed": 0, "removed": 0}, []
    for r in rows:
        try:
            done = send(r.path)
        except OSError:
            out["failed"] += 1
            continue
        out["missing" if done is None else "trashed"] += 1
        gone.append((r.image_id,))
    if gone:
        left = lib.spark.createDataFrame(gone, "image_id bigint")
        People(lib).remove_images(left)
        out["removed"] = len(gone)
    return out
