"""Explicit schemas of a media library; only the vector length varies, and arrays do not fix it."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

SCHEMA_VERSION = 2
UNASSIGNED = -1
_DDL = {
    "images": "image_id bigint not null, vector array<float>, path string not null, filename string, folder string, taken_at timestamp_ntz, added_at timestamp_ntz, width int, height int, file_size bigint, mtime double, content_hash string, phash bigint, lat double, lon double, place string, camera string, people_ids array<int>, face_count int, media_type string, duration_ms bigint",
    "faces": "face_id bigint not null, vector array<float>, image_id bigint not null, person_id int not null, x int, y int, w int, h int, det_score float, quality float, confirmed boolean, crop_path string",
    "people": "person_id int not null, name string, centroid array<float>, face_count int, cover_face_id bigint, created_at timestamp_ntz, hidden boolean",
    "ocr": "image_id bigint not null, text string, engine string, updated_at timestamp_ntz",
    "albums": "album_id int not null, name string, created_at timestamp_ntz, cover_image_id bigint",
    "album_items": "album_id int not null, image_id bigint not null, added_at timestamp_ntz",
    "meta": "key string not null, value string",
}


@cache
def schema(name: str) -> StructType:
    """Parsed by the session, so only when first needed; workers import this module without one."""
    return StructType.fromDDL(_DDL[name])


CORE_TABLES, LAZY_TABLES = ("images", "faces", "people", "meta"), ("ocr", "albums", "album_items")
#: Columns that older libraries lack, with their defaults.
MEDIA_DEFAULTS = {"media_type": "image", "duration_ms": 0}
LIST_COLUMNS = ("image_id", "path", "filename", "folder", "taken_at", "width", "height", "lat", "lon", "camera", "people_ids", "face_count", "media_type")
