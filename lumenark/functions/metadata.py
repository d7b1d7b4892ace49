"""Picture metadata: tags are taken from the bytes in batches, their meaning is columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import parsing as P
from .containers import heif_parts, video_facts, webp_parts

# Numbers of TIFF tags.
MAKE, MODEL, ORIENTATION, CHANGED, EXIF_PART, GPS_PART = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x8825
ORIGINAL, DIGITIZED = 0x9003, 0x9004
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
#: Bytes of one value by TIFF type, and how struct reads those that are used.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
READS = {1: "B", 3: "H", 4: "I", 9: "i"}

TAGS = "path string, make string, model string, original string, digitized string, changed string, orientation int, lat array<double>, lat_ref string, lon array<double>, lon_ref string, width int, height int, created string, duration_ms bigint"


def _directory(data: bytes, at: int, order: str) -> dict[int, object]:
    """Tags of one TIFF directory; values outside the data are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(data):
        return out
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        p = at + 2 + 12 * i
        if p + 12 > len(data):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", data, p)
        size = SIZES.get(kind, 0) * n
        where = p + 8 if size <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
        if not size or where + size > len(data):
            continue
        if kind == 2:
            out[tag] = data[where : where + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (5, 10):
            flat = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", data, where)
            out[tag] = [a / b if b else None for a, b in zip(flat[::2], flat[1::2], strict=True)]
        elif kind in READS:
            out[tag] = struct.unpack_from(order + READS[kind], data, where)[0]
    return out


def tiff_tags(data: bytes) -> dict[str, object]:
    """The tags above of a TIFF block: EXIF of other formats, or a raw file as it is."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return {}
    main = _directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
    exif, gps = (_directory(data, main[t], order) if isinstance(main.get(t), int) else {} for t in (EXIF_PART, GPS_PART))
    return {"make": main.get(MAKE), "model": main.get(MODEL), "changed": main.get(CHANGED), "orientation": main.get(ORIENTATION), "original": exif.get(ORIGINAL), "digitized": exif.get(DIGITIZED), "lat": gps.get(LAT), "lat_ref": gps.get(LAT_REF), "lon": gps.get(LON), "lon_ref": gps.get(LON_REF)}


def _jpeg(data: bytes) -> dict[str, object]:
    out, p = {}, 2
    while p + 4 <= len(data) and data[p] == 0xFF:
        kind, n = data[p + 1], struct.unpack_from(">H", data, p + 2)[0]
        if kind == 0xE1 and data[p + 4 : p + 10] == b"Exif\0\0":
            out |= tiff_tags(data[p + 10 : p + 2 + n])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = struct.unpack_from(">HH", data, p + 5)
            break
        p += 2 + n
    return out


def _png(data: bytes) -> dict[str, object]:
    out, p = {}, 8
    while p + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, p)
        if kind == b"IHDR":
            out["width"], out["height"] = struct.unpack_from(">II", data, p + 8)
        elif kind == b"eXIf":
            out |= tiff_tags(data[p + 8 : p + 8 + n])
        p += 12 + n
    return out


def picture_tags(data: bytes) -> dict[str, object]:
    """Tags and size of a picture or video of a known format. Sizes are those shown: exchanged where the picture lies on its side."""
    if data[:2] == b"\xff\xd8":
        out = _jpeg(data)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        out = _png(data)
    elif data[:4] in (b"GIF8",):
        out = dict(zip(("width", "height"), struct.unpack_from("<HH", data, 6), strict=True))
    elif data[:2] == b"BM":
        w, h = struct.unpack_from("<ii", data, 18)
        out = {"width": w, "height": abs(h)}
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        block, size = webp_parts(data)
        out = tiff_tags(block) | size
    elif data[4:8] == b"ftyp":
        block, size = heif_parts(data)
        # A turned picture says so in its boxes: its tags are not followed a second time.
        out = (tiff_tags(block) | {"orientation": None} | size) if size or block else video_facts(data)
    else:
        out = tiff_tags(data) or video_facts(data)
    if out.get("orientation") in (5, 6, 7, 8) and "width" in out:
        out["width"], out["height"] = out["height"], out["width"]
    return out


def read_tags(files: DataFrame) -> DataFrame:
    """One row of TAGS per file (path, content); a file that cannot be read has nulls."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in TAGS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    got = picture_tags(bytes(data))
                except Exception:
                    got = {}
                rows.append([path, *(got.get(n) for n in names[1:])])
            df = pd.DataFrame(rows, columns=names)
            yield df.astype({c: "Int32" for c in ("orientation", "width", "height")} | {"duration_ms": "Int64"})

    return files.select("path", "content").mapInPandas(run, TAGS)


def metadata(tags: DataFrame) -> DataFrame:
    """path, taken_at, lat, lon, camera, width, height, duration_ms. The first good date counts: original, digitized, changed, a video's own (UTC), the file's name."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    taken = F.coalesce(*(P.exif_date(F.col(c)) for c in ("original", "digitized", "changed", "created")), P.sane(P.filename_date(stem)))

    def degrees(c: str, ref: str):
        part = lambda i: F.coalesce(F.try_element_at(c, F.lit(i)), F.lit(0.0))
        return F.when(F.try_element_at(c, F.lit(1)).isNotNull(), P.dms(part(1), part(2), part(3), F.coalesce(ref, F.lit(""))))

    df = tags.select("path", taken.alias("taken_at"), degrees("lat", "lat_ref").alias("lat"), degrees("lon", "lon_ref").alias("lon"), P.camera(F.col("make"), F.col("model")).alias("camera"), "width", "height", "duration_ms")
    ok = P.valid_coordinates(F.col("lat"), F.col("lon"))
    return df.withColumns({"lat": F.when(ok, F.col("lat")), "lon": F.when(ok, F.col("lon"))})
