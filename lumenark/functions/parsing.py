"""Scalar functions on metadata, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(data: Column) -> Column:
    """First 32 hex digits of SHA-256."""
    return F.substring(F.sha2(data, 256), 1, 32)


def sane(t: Column) -> Column:
    return F.when(F.year(t).between(1900, 2100), t)


# Fixed value: dates in file names, with a time and seconds if there are any.
FILENAME_DATE = r"(19\d{2}|20\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])(?:[-_ tT]?([01]\d|2[0-3])[-_.:]?([0-5]\d)(?:[-_.:]?([0-5]\d))?)?"


def exif_date(s: Column) -> Column:
    """Dates as cameras write them (2018:07:04 15:30:00, with or without a fraction) or as ISO; zeros and nonsense are null."""
    s = F.trim(F.replace(s, F.lit("\x00"), F.lit("")))
    iso = F.regexp_replace(s, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
    ok = iso.rlike(r"^\d{4}-\d{2}-\d{2}") & ~F.startswith(s, F.lit("0000"))
    return sane(F.when(ok, iso.try_cast("timestamp_ntz")))


def filename_date(stem: Column) -> Column:
    """A date, and time if there is one, inside a file name: 20180704, 2018-07-04, 20180704_153000."""
    g = lambda i: F.regexp_extract(stem, FILENAME_DATE, i)
    part = lambda i: F.when(g(i) != "", g(i)).otherwise("00")
    text = F.concat(F.concat_ws("-", g(1), g(2), g(3)), F.lit(" "), F.concat_ws(":", part(4), part(5), part(6)))
    return F.when(g(1) != "", text.try_cast("timestamp_ntz"))


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; null beyond 180 either way."""
    v = degrees + minutes / 60 + seconds / 3600
    v = F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)
    return F.when(F.abs(v) <= 180, F.round(v, 6))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """In range, and not the point where both are zero."""
    null_island = (F.abs(lat) < 1e-7) & (F.abs(lon) < 1e-7)
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~null_island, F.lit(False))


def camera(make: Column, model: Column) -> Column:
    """Model, after the make unless the model says it already."""
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    both = F.trim(F.concat_ws(" ", make, model))
    return F.nullif(F.when(F.contains(F.lower(model), F.lower(make)), model).otherwise(both), F.lit(""))


def canonical_text(s: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[\p{Punct}]", ""), r"\s+", " "))


def words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), F.lit(1))


def duration_ms(banner: Column) -> Column:
    """From a probe's banner: Duration: 00:01:02.50."""
    p = r"Duration: ([0-9]+):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?"
    g = lambda i: F.regexp_extract(banner, p, i)
    ms = F.rpad(F.concat(g(4), F.lit("000")), 3, "0").cast("bigint")
    return F.when(g(1) != "", (g(1).cast("bigint") * 3600 + g(2).cast("bigint") * 60 + g(3).cast("bigint")) * 1000 + ms)


def video_size(banner: Column) -> Column:
    """width and height, exchanged where the picture is turned by 90 or 270 degrees."""
    g = lambda i: F.regexp_extract(banner, r"Video:.*?[ ,]([0-9]{2,5})x([0-9]{2,5})", i).cast("int")
    turn = F.abs(F.coalesce(F.nullif(F.regexp_extract(banner, r"rotat(?:e|ion)[^0-9-]*(-?[0-9]+)", 1), F.lit("")).cast("int"), F.lit(0)))
    side = (turn % 180) == 90
    return F.struct(F.when(side, g(2)).otherwise(g(1)).alias("width"), F.when(side, g(1)).otherwise(g(2)).alias("height"))


def creation_time(banner: Column, zone: str) -> Column:
    """UTC time of a video as local time."""
    t = F.regexp_extract(banner, r"creation_time\s*:\s*([0-9-]+T[0-9:]+)", 1)
    return F.from_utc_timestamp(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")), zone).cast("timestamp_ntz")


def scale_box(box: Column, scale: Column) -> Column:
    """x, y, w, h at another size; halves go to the even number."""
    return F.transform(box, lambda v: F.bround(v * scale, 0).cast("int"))


def face_quality(det: Column, w: Column, h: Column, lapvar: Column) -> Column:
    """Detector score, size and sharpness, each between 0 and 1."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    size, sharp = unit((F.least(w, h) - 40) / 160), unit(lapvar / 100)
    return unit(0.45 * unit(det.cast("double")) + 0.35 * size + 0.20 * sharp)


def padded_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.35) -> Column:
    """left, top, right, bottom of a face with its margin, inside the picture."""
    px, py = w * pad, h * pad
    return F.struct(F.greatest(F.lit(0), F.floor(x - px)).alias("left"), F.greatest(F.lit(0), F.floor(y - py)).alias("top"), F.least(width, F.ceil(x + w + px)).alias("right"), F.least(height, F.ceil(y + h + py)).alias("bottom"))


def join_lines(lines: Column, min_confidence: float = 0.5, cap: int = 4000) -> Column:
    """Text of recognised lines (text, confidence)."""
    sure = F.filter(lines, lambda x: x["confidence"] >= min_confidence)
    return F.substring(F.array_join(F.transform(sure, lambda x: x["text"]), "\n"), 1, cap)
