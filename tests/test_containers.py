"""Videos, HEIC and WebP by hand-made boxes; helpers on boxes of faces and lines of text."""

import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenark.functions import containers, metadata, parsing
from lumenark.operators import browse, details


def box(kind, body, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


SINCE_1904 = int((datetime(2019, 8, 12, 10, 30) - datetime(1904, 1, 1)).total_seconds())


def video(version=0, turned=False, tail=False, handler=b"vide", length=12_345, wide=False):
    times = ">QQIQ" if version else ">IIII"
    mvhd = box(b"mvhd", bytes([version, 0, 0, 0]) + struct.pack(times, SINCE_1904, 0, 1000, length) + bytes(80))
    matrix = struct.pack(">9i", *((0, 1 << 16, 0, -1 << 16, 0, 0, 0, 0, 1 << 30) if turned else (1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)))
    lead = struct.pack(">QQIIQ" if version else ">IIIII", 0, 0, 1, 0, length) + bytes(16)
    track = lambda h, w, hgt: box(b"trak", box(b"tkhd", bytes([version, 0, 0, 0]) + lead + matrix + struct.pack(">II", w << 16, hgt << 16)) + box(b"mdia", box(b"hdlr", bytes(8) + h + bytes(12))))
    moov = box(b"moov", mvhd + track(b"soun", 0, 0) + track(handler, 1920, 1080), wide)
    media = box(b"mdat", bytes(5000), wide)
    return box(b"ftyp", b"isom" + bytes(4)) + (media + moov if tail else moov + media)


def tiff(camera=b"Cam", taken=b"2020:02:03 04:05:06"):
    # One directory: make, and the part with the date.
    make, date = camera + b"\0", taken + b"\0"
    at = 8 + 2 + 24 + 4
    sub = at + len(make) + len(make) % 2
    head = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x010F, 2, len(make), at if len(make) > 4 else int.from_bytes(make.ljust(4, b"\0"), "little")) + struct.pack("<HHII", 0x8769, 4, 1, sub) + bytes(4)
    part = struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(date), sub + 18) + bytes(4) + date
    return head + make + bytes(len(make) % 2) + part


def heic(version=1, turned=False):
    block = struct.pack(">I", 6) + b"Exif\0\0" + tiff()
    infe = lambda n, k: box(b"infe", bytes([2, 0, 0, 0]) + struct.pack(">HH", n, 0) + k + b"\0")
    iinf = box(b"iinf", bytes(4) + struct.pack(">H", 2) + infe(1, b"hvc1") + infe(2, b"Exif"))
    ispe = lambda w, h: box(b"ispe", bytes(4) + struct.pack(">II", w, h))
    iprp = box(b"iprp", box(b"ipco", ispe(512, 512) + ispe(4032, 3024) + (box(b"irot", b"\1") if turned else b"")))
    ftyp = box(b"ftyp", b"heic" + bytes(4))

    def meta(at):
        method = struct.pack(">H", 0) if version else b""
        item = lambda n, o, size: struct.pack(">H", n) + method + struct.pack(">HHII", 0, 1, o, size)
        iloc = box(b"iloc", bytes([version, 0, 0, 0]) + struct.pack(">HH", 0x4400, 2) + item(1, 0, 4) + item(2, at, len(block)))
        return box(b"meta", bytes(4) + iinf + iloc + iprp)

    at = len(ftyp) + len(meta(0)) + 8
    return ftyp + meta(at) + box(b"mdat", block)


def webp(kind):
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    size = {b"VP8X": bytes(4) + (799).to_bytes(3, "little") + (599).to_bytes(3, "little"), b"VP8 ": b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 800 | 1 << 14, 600), b"VP8L": b"\x2f" + (799 | 599 << 14).to_bytes(4, "little")}[kind]
    body = b"WEBP" + chunk(kind, size + (b"\0" if kind == b"VP8L" else b"")) + chunk(b"EXIF", b"Exif\0\0" + tiff())
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("version", [0, 1])
@pytest.mark.parametrize("tail", [False, True])
def test_video_facts(version, tail):
    want = {"duration_ms": 12_345, "created": "2019:08:12 10:30:00", "width": 1920, "height": 1080}
    assert containers.video_facts(video(version, tail=tail)) == want == containers.video_facts(video(version, tail=tail, wide=True))
    assert containers.video_facts(video(version, turned=True))["width"] == 1080
    assert "width" not in containers.video_facts(video(version, handler=b"hint"))
    whole = video(version, tail=tail)
    for cut in range(0, len(whole), 97):  # damaged files give what is there, and end
        assert set(containers.video_facts(whole[:cut])) <= set(want)
    assert "duration_ms" not in containers.video_facts(video(0, length=0xFFFFFFFF))


def test_tags_of_all_kinds(spark):
    files = {"v.mp4": video(), "old-20180704.mp4": video().replace(struct.pack(">I", SINCE_1904), bytes(4)), "h0.heic": heic(0), "h1.heic": heic(1, turned=True), "broken.heic": heic()[:150], "x.webp": webp(b"VP8X"), "l.webp": webp(b"VP8L"), "y.webp": webp(b"VP8 "), "none.webp": b"RIFF\0\0\0\0WEBP", "empty.mp4": b"", "zeros.mp4": bytes(64)}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {r.path: r for r in metadata.metadata(metadata.read_tags(df)).collect()}
    assert len(got) == len(files)
    v = got["v.mp4"]
    assert (v.duration_ms, v.width, v.height, v.taken_at) == (12_345, 1920, 1080, datetime(2019, 8, 12, 10, 30)) and got["old-20180704.mp4"].taken_at == datetime(2018, 7, 4)
    for name, size in (("h0.heic", (4032, 3024)), ("h1.heic", (3024, 4032)), ("x.webp", (800, 600)), ("l.webp", (800, 600)), ("y.webp", (800, 600))):
        r = got[name]
        assert (r.width, r.height) == size and r.camera == "Cam" and r.taken_at == datetime(2020, 2, 3, 4, 5, 6) and r.duration_ms is None, name
    for name in ("broken.heic", "none.webp", "empty.mp4", "zeros.mp4"):
        assert got[name].width is None and got[name].camera is None


def test_helpers(spark):
    one = spark.range(1)
    c = lambda e: one.select(e.alias("x")).first().x
    assert c(parsing.scale_box(F.array(*map(F.lit, (10, 11, 13, 15))), F.lit(0.5))) == [5, 6, 6, 8]  # halves to even
    lit = lambda *v: [F.lit(x) for x in v]
    assert c(parsing.face_quality(*lit(1.0, 200, 300, 100.0))) == pytest.approx(1.0) and c(parsing.face_quality(*lit(0.5, 120, 400, 50.0))) == pytest.approx(0.45 * 0.5 + 0.35 * 0.5 + 0.2 * 0.5) and c(parsing.face_quality(*lit(0.0, 10, 10, 0.0))) == 0
    assert tuple(c(parsing.padded_crop(*lit(100, 50, 40, 20, 150, 300)))) == (86, 43, 150, 77) and tuple(c(parsing.padded_crop(*lit(0, 0, 10, 10, 100, 100)))) == (0, 0, 14, 14)
    lines = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(p).alias("confidence")) for t, p in (("one", 0.9), ("no", 0.4), ("two", 0.5))])
    assert c(parsing.join_lines(lines)) == "one\ntwo" and c(parsing.join_lines(lines, cap=5)) == "one\nt"
    faces = spark.createDataFrame([(1, [1.0], 10, 10), (2, [2.0], 20, 10), (3, [3.0], 10, 20), (4, None, 99, 99)], "face_id bigint, vector array<double>, w int, h int")
    assert details.largest_face(faces) == [2.0] and details.largest_face(faces.limit(0)) is None  # ties: the first
    for text, want in (("2020-01-02T03:04:05Z", datetime(2020, 1, 2, 3, 4, 5)), ("2020-01-02T03:04:05+02:00", datetime(2020, 1, 2, 1, 4, 5)), (" 2020-01-02 ", datetime(2020, 1, 2)), ("2020-01-02T03:04:05.5", datetime(2020, 1, 2, 3, 4, 5, 500_000))):
        assert browse.parse_bound(text) == want and browse.parse_bound(text).tzinfo is None
    assert browse.Filters(start=datetime(2020, 1, 1, tzinfo=timezone.utc)).start is not None
