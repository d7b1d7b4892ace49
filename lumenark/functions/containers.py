"""Facts from the boxes of MP4-like files (videos, HEIC) and the chunks of WebP: sizes, dates, length, where tags lie."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

#: Boxes of which another level is of interest.
NESTED = {b"moov", b"trak", b"mdia", b"iprp", b"ipco"}
EPOCH = datetime(1904, 1, 1)  # of times in boxes


def boxes(data: bytes, lo: int = 0, hi: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the contents of each box. A box that claims more than there is ends the walk, unless its start alone is of use."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if lo + 16 > hi:
                return
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            return
        yield kind, lo + head, lo + size
        lo += size


def tree(data: bytes, lo: int = 0, hi: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """All boxes, those inside NESTED ones too, outer ones first."""
    for kind, a, b in boxes(data, lo, hi):
        yield kind, a, b
        if kind in NESTED:
            yield from tree(data, a, b)


def _times(data: bytes, at: int, fields: str, wide: str) -> tuple:
    """The numbers of a full box, whose version says how wide they are."""
    version = data[at]
    return struct.unpack_from(">" + (wide if version == 1 else fields), data, at + 4)


def video_facts(data: bytes) -> dict[str, object]:
    """duration_ms, created (UTC), width and height as shown, of what a file of boxes has."""
    out: dict[str, object] = {}
    for kind, lo, hi in tree(data):
        if kind == b"mvhd" and hi - lo >= 20:
            created, _, scale, length = _times(data, lo, "IIII", "QQIQ")
            if scale and length not in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
                out["duration_ms"] = length * 1000 // scale
            if created:
                try:
                    out["created"] = (EPOCH + timedelta(seconds=created)).strftime("%Y:%m:%d %H:%M:%S")
                except OverflowError:
                    pass
        elif kind == b"trak":
            parts = list(tree(data, lo, hi))
            handlers = {data[a + 8 : a + 12] for k, a, b in parts if k == b"hdlr" and b - a >= 12}
            for k, a, b in parts:
                if k != b"tkhd" or "width" in out or handlers and b"vide" not in handlers:
                    continue
                at = a + (52 if data[a] == 1 else 40)  # the matrix, then width and height
                if at + 44 > b:
                    continue
                m = struct.unpack_from(">9i", data, at)
                w, h = (x >> 16 for x in struct.unpack_from(">II", data, at + 36))
                if w and h:
                    out["width"], out["height"] = (h, w) if m[0] == 0 and m[1] else (w, h)
    return out


def _uint(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def _items(data: bytes, lo: int, hi: int) -> dict[int, bytes]:
    """Kinds of items by number, of an item information box."""
    out: dict[int, bytes] = {}
    wide = data[lo] > 0
    for kind, a, b in boxes(data, lo + (8 if wide else 6), hi):
        if kind == b"infe" and data[a] >= 2:
            size = 4 if data[a] >= 3 else 2
            out[_uint(data, a + 4, size)] = data[a + 6 + size : a + 10 + size]
    return out


def _places(data: bytes, lo: int, hi: int) -> dict[int, list[tuple[int, int]]]:
    """Offsets and lengths in the file by item, of an item location box."""
    version, sizes = data[lo], _uint(data, lo + 4, 2)
    offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    wide = 4 if version == 2 else 2
    at, out = lo + 6 + wide, {}
    for _ in range(_uint(data, lo + 6, wide)):
        item, method = _uint(data, at, wide), 0
        at += wide
        if version:
            method, at = _uint(data, at, 2) & 15, at + 2
        start = _uint(data, at + 2, base)
        n, at = _uint(data, at + 2 + base, 2), at + 4 + base
        for _ in range(n):
            if at >= hi:
                return out
            begin = start + _uint(data, at + index, offset)
            size = _uint(data, at + index + offset, length)
            at += index + offset + length
            if method == 0:
                out.setdefault(item, []).append((begin, size))
    return out


def heif_parts(data: bytes) -> tuple[bytes, dict[str, object]]:
    """The TIFF block of a HEIC or AVIF picture, empty if there is none, and its size as shown (of its largest image)."""
    for kind, lo, hi in boxes(data):
        if kind != b"meta":
            continue
        kinds, places, size, turned = {}, {}, (0, 0), False
        for k, a, b in tree(data, lo + 4, hi):
            if k == b"iinf":
                kinds = _items(data, a, b)
            elif k == b"iloc":
                places = _places(data, a, b)
            elif k == b"ispe" and b - a >= 12:
                size = max(size, struct.unpack_from(">II", data, a + 4), key=lambda s: s[0] * s[1])
            elif k == b"irot" and b > a:
                turned |= data[a] & 1 == 1
        out = {"width": size[1 if turned else 0], "height": size[0 if turned else 1]} if all(size) else {}
        for item, kind_ in kinds.items():
            if kind_ == b"Exif":
                block = b"".join(data[p : p + n] for p, n in places.get(item, []))
                return block[4 + _uint(block, 0, 4) :], out
        return b"", out
    return b"", {}


def webp_parts(data: bytes) -> tuple[bytes, dict[str, object]]:
    """The TIFF block of a WebP picture, empty if there is none, and its size."""
    block, out, at = b"", {}, 12
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"VP8X" and len(body) >= 10:
            out = {"width": 1 + int.from_bytes(body[4:7], "little"), "height": 1 + int.from_bytes(body[7:10], "little")}
        elif kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a" and not out:
            w, h = struct.unpack_from("<HH", body, 6)
            out = {"width": w & 0x3FFF, "height": h & 0x3FFF}
        elif kind == b"VP8L" and len(body) >= 5 and not out:
            bits = int.from_bytes(body[1:5], "little")
            out = {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF)}
        elif kind == b"EXIF":
            block = body.removeprefix(b"Exif\0\0")
        at += 8 + n + (n & 1)
    return block, out
