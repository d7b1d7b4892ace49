"""64-bit fingerprints of texts that differ in few bits where the texts differ in few words."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of texts whose words are hashed together (a longer text is taken alone); words that a byte can count.
TOGETHER, FULL = 1 << 22, 255


def text_print(text: bytes | None, known: dict[bytes, bytes]) -> int | None:
    """The fingerprint of one text. known: hashes of words met before; only this text's words are looked up, so its size costs no time."""
    words = set(_WORD.findall(text or b""))
    if not words:
        return None
    for w in words:
        if w not in known:
            known[w] = md5(w).digest()[8:]
    bits = np.unpackbits(np.frombuffer(b"".join([known[w] for w in words]), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(words)).view(">i8")[0])


def _together(texts: pa.BinaryArray) -> pa.Array:
    """The fingerprints of some texts. Each different word of them is hashed once; words of a text are counted bit by bit in bytes, FULL of them at most, then these counts added."""
    words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), texts.null_count, texts.offset))
    flat = words.flatten().dictionary_encode()
    each = flat.dictionary.cast(pa.binary())
    n = len(each)
    out, none = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
    if n:
        data, at = each.buffers()[2], np.frombuffer(each.buffers()[1], np.int32)[each.offset : each.offset + n + 1].tolist()
        data = data.to_pybytes() if data else b""
        hashes = b"".join([md5(data[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 16)[:, 8:], axis=1).view(np.uint64)
        met = np.repeat(np.arange(len(texts)) * n, pc.fill_null(pc.list_value_length(words), 0).to_numpy()) + flat.indices.to_numpy()
        met.sort()
        of, word = np.divmod(met[np.r_[True, met[1:] != met[:-1]]], n)
        real = (np.diff(at) > 0)[word]  # white space at a text's ends leaves empty words
        of, word = of[real], word[real]
    if n and len(of):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        size = np.diff(np.r_[starts, len(of)])
        runs = -(-size // FULL)
        first = np.cumsum(runs) - runs
        parts = np.repeat(starts, runs) + FULL * (np.arange(runs.sum()) - np.repeat(first, runs))
        ones = np.add.reduceat(np.add.reduceat(bits[word], parts, axis=0).view(np.uint8), first, axis=0, dtype=np.int64)
        out[of[starts]] = np.packbits(2 * ones > size[:, None], axis=1).view(">i8")[:, 0]
        none[of[starts]] = False
    return pa.array(out, mask=none)


def prints(texts: pa.BinaryArray) -> pa.Array:
    """The fingerprint of each text, as of `text_print`."""
    if not len(texts):
        return pa.array([], pa.int64())
    ends, out, at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1], [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + TOGETHER, "right")) - 1)
        out.append(_together(texts.slice(at, to - at)))
        at = to
    return pa.concat_arrays(out)


def text_prints(rows: DataFrame, id_: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, phash, *keep): each bit is what most of the different words of a text have in the last half of their MD5 (ties: 0). Null where there is no word."""
    ship(rows.sparkSession)
    src = rows.select(F.col(id_).alias("id"), F.col(text).cast("binary").alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), prints(b.column(1)), *b.columns[2:]], names=["id", "phash", *keep])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([f"id {kinds['id']}", "phash bigint", *(f"`{c}` {kinds[c]}" for c in keep)])).withColumnRenamed("id", id_)
