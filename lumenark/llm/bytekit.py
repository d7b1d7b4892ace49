"""Vectorised text kernels over Arrow string buffers.

Texts stay UTF-8 bytes. Every word class used here has ASCII separators only, so
a word of bytes is a word of code points. Spans are fingerprinted with a
64-bit tabulated polynomial hash whose prefix sums make any span O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..shipping import ship

U64 = np.uint64
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240611)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]
_LANES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased, so A-Z belong to it.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        seq = np.full(size, base, np.uint64)
        seq[0] = 1
        have = np.multiply.accumulate(seq)
        _powers[int(base)] = have
        if size > 8 * CHUNK_BYTES:  # one giant text: use it, but do not keep it
            del _powers[int(base)]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` bytes; a longer text is one range."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words of the texts of one chunk."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
        n = len(data)
        self.data, self.offs, self.mask = data, offs, is_word[data]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        begin = self.mask.copy()
        begin[1:] &= ~self.mask[:-1] | first[1:n]
        end = self.mask.copy()
        end[:-1] &= ~self.mask[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        #: Words of text i are by_text[i] to by_text[i + 1].
        self.by_text = np.searchsorted(self.starts, offs)
        self.count = np.diff(self.by_text)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, table: np.ndarray = TABLE) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends, table)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k words; the last k - 1 starts have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n] * _LANES[0]
    for i in range(1, k):
        acc = acc + words[i : i + n] * _LANES[i % 64]
    return mix(acc + U64(k))


def gram_starts(by_text: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which a run of k words stays inside its text."""
    count = np.diff(by_text)
    n = np.maximum(count - k + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    lead = np.repeat(by_text[:-1] - (np.cumsum(n) - n), n)
    return np.arange(total) + lead


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Count of set flags in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def covered(n: int, starts: np.ndarray, width) -> np.ndarray:
    """Flags of the n words that some run [start, start + width) covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def arrow_batches(spark, records: int = 2048, max_bytes: int = 4 << 20) -> None:
    """Ships the package and bounds the Arrow batches that Python workers get, where the session leaves Spark's defaults."""
    ship(spark)
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(records)), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(max_bytes))):
        try:
            now = spark.conf.get(key, None)
            if now is None or now == default or (default is None and int(now) > (1 << 28)):
                spark.conf.set(key, value)
        except Exception as e:  # an older Spark without this setting
            if "CONFIG" not in str(e).upper():
                raise
