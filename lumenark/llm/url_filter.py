"""URL filters: host and path rules, then an exact block list held in cascades of Bloom filters.

A url has keys: each of its host's names (`a.b.c`, `b.c`, `c`) and its page (host and
path, an empty path taken as `/`). A block list is a table of such keys. All keys of
the corpus and of the list are the universe. A cascade of filters answers exactly for
every key of the universe, without a join: the first filter encodes the listed keys,
the second those other keys that the first takes for listed, the third those listed
keys that the second takes for others, and so on until no key is mistaken.

Keys travel as two 64-bit hashes (128 bits: among 10^12 keys, two meet with chance
10^-15). Distinct keys are dealt to shards by hash, so no key and no host is hot; each
shard's cascade is built in its own task from about SHARD_KEYS keys. The shards are
broadcast in blocks of at most BLOCK_BYTES; a longer list takes further passes over
the urls' hashes, not over the pages.

Defined results: the host is what follows the first `://` up to `/`, `?`, `#` or the
end, A-Z lower-cased, the path what follows up to `?`, `#` or the end; a null url and
one without `://` have neither, no key, no rule, and are allowed. A rule fits its host
and its subdomains where the path starts with the rule's (an empty path does not start
with `/`). Hosts of more than MAX_HOST characters (no name is longer) are looked up as
a whole, not by their parents. Repeated rows give repeated rows; an empty table gives
none; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekit import U64, arrow_batches, mix
from .storage import discard, saved

SHARD_KEYS, TASK_KEYS, BLOCK_BYTES, MAX_HOST = 1 << 16, 1 << 20, 64 << 20, 253
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEP, _SALT = 0x9E3779B97F4A7C15, 1_000_003


@dataclass(frozen=True)
class Rule:
    """block or allow what is under a host and a path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), *LETTERS)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(host: Column, path: Column) -> Column:
    """The key of one page; null without a host."""
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path)))


def keys(host: Column, path: Column) -> Column:
    """All keys of a url, an array of strings."""
    labels = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.when(F.length(host) <= MAX_HOST, names).otherwise(F.array(host))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_append(hosts, page_key(host, path)))


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("x"), F.xxhash64(F.lit(_SALT), key).alias("y"))


def applied(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does. The rules are one expression: some hundreds at most."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        text, verdict = F.when(r.fits(host, path), r.text).otherwise(text), F.when(r.fits(host, path), r.verdict).otherwise(verdict)
    return text, verdict


# The cascade of one shard.
def _places(x: np.ndarray, y: np.ndarray, level: int, m: np.ndarray, probe: int) -> np.ndarray:
    turn = [U64((2 * level + i) * _STEP % (1 << 64)) for i in (1, 2)]
    a, b = mix(x + turn[0]), mix(y + turn[1]) | U64(1)
    return (a + U64(probe) * b) % m


def build(x: np.ndarray, y: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, probes, filter) of each level for distinct keys."""
    levels: list[tuple[int, int, bytes]] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) > 200:
            raise RuntimeError("two keys share both hashes")
        rate = 0.5 if levels else min(0.5, 0.7 * len(inside) / max(len(outside), 1))
        probes = max(1, round(-np.log2(rate)))
        m = max(64, -(-int(len(inside) * probes / np.log(2)) // 8) * 8)
        bits = np.zeros(m, bool)
        for i in range(probes):
            bits[_places(x[inside], y[inside], len(levels), U64(m), i)] = True
        wrong = outside
        for i in range(probes):
            wrong = wrong[bits[_places(x[wrong], y[wrong], len(levels), U64(m), i)]]
        levels.append((m, probes, np.packbits(bits, bitorder="little").tobytes()))
        inside, outside = wrong, inside
    return levels


def _packed(levels: list[tuple[int, int, bytes]]) -> bytes:
    return b"".join(struct.pack("<QB", m, k) + bits for m, k, bits in levels)


class Block:
    """Cascades of some shards, level by level, so that keys of all shards are looked up together."""

    def __init__(self, bits: int, first: int, shards: dict[int, bytes], n: int):
        """Shards first to first + n - 1 of 2^bits; one without an entry has no listed key."""
        self.bits, self.first, self.n, self.levels = bits, first, n, []
        at = dict.fromkeys(shards, 0)
        while at:
            m, k, start, parts_, size = np.zeros(n, np.uint64), np.zeros(n, np.uint8), np.zeros(n, np.int64), [], 0
            for s, pos in list(at.items()):
                if pos >= len(shards[s]):
                    del at[s]
                    continue
                m[s - first], k[s - first] = struct.unpack_from("<QB", shards[s], pos)
                width = int(m[s - first]) // 8
                parts_.append(shards[s][pos + 9 : pos + 9 + width])
                start[s - first] = size
                size, at[s] = size + width, pos + 9 + width
            if parts_:
                self.levels.append((m, k, start, np.frombuffer(b"".join(parts_), np.uint8)))

    def listed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that belong to these shards; false for keys of other shards."""
        out = np.zeros(len(x), bool)
        shard = (x >> U64(64 - self.bits)).astype(np.int64) - self.first
        left = np.flatnonzero((shard >= 0) & (shard < self.n))
        for level, (m, k, start, data) in enumerate(self.levels):
            s = shard[left]
            ended = k[s] == 0  # this shard has no such level: what came through all its levels is of the last one's kind
            out[left[ended]] = level % 2 == 1
            left, s = left[~ended], s[~ended]
            through = np.ones(len(left), bool)
            for i in range(int(k[s].max()) if len(s) else 0):
                go = np.flatnonzero(through & (k[s] > i))
                place = _places(x[left[go]], y[left[go]], level, m[s[go]], i).astype(np.int64)
                through[go] = (data[start[s[go]] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            out[left[~through]] = level % 2 == 1
            left = left[through]
        out[left] = len(self.levels) % 2 == 1
        return out


@dataclass
class Cascade:
    """A saved table of cascades by shard (shard, filters, n_keys, n_listed, n_levels), and the number of shards."""

    shards: DataFrame
    bits: int

    def blocks(self, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
        """Runs of shards of at most so many bytes (one shard at least), one after another on the driver."""
        sizes = {r[0]: r[1] for r in self.shards.select("shard", F.octet_length("filters")).collect()}  # one row for each SHARD_KEYS keys
        lo, total = 0, 1 << self.bits
        while lo < total:
            hi, size = lo, 0
            while hi < total and (hi == lo or size + sizes.get(hi, 0) <= block_bytes):
                size, hi = size + sizes.get(hi, 0), hi + 1
            rows = self.shards.where((F.col("shard") >= lo) & (F.col("shard") < hi)).select("shard", "filters").collect()
            yield Block(self.bits, lo, {r[0]: bytes(r[1]) for r in rows if r[1]}, hi - lo)
            lo = hi


def cascade(universe: DataFrame, listed: DataFrame, key: str = "key", shard_keys: int = SHARD_KEYS) -> Cascade:
    """Cascades for the keys (strings) of both tables; those of the second are listed. Null keys are none."""
    spark = universe.sparkSession
    arrow_batches(spark)
    both = [df.where(F.col(key).isNotNull()).select(hashes(F.col(key)).alias("h"), F.lit(flag).alias("listed")) for df, flag in ((universe, False), (listed, True))]
    distinct = both[0].unionByName(both[1]).groupBy("h.x", "h.y").agg(F.max("listed").alias("listed"))
    table = saved(spark, distinct, "url-keys")
    n = table.count()
    bits = max(8, int(np.ceil(np.log2(max(n, 1) / shard_keys))) if n else 0)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_KEYS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not held:
            return
        x, y, on = (np.concatenate(c) for c in zip(*held, strict=True))
        x, y = x.view(np.uint64), y.view(np.uint64)
        shard = (x >> U64(64 - bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for at in np.split(order, cuts[1:]):
            levels = build(x[at], y[at], on[at])
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[at[0]])], pa.int64()), pa.array([_packed(levels)], pa.binary()), pa.array([len(at)], pa.int64()), pa.array([int(on[at].sum())], pa.int64()), pa.array([len(levels)], pa.int32())], names=["shard", "filters", "n_keys", "n_listed", "n_levels"])

    dealt = table.select("x", "y", "listed", F.shiftrightunsigned("x", 64 - bits).alias("shard")).repartition(tasks, "shard").drop("shard")
    shards = saved(spark, dealt.mapInArrow(run, "shard bigint, filters binary, n_keys bigint, n_listed bigint, n_levels int"), "url-cascade")
    discard(table)
    return Cascade(shards, bits)


def judge(pages: DataFrame, rules: list[Rule], cascade_: Cascade, id_: str = "page_id", url: str = "url", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, host, path, rule (text of the longest that fits, else null), listed (whether any key is), verdict: the rule's, else block where listed, else allow."""
    spark = pages.sparkSession
    arrow_batches(spark)
    sc = spark.sparkContext
    host, path = parts(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{id_}`").alias("id"), host.alias("host"), path.alias("path"))
    hashed = F.transform(keys(F.col("host"), F.col("path")), hashes)
    rows = rows.select("id", "host", "path", F.lit(False).alias("listed"), F.transform(hashed, lambda h: h["x"]).alias("x"), F.transform(hashed, lambda h: h["y"]).alias("y"))
    schema = f"id {dict(rows.dtypes)['id']}, host string, path string, listed boolean, x array<bigint>, y array<bigint>"

    def lookup(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = b.column(4), b.column(5)
                flat = [c.flatten().to_numpy().view(np.uint64) for c in (x, y)]
                ends = np.cumsum(x.value_lengths().fill_null(0).to_numpy())
                hit = np.zeros(len(flat[0]) + 1, np.int64)
                np.cumsum(block.value.listed(*flat), out=hit[1:])
                any_ = np.diff(hit[np.concatenate([[0], ends])]) > 0
                before = b.column(3).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(before | any_), x, y], names=b.schema.names)

        return run

    last = None
    for block in cascade_.blocks(block_bytes):
        if last is not None:  # its pass ends before the next one's filters are held
            rows = saved(spark, rows.mapInArrow(lookup(last), schema), "url-pass")
            last.unpersist()
        last = sc.broadcast(block)
    if last is not None:
        rows = rows.mapInArrow(lookup(last), schema)
    text, verdict = applied(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_), "host", "path", text.alias("rule"), "listed", F.coalesce(verdict, method).alias("verdict"))


def tracked_keys(pages: DataFrame, url: str = "url", share: float = 0.2, least: int = 5) -> DataFrame:
    """key: a block list from the pages themselves: pages linked with a tracking parameter, and hosts of which at least this share (of `least` pages or more) are."""
    u = F.col(f"`{url}`")
    host, path = parts(u)
    rows = pages.select(host.alias("host"), path.alias("path"), F.coalesce(u.rlike(r"[?&]utm_\w+="), F.lit(False)).alias("tracked")).where("host <> ''")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("tracked").alias("t")).where((F.col("n") >= least) & (F.col("t") >= share * F.col("n")))
    return rows.where("tracked").select(page_key(F.col("host"), F.col("path")).alias("key")).unionByName(hosts.select(F.col("host").alias("key")))


def all_keys(pages: DataFrame, url: str = "url") -> DataFrame:
    """key: every key of every page."""
    host, path = parts(F.col(f"`{url}`"))
    return pages.select(host.alias("host"), path.alias("path")).select(F.explode(keys(F.col("host"), F.col("path"))).alias("key"))
