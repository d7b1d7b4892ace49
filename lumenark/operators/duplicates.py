"""Near duplicates of 64-bit perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import saved
from .graph import with_components

BANDS, BAND_BITS, MAX_BUCKET = 4, 16, 512
#: Keys a hash has at most, and the cost of one in compared pairs; hashes whose pairs are looked at for a choice of keys, and those that count common keys.
MAX_KEYS, KEY_COST, SAMPLE, COUNTED = 256, 100, 2000, 200_000
#: Keyed rows of a bin, rows of a tile, rows of a run that are compared row by row, sides of a block of a larger run, pairs of a batch.
BIN, TILE, FEW, BLOCK, WIDE, EMIT = 200_000, 8192, 64, 512, 8192, 1 << 18


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, BAND_BITS * i).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def near_pairs(rows: DataFrame, max_distance: int = 6, id_: str = "image_id", key: str = "phash", max_bucket: int | None = MAX_BUCKET) -> DataFrame:
    """(a, b, distance), a < b: pairs that share a band whose bucket has at most max_bucket members, within the distance.

    The limit on buckets is the observable rule of this operator; `exact_pairs` has none.
    A hash of null or 0 takes no part.
    """
    src = rows.where(F.col(key).isNotNull() & (F.col(key) != 0)).select(F.col(id_).alias("id"), F.col(key).alias("h"))
    keyed = src.select("id", "h", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), band(F.col("h"), i).alias("key")) for i in range(BANDS)])).alias("k")).select("id", "h", "k.*")
    ok = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") >= 2)
    if max_bucket is not None:
        ok = ok.where(F.col("n") <= max_bucket)
    small = keyed.join(ok.drop("n"), ["band", "key"])
    x, y = small.alias("x"), small.alias("y")
    distance = hamming(F.col("x.h"), F.col("y.h"))
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (distance <= max_distance))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance.alias("distance")).distinct()


def _schemes(max_distance: int, bits: list[int]) -> Iterator[tuple[list[int], list[tuple[int, ...]]]]:
    """Ways to make all pairs within the distance meet: masks of disjoint parts of the bits, and the sets of parts that are keys.

    Of p parts at most max_distance differ, so p - max_distance agree (pigeonhole): all sets of so many parts. bits: those in which hashes differ, the most even first; they are dealt to the parts in turn.
    """
    for p in range(max_distance + 2, len(bits) + 1):
        if comb(p, max_distance) > MAX_KEYS and p > max_distance + 2:
            return
        yield [sum(1 << b for b in bits[i::p]) for i in range(p)], list(combinations(range(p), p - max_distance))
    if len(bits) < max_distance + 2:
        p = max(len(bits), 1)
        yield [1 << b for b in bits] or [0], list(combinations(range(p), max(len(bits) - max_distance, 0)))


def _scheme(sample: np.ndarray, n: int, max_distance: int, bits: list[int]) -> tuple[list[int], list[tuple[int, ...]]]:
    """The scheme of least cost for n hashes, by how often pairs of a sample meet. It decides about speed alone."""
    x = (sample[:, None] ^ sample[None, :])[np.triu_indices(len(sample), 1)]
    best = None
    for masks, keys in _schemes(max_distance, bits):
        agree, need = np.zeros(len(x), np.int64), len(keys[0])
        for m in masks:
            agree += (x & np.uint64(m)) == 0
        meet = sum(comb(a, need) * int(c) for a, c in enumerate(np.bincount(agree)))
        cost = len(keys) * n * KEY_COST + meet / max(len(x), 1) * n * n / 2
        if best is None or cost < best[0]:
            best = cost, masks, keys
    return best[1:]


def _met(h: np.ndarray, run: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that meet: rows of one run, and of both sides where the run is of two. Rows are sorted by run and side."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.r_[starts[1:], len(run)]
    dense = (ends - starts > FEW) | cross[starts]
    end, small = np.repeat(ends, ends - starts), ~np.repeat(dense, ends - starts)
    at, o = np.flatnonzero(small), 1
    while len(at := at[at + o < end[at]]):
        yield at, at + o
        o += 1
    for s, e in zip(starts[dense], ends[dense], strict=True):
        middle = s + int(np.searchsorted(side[s:e], 1)) if cross[s] else e
        for lo in range(s, middle, BLOCK):
            for to in range(middle if cross[s] else lo, e, WIDE):
                u, v = np.arange(lo, min(lo + BLOCK, middle)), np.arange(to, min(to + WIDE, e))
                yield u[:, None], v[None, :]


def near_hashes(hashes: DataFrame, max_distance: int = 6, key: str = "phash", count: bool = False, forest: bool = False) -> DataFrame:
    """(x, y, distance), x < y: all pairs of different hashes within the distance. hashes: may repeat; null and 0 take no part.

    Hashes meet where they agree in enough parts of the bits (`_schemes`); parts leave out
    bits that all hashes share and are of bits that differ evenly. Keys are dealt into bins,
    a bin a task, in which pairs are compared as arrays; a key that very many hashes share
    is cut into a grid of tiles. A pair is made for the first parts that agree only, so
    nothing has to be deduplicated. count: the pairs that meet, before distances are looked
    at. forest: of each bin only as many links as connect what its pairs connect.
    """
    spark = hashes.sparkSession
    ship(spark)
    one = saved(spark, hashes.where(F.col(key).isNotNull() & (F.col(key) != 0)).select(F.col(key).cast("bigint").alias("h")).distinct(), "hashes")
    ones = one.agg(F.count("*"), *[F.count_if(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) == 1) for b in range(64)]).first()
    n, share = ones[0], ones[1:]
    bits = sorted((b for b in range(64) if 0 < share[b] < n), key=lambda b: (abs(2 * share[b] - n), b))
    mix = F.xxhash64("h")
    sample = np.array([r.h for r in one.orderBy(mix, "h").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    masks, keys = _scheme(sample, n, max_distance, bits)
    whole = [sum(masks[p] for p in c) for c in keys]
    # Parts before the last of a key that are not in it: where one agrees, the pair is made elsewhere.
    before = [[masks[p] for p in range(c[-1] if c else 0) if p not in c] for c in keys]
    signed = [m - (1 << 64) if m >> 63 else m for m in whole]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("h", F.posexplode(F.array(*map(F.lit, signed))).alias("c", "mask")).select("h", "c", F.col("h").bitwiseAND(F.col("mask").cast("bigint")).alias("k"))

    every = max(n // COUNTED, 1)
    heavy = keyed(one.where(F.pmod(mix, F.lit(every)) == 0)).groupBy("c", "k").agg((F.count("*") * every).alias("size")).where(F.col("size") > TILE)
    heavy = heavy.select("c", "k", F.ceil(F.col("size") / TILE).cast("int").alias("m"))
    bins = max(-(-n * len(keys) // BIN), 1)
    rows = keyed(one).join(F.broadcast(heavy), ["c", "k"], "left").withColumn("t", F.coalesce(F.pmod(mix, F.col("m")).cast("int"), F.lit(0)))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(1)) - 1)))
    rows = rows.select("h", "c", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", F.pmod(F.xxhash64("c", "k", F.least("t", "o"), F.greatest("t", "o")), F.lit(bins)).alias("bin"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        h, c, i, j, t = (table.column(x).to_numpy() for x in ("h", "c", "i", "j", "t"))
        h = h.view(np.uint64)
        k = h & np.array(whole, np.uint64)[c]
        order = np.lexsort((t, j, i, k, c))
        h, c, i, j, t, k = (x[order] for x in (h, c, i, j, t, k))
        run = np.cumsum(np.r_[0, (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        label, node = np.unique(h, return_inverse=True) if forest else (None, None)
        low = np.arange(len(label)) if forest else None
        xs: list[np.ndarray] = []
        ys: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            x, y = np.concatenate(xs or [h[:0]]).view(np.int64), np.concatenate(ys or [h[:0]]).view(np.int64)
            apart = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(apart)], names=["x", "y", "distance"])

        def linked(low: np.ndarray) -> np.ndarray:
            """Smallest nodes that the pairs so far reach."""
            a, b = (node[np.concatenate(x)] if x else node[:0] for x in (xs, ys))
            while len(a):
                a, b = low[a], low[b]
                a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                np.minimum.at(low, b, a)
                while (nxt := low[low]).tobytes() != low.tobytes():
                    low = nxt
            return low

        size = 0
        for u, v in _met(h, run, (t == j).astype(np.int8), i < j):
            if u.ndim == 2:
                r, q = np.nonzero((u != v) if count else (np.bitwise_count(h[u] ^ h[v]) <= max_distance) & (u != v))
                u, v = u[r, 0], v[0, q]
                once = (u < v)
                u, v = u[once], v[once]
            elif not count:
                near = np.bitwise_count(h[u] ^ h[v]) <= max_distance
                u, v = u[near], v[near]
            if not count and len(u):
                apart, first, of = h[u] ^ h[v], np.ones(len(u), bool), c[u]
                for w in np.unique(of):
                    at = of == w
                    for m in before[w]:
                        first[at] &= (apart[at] & np.uint64(m)) != 0
                u, v = u[first], v[first]
            if not len(u):
                continue
            xs.append(u if forest else h[u])
            ys.append(v if forest else h[v])
            size += len(u)
            if size > EMIT:
                if forest:
                    low = linked(low)
                else:
                    yield made()
                xs, ys, size = [], [], 0
        low = linked(low) if forest else None
        if forest:
            at = np.flatnonzero(low != np.arange(len(low)))
            xs, ys = [label[at]], [label[low[at]]]
        yield made()

    return rows.groupBy("bin").applyInArrow(meet, "x bigint, y bigint, distance int")


def exact_pairs(rows: DataFrame, max_distance: int = 6, id_: str = "image_id", key: str = "phash") -> DataFrame:
    """(a, b, distance), a < b: all pairs of rows within the distance; equal hashes are one node until the end. `hash_groups` needs no pairs of rows.

    Spark takes the pairs to be as few as the hashes they are made of and would broadcast them: the hints keep the rows' ids as the tables that are hashed.
    """
    src = rows.where(F.col(key).isNotNull() & (F.col(key) != 0)).select(F.col(id_).alias("id"), F.col(key).alias("h"))
    near = near_hashes(src, max_distance, "h")
    left, right = src.select(F.col("id").alias("i"), F.col("h").alias("x")), src.select(F.col("id").alias("j"), F.col("h").alias("y"))
    apart = near.join(left.hint("shuffle_hash"), "x").join(right.hint("shuffle_hash"), "y").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance").where("a <> b")
    same = left.join(right, F.col("x") == F.col("y")).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(same)


def hash_groups(rows: DataFrame, max_distance: int = 6, id_: str = "image_id", key: str = "phash") -> DataFrame:
    """Groups that pairs within the distance connect, as of `groups`. Only different hashes meet; copies of one cost nothing."""
    src = rows.where(F.col(key).isNotNull() & (F.col(key) != 0)).select(F.col(id_).alias("id"), F.col(key).alias("h"))
    nodes = src.select(F.col("h").alias("node")).distinct()
    of = with_components(nodes, near_hashes(src, max_distance, "h", forest=True).select(F.col("x").alias("a"), F.col("y").alias("b")))
    got = src.join(of.select(F.col("node").alias("h"), "label"), "h").groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    return got.where("n > 1").select(F.element_at("ids", 1).alias("group_id"), "ids", "n")


def groups(rows: DataFrame, pairs: DataFrame, id_: str = "image_id") -> DataFrame:
    """Components of the pairs with their sorted ids."""
    got = with_components(rows.select(F.col(id_).alias("node")), pairs.select("a", "b"))
    return got.groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("ids"), F.count("*").alias("n")).where("n > 1").select(F.col("label").alias("group_id"), "ids", "n")


def duplicates(images: DataFrame, max_distance: int = 6, limit: int | None = None, exact: bool = False) -> DataFrame:
    """Exact groups first, then near groups without their members; by kind and smallest id. Images are made once, for all that reads them."""
    from .aggregates import exact_duplicates

    images = saved(images.sparkSession, images.select("image_id", "content_hash", "phash"), "duplicates")
    same = exact_duplicates(images).select(F.lit("exact").alias("kind"), "ids")
    members = same.select(F.explode("ids").alias("image_id")).distinct()
    rest = images.join(members, "image_id", "left_anti")
    near = hash_groups(images, max_distance) if exact else groups(images, near_pairs(images, max_distance))
    near = near.select("group_id", F.explode("ids").alias("image_id")).join(rest.select("image_id"), "image_id", "left_semi")
    near = near.groupBy("group_id").agg(F.array_sort(F.collect_list("image_id")).alias("ids")).where(F.size("ids") > 1).select(F.lit("near").alias("kind"), "ids")
    out = same.unionByName(near).orderBy("kind", F.element_at("ids", 1))
    return out.limit(limit) if limit else out
