"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A document's set holds its distinct k-word shingles (64-bit fingerprints). Two
sets link when their Jaccard similarity reaches num/den. The join is exact:

1. Sizes fall into bands such that linked sets lie in one band or two neighbours.
   Linked sets of smaller size m differ in at most D(m) shingles. Under the scheme
   of a band whose largest size is T, the fingerprint space is cut into some more
   ranges than D(T), so linked sets agree on whole ranges: the fingerprint of a
   range is a tile key. A set with e non-empty ranges agrees with each partner on
   e - D at least. (A set with e <= D also has keys of its empty ranges.)
2. One pass over the texts gives sizes and keys. Keys travel packed, 12 bytes each;
   only tiles with two different sets survive. As partners share e - D tiles, a set
   leaves its e - D - 1 most common tiles (of those that survived; the order of
   tiles is global, so the rarest shared tile stays in both), and a set without
   tiles then has no partner. This drops nearly all sets that merely share passages.
3. Each remaining set is made again from its text and goes to its fullest tile.
   There a parity bitmap bounds the overlap of two sets from above (differing bits
   never outnumber differing shingles); pairs that pass are intersected exactly as
   sorted arrays, unless already connected.
4. Components that share a tile compare a few members; this joins the parts of
   large groups at little cost.
5. Tiles that still hold different components are joined again, across components
   only, with the bitmap bound in the join condition and exact checks behind it.

Equal sets are one node, so copies cost nothing. Tiles of many shingles or sets are
split by a salt with shared bridge sets; step 5 makes the split exact: there the
pairs of such a tile are dealt as blocks of a grid, each pair in one block. Different
sets of one size differ in two shingles or more, so where less is allowed (small
sets) no pair of one size is looked at. Node identity is a 63-bit
fingerprint of the set: among N distinct sets two collide with chance N^2 / 2^64.

Defined results: null, empty and blank texts have no shingles and link with nothing;
fewer than k words are one shingle; repeated rows give repeated rows in one
component; a row with a null id links like any other, but its id is not a
component's smallest; an empty table gives no rows; extra columns are ignored, or
kept under any name by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytekit import LOWER_TABLE, NON_SPACE, U64, Words, arrow_batches, chunks, gram_starts, grams, mix, string_bytes
from .components import components
from .storage import attach, bounded, discard, release, saved

#: Shingles and sets in one tile task; entries of one key that a task passes on directly.
TILE_SHINGLES, TILE_SETS, HOT_ENTRIES, BRIDGES = 2_000_000, 4096, 16, 8
#: Sets of a tile on one side of a block of pairs in the last round.
GRID_SETS = 2048
BUCKET_BYTES, FLUSH = 4 << 20, 1 << 19
#: Rounds that merge components by a few of their members, before the exact one. The first finds nearly all.
MERGE_ROUNDS = 1
WORDS = 16  # of the bitmap: 1024 bits
#: Stands for the number of members of a tile that some task has many of: the same wherever the tile is met.
COMMON = 1 << 40


@dataclass(frozen=True)
class Spec:
    """k-word shingles; two sets link when den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    def differing(self, m):
        """Most differing shingles of linked sets, the smaller of size m."""
        return ((self.den - self.num) * m) // self.num

    def bands(self, largest: int) -> np.ndarray:
        """Largest size of each band. Neighbours only: sizes of linked sets differ by num/den at most."""
        ratio = min(0.7, self.num / self.den)
        tops = [1]
        while tops[-1] < largest:
            tops.append(max(tops[-1] + 1, int(np.ceil(tops[-1] / ratio))))
        return np.array(tops, np.int64)

    def ranges(self, top):
        d = self.differing(top) + 1
        return d + np.where(d >= 5, d // 5 + 1, 0)


class Sets:
    """The shingle sets of one chunk of texts."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, k: int):
        w = Words(data, offs, NON_SPACE)
        h = w.hashes(LOWER_TABLE)
        n = len(w.count)
        starts = gram_starts(w.by_text, k)
        values = [grams(h, k)[starts]]
        texts = [w.texts()[starts]]
        for size in range(1, k):  # fewer words: the whole sequence
            short = np.flatnonzero(w.count == size)
            if len(short):
                acc = np.zeros(len(short), np.uint64)
                for i in range(size):
                    acc += mix(h[w.by_text[short] + i] + U64(i + 1))
                values.append(mix(acc + U64(size)))
                texts.append(short)
        v, t = np.concatenate(values), np.concatenate(texts).astype(np.int64)
        order = np.lexsort((v, t))
        v, t = v[order], t[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
        self.values, self.text = v[new], t[new]
        self.size = np.bincount(self.text, minlength=n).astype(np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.size)])
        self.own = mix(self.values ^ U64(0x5851F42D4C957F2D))
        full = np.zeros(len(self.values) + 1, np.uint64)
        np.cumsum(self.own, out=full[1:])
        self.node = mix(full[self.offs[1:]] - full[self.offs[:-1]] + self.size.astype(np.uint64)) >> U64(1)

    def keys(self, spec: Spec, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tile keys, their texts, whether they are of the band below, and (two rows: own band, below) how many keys each text can spare."""
        band = np.searchsorted(tops, np.maximum(self.size, 1))
        below = tops[np.maximum(band - 1, 0)]
        spare = np.zeros((2, len(self.size)), np.int64)
        out_k, out_t, out_l = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for low, (scheme, wanted) in enumerate(((band, self.size > 0), (band - 1, (band > 0) & (self.size > 0) & (spec.num * self.size <= spec.den * below)))):
            scheme = np.maximum(scheme, 0)
            parts = spec.ranges(tops[scheme]).astype(np.int64)
            pick = wanted[self.text]
            v, t, own = self.values[pick], self.text[pick], self.own[pick]
            if not len(v):
                continue
            j = ((v >> U64(32)) * parts[t].astype(np.uint64)) >> U64(32)
            edge = np.ones(len(v), bool)
            edge[1:] = (j[1:] != j[:-1]) | (t[1:] != t[:-1])
            at = np.flatnonzero(edge)
            salt = mix(scheme[t[at]].astype(np.uint64) * U64(0x2545F4914F6CDD1D) + j[at])
            new_k, new_t = [mix(np.add.reduceat(own, at) + salt)], [t[at]]
            have = np.bincount(t[at], minlength=len(self.size))
            most = spec.differing(np.minimum(self.size, tops[scheme]))
            spare[low] = np.where(wanted, np.maximum(have - most - 1, 0), 0)
            for x in np.flatnonzero(wanted & (have <= most)).tolist():  # too few non-empty ranges: empty ones count as well
                empty = np.setdiff1d(np.arange(parts[x], dtype=np.uint64), j[at][t[at] == x])
                new_k.append(mix(mix(np.full(len(empty), scheme[x], np.uint64) * U64(0x2545F4914F6CDD1D) + empty) ^ U64(0xE3779B97F4A7C15F)))
                new_t.append(np.full(len(empty), x))
            out_k += new_k
            out_t += new_t
            out_l.append(np.full(sum(map(len, new_k)), bool(low)))
        return np.concatenate(out_k), np.concatenate(out_t), np.concatenate(out_l), spare

    def bitmaps(self, texts: np.ndarray) -> np.ndarray:
        """Parity of the shingles on each of the bits, for some texts."""
        bit = (self.own & U64(64 * WORDS - 1)).astype(np.int64)
        out = np.zeros((len(texts), WORDS), np.uint64)
        for i, t in enumerate(texts.tolist()):
            flat = np.bincount(bit[self.offs[t] : self.offs[t + 1]], minlength=64 * WORDS) & 1
            out[i] = np.packbits(flat.astype(np.uint8), bitorder="little").view(np.uint64)
        return out


def _sets(batch_column, k: int) -> Iterator[tuple[int, Sets]]:
    data, offs = string_bytes(batch_column)
    for i, j in chunks(offs):
        yield i, Sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def survey(docs: DataFrame, spec: Spec, text_bytes: int) -> DataFrame:
    """Two kinds of rows from one pass. Of each document: id, h, n (size of its set), node (null for an empty set), spare0, spare1.
    Of each member of a tile with two nodes or more: tile, member, low (of the band below), c (members seen together, or COMMON). docs: id, h, text."""
    tops = spec.bands(max(text_bytes, 1))
    share = 2 * (spec.den - spec.num) / spec.num
    bits = min(30, max(4, int(np.ceil(np.log2(max(1.0, 12 * share * text_bytes / 6 / BUCKET_BYTES))))))
    shift, rest = U64(64 - bits), U64(32 - bits)  # of a key, its bucket and 32 bits more travel: few enough chance meetings
    kind = dict(docs.dtypes)["id"]
    facts = f"id {kind}, h bigint, n bigint, node bigint, spare0 bigint, spare1 bigint"
    id_type = docs.select("id").limit(0).toArrow().schema.field(0).type
    flag = U64(1) << U64(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, seen = TaskContext.get().partitionId(), 0, 0
        held_k: list[np.ndarray] = []
        held_n: list[np.ndarray] = []
        names = ["bucket", "keys", "nodes", "hot", "id", "h", "n", "node", "spare0", "spare1"]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            key, node = np.concatenate(held_k) >> rest, np.concatenate(held_n)
            held_k.clear(), held_n.clear()
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[fresh], node[fresh]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            run_of = np.cumsum(first) - 1
            hot = np.bincount(run_of, minlength=1)[run_of] > HOT_ENTRIES
            stay = ~hot | first  # a common key keeps one entry on the usual way, for other tasks to meet
            k, n, told = key[stay], node[stay], key[hot & first]
            edges = np.arange((1 << bits) + 1, dtype=np.uint64) << U64(32)
            cuts, cuts_t = np.searchsorted(k, edges), np.searchsorted(told, edges)
            low32 = k.astype(np.uint32)
            bucket = np.flatnonzero(np.diff(cuts))
            rows = [(int(i), low32[cuts[i] : cuts[i + 1]].tobytes(), n[cuts[i] : cuts[i + 1]].tobytes(), told[cuts_t[i] : cuts_t[i + 1]].astype(np.uint32).tobytes()) for i in bucket]
            if hot.any():  # these tiles have two members already: each lot is a group of its own
                rows.append(((1 << 40) + (task << 16) + serial, key[hot].tobytes(), node[hot].tobytes(), None))
            serial += 1
            empty = [pa.nulls(len(rows), t) for t in (id_type, *[pa.int64()] * 5)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)), *empty], names=names)

        count = 0
        for b in batches:
            n, node, spare = [], [], []
            for _, s in _sets(b.column(2), spec.k):
                k, t, low, can = s.keys(spec, tops)
                held_k.append(k)
                held_n.append(np.where(low, s.node[t] | flag, s.node[t]))
                n.append(s.size)
                node.append(s.node)
                spare.append(can)
                count += len(k)
                if count >= FLUSH:
                    yield from flush()
                    count = 0
            if n:
                size, name, can = np.concatenate(n), np.concatenate(node), np.concatenate(spare, 1)
                # Documents need no meeting: they are dealt by their place in the input, so copies of one text go apart.
                place = (mix(np.arange(seen, seen + len(name), dtype=np.uint64) + (U64(task) << U64(40))) >> U64(24)).view(np.int64) + (1 << 41)
                seen += len(name)
                place = pa.array(place)
                blank = [pa.nulls(len(size), pa.binary())] * 3
                yield pa.RecordBatch.from_arrays([place, *blank, b.column(0), b.column(1), pa.array(size), pa.array(name.view(np.int64), mask=size == 0), pa.array(can[0]), pa.array(can[1])], names=names)
        if count:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "n", "node", "spare0", "spare1", "tile", "member", "low", "c"]
        lots: dict[int, list[tuple[bytes, bytes, bytes]]] = {}  # what one task is dealt: about BUCKET_BYTES a bucket
        for b in batches:
            documents = b.filter(b.column(6).is_valid())
            if documents.num_rows:
                yield pa.RecordBatch.from_arrays([*documents.columns[4:], *(pa.nulls(documents.num_rows, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=names)
            packed = b.filter(b.column(6).is_null())
            for bucket, k, n, told in zip(*(c.to_pylist() for c in packed.columns[:4]), strict=True):
                lots.setdefault(bucket, []).append((k, n, told))
        while lots:
            bucket, lot = lots.popitem()
            n = np.frombuffer(b"".join(x[1] for x in lot), np.uint64)
            common = np.zeros(0, np.uint64)
            if bucket < 1 << 40:
                k = np.frombuffer(b"".join(x[0] for x in lot), np.uint32).astype(np.uint64) + (U64(bucket) << U64(32))
                common = np.unique(np.frombuffer(b"".join(x[2] for x in lot), np.uint32).astype(np.uint64) + (U64(bucket) << U64(32)))
            else:
                k = np.frombuffer(b"".join(x[0] for x in lot), np.uint64)
            del lot
            order = np.lexsort((n, k))
            k, n = k[order], n[order]
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
            k, n = k[fresh], n[fresh]
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            run_of = np.cumsum(first) - 1
            c = np.bincount(run_of, minlength=1)[run_of]
            c[np.isin(k, common) if bucket < 1 << 40 else slice(None)] = COMMON
            keep = c > 1
            m = int(keep.sum())
            empty = [pa.nulls(m, t) for t in (id_type, *[pa.int64()] * 5)]
            yield pa.RecordBatch.from_arrays([*empty, _signed(k[keep]), _signed(n[keep] & ~flag), pa.array((n[keep] & flag) != 0), pa.array(c[keep])], names=names)

    packed = docs.select("id", "h", "text").mapInArrow(run, f"bucket bigint, keys binary, nodes binary, hot binary, {facts}")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(1 << bits) // 2))
    return packed.repartition(parts, "bucket").mapInArrow(meet, f"{facts}, tile bigint, member bigint, low boolean, c bigint")


def _mixed(rows: DataFrame, name: str) -> DataFrame:
    """The rows of tiles with two different names."""
    tiles = rows.groupBy("tile").agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("tile", "m", F.lit(True).alias("mixed"))
    return attach(rows, saved(rows.sparkSession, tiles, "mixed-tiles"), "tile", "m").where("mixed").select(*rows.columns)


def pruned(met: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile, node) without the tiles that sets can spare and sets without a tile left; and (node, tile): the fullest tile of each set that stays."""
    listed = met.groupBy(F.col("member").alias("node")).agg(F.collect_list(F.struct("c", "tile", "low")).alias("l"))  # as many as a document has keys
    listed = listed.join(nodes.select("node", "spare0", "spare1"), "node")

    def rarest(low: bool, spare: str):
        own = F.sort_array(F.filter("l", lambda x: x["low"] == F.lit(low)))
        return F.slice(own, F.lit(1), F.greatest(F.size(own) - F.col(spare), F.lit(0)).cast("int"))

    stay = listed.select("node", F.array_max("l")["tile"].alias("home"), F.concat(rarest(False, "spare0"), rarest(True, "spare1")).alias("l")).where(F.size("l") > 0)
    stay = saved(met.sparkSession, stay.select("node", "home", F.transform("l", lambda x: x["tile"]).alias("tiles")), "stay")
    rows = stay.select("node", F.explode("tiles").alias("tile"))
    return saved(met.sparkSession, _mixed(rows, "node"), "shared"), stay.select("node", F.col("home").alias("tile"))


def members(docs: DataFrame, spec: Spec) -> DataFrame:
    """The columns before the text, n, set (binary, sorted fingerprints) and bitmap words b0.. of each row. docs: ..., text."""
    more, types = docs.columns[:-1], dict(docs.dtypes)
    names = [*more, "n", "set", *(f"b{i}" for i in range(WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in _sets(b.column(len(more)), spec.k):
                at = np.flatnonzero(s.size)
                bm = s.bitmaps(at)
                sets = [s.values[s.offs[x] : s.offs[x + 1]].tobytes() for x in at]
                lead = [c.take(pa.array(at + i)) for c in b.columns[: len(more)]]
                yield pa.RecordBatch.from_arrays([*lead, pa.array(s.size[at]), pa.array(sets, pa.binary()), *(_signed(np.ascontiguousarray(bm[:, x])) for x in range(WORDS))], names=names)

    return docs.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in more), "n bigint, set binary", *(f"b{i} bigint" for i in range(WORDS))]))


def texts_of(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """What wanted (id, h, ...) has besides, with the text of a row of that id and h. Repeated rows may give repeated rows."""
    more = [c for c in wanted.columns if c not in ("id", "h")]
    w = bounded(wanted.withColumnsRenamed({"id": "__id", "h": "__h"}))
    return src.join(w, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select(*more, "text")


def linked(a: np.ndarray, b: np.ndarray, spec: Spec) -> bool:
    """Exact: sorted arrays of distinct values."""
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    inter = int(np.count_nonzero(y[at] == x))
    return spec.den * inter >= spec.num * (len(a) + len(b) - inter)


def link_tile(nodes: np.ndarray, sets: list[np.ndarray], bitmaps: np.ndarray, spec: Spec, known: np.ndarray | None = None) -> np.ndarray:
    """The smallest node connected to each, inside one tile. Pairs already connected (at the start: of one known component) are not looked at."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    bm = bitmaps[order]
    label = np.arange(len(order)) if known is None else np.unique(known[order], return_inverse=True)[1]
    for i in range(1, len(order)):
        lo = int(np.searchsorted(size, -(-spec.num * size[i] // spec.den)))
        hi = i if spec.differing(size[i]) >= 2 else int(np.searchsorted(size, size[i]))
        if lo >= hi:
            continue
        bound = spec.differing(size[lo:hi])
        far = np.bitwise_count(bm[lo:hi] ^ bm[i]).sum(1, dtype=np.int64)
        near = lo + np.flatnonzero((far <= bound) & (label[lo:hi] != label[i]))
        near = near[np.argsort(far[near - lo], kind="stable")]
        while len(near):
            j = near[0]
            near = near[1:]
            if linked(sets[order[i]], sets[order[j]], spec):
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    out = np.empty(len(order), np.int64)
    low: dict[int, int] = {}
    for i, x in enumerate(label.tolist()):
        v = int(nodes[order[i]])
        low[x] = min(low.get(x, v), v)
    for i, x in enumerate(label.tolist()):
        out[order[i]] = low[x]
    return out


def _arrays(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")], np.stack([table.column(f"b{i}").to_numpy().view(np.uint64) for i in range(WORDS)], 1)


def _salts():
    """Into how many tasks a tile of `total` shingles and `m` sets goes."""
    return F.ceil(F.greatest(F.col("total") / TILE_SHINGLES, F.col("m") / TILE_SETS)).cast("int")


def _first_round(src: DataFrame, home: DataFrame, nodes: DataFrame, spec: Spec) -> DataFrame:
    """(a, b): each candidate node and what it is connected to inside its fullest tile. Sets move once, straight from the texts."""
    placed = saved(src.sparkSession, home.join(nodes.select("node", "n", "id", "h"), "node"), "placed")
    totals = placed.groupBy("tile").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where(F.col("m") > 1)
    placed = attach(placed, saved(src.sparkSession, totals.withColumn("rows", F.col("m")), "totals"), "tile", "rows").where("m IS NOT NULL")
    salts = _salts()
    bridge = (salts > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("m")) < BRIDGES)
    salt = F.when(bridge, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), salts).cast("int")))
    wanted = saved(src.sparkSession, placed.select("id", "h", "node", "tile", salt.alias("salts")), "homes")
    dealt = members(texts_of(src, wanted), spec).withColumn("salt", F.explode("salts")).drop("salts", "n")

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        once = np.unique(nodes, return_index=True)[1]
        nodes, table = nodes[once], table.take(pa.array(once))
        return pa.table([pa.array(nodes), pa.array(link_tile(nodes, *_arrays(table), spec))], names=["a", "b"])

    return dealt.groupBy("tile", "salt").applyInArrow(work, "a bigint, b bigint")


def _named(met: DataFrame, comp: DataFrame) -> DataFrame:
    """(tile, node, comp) of the tiles that still hold different components."""
    named = met.join(comp, "node", "left").select("tile", "node", F.coalesce("label", "node").alias("comp"))
    return _mixed(named, "comp")


def _merge_round(named: DataFrame, sets: DataFrame, spec: Spec, turn: int) -> DataFrame:
    """(a, b): components that a link between some of their members joins.

    Each component names the tile that holds most sets; there every component shows
    two of its members. It only saves work: groups of near copies become few
    components, so that the exact last round has few pairs left.
    """
    pick = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("node"))
    per = named.groupBy("tile", "comp").agg(F.count("*").alias("m"), F.min(pick).alias("x"), F.max(pick).alias("y"))
    full = per.groupBy("tile").agg(F.sum("m").alias("total"), F.count("*").alias("parts"))
    rank = F.struct(F.col("total"), F.col("tile")) if turn % 2 == 0 else F.struct(F.col("parts"), F.xxhash64("tile", F.lit(turn)), F.col("tile"))
    chosen = per.join(full, "tile").groupBy("comp").agg(F.max(rank).alias("r")).select(F.col("r.tile").alias("tile")).distinct()
    shown = per.join(chosen, "tile", "left_semi").select("tile", "comp", F.explode(F.array_distinct(F.array("x.node", "y.node"))).alias("node"))
    placed = shown.join(sets, "node")
    totals = placed.groupBy("tile").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where((F.col("total") > TILE_SHINGLES) | (F.col("m") > TILE_SETS))
    placed = attach(placed, saved(sets.sparkSession, totals.withColumn("rows", F.col("m")), "full-tiles"), "tile", "rows")
    salts = F.coalesce(_salts(), F.lit(1))
    salt = F.pmod(F.xxhash64("comp", F.lit(turn)), salts).cast("int")

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        comp = table.column("comp").to_numpy()
        low = link_tile(comp, *_arrays(table), spec, comp)
        return pa.table([pa.array(comp), pa.array(low)], names=["a", "b"])

    return placed.withColumn("salt", salt).drop("total", "m", "n").groupBy("tile", "salt").applyInArrow(work, "a bigint, b bigint")


def _last_round(named: DataFrame, sets: DataFrame, spec: Spec) -> DataFrame:
    """(a, b): components that a link joins, from all pairs across components of a tile that the bitmap lets through.

    A tile of many sets is cut into g shares; the pairs of shares s <= t are block s * g + t, where share s is on the left and t on the right.
    """
    bits = [f"b{i}" for i in range(WORDS)]
    full = saved(sets.sparkSession, named.groupBy("tile").agg(F.count("*").alias("m")).where(F.col("m") > GRID_SETS).withColumn("g", F.ceil(F.col("m") / GRID_SETS)), "grids")
    g = F.coalesce("g", F.lit(1).cast("bigint"))
    rows = attach(named, full, "tile", "m").withColumn("g", g).withColumn("share", F.pmod(F.xxhash64("node", F.lit(11)), "g")).join(sets.drop("set"), "node")
    last = F.col("g") - 1
    x = rows.withColumn("block", F.explode(F.transform(F.sequence("share", last), lambda t: F.col("share") * F.col("g") + t))).alias("x")
    y = rows.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), "share"), lambda t: t * F.col("g") + F.col("share")))).alias("y")
    once = F.when(F.col("x.share") == F.col("y.share"), F.col("x.comp") < F.col("y.comp")).otherwise(F.col("x.comp") != F.col("y.comp"))
    less = F.least(F.col("x.n"), F.col("y.n"))
    most = F.greatest(F.col("x.n"), F.col("y.n"))
    far = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits[1:]), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
    could = (F.col("x.n") != F.col("y.n")) | ((spec.den - spec.num) * less >= 2 * spec.num)
    near = (F.col("x.tile") == F.col("y.tile")) & (F.col("x.block") == F.col("y.block")) & once & (spec.den * less >= spec.num * most) & could & (spec.num * far <= (spec.den - spec.num) * less)
    pairs = x.join(y, near).select(F.col("x.node").alias("p"), F.col("y.node").alias("q"), F.col("x.comp").alias("a"), F.col("y.comp").alias("b")).distinct()
    pairs = saved(sets.sparkSession, pairs, "pairs")
    ends = bounded(pairs.select(F.explode(F.array("p", "q")).alias("node")).distinct())
    few = sets.join(ends, "node", "left_semi").select("node", "set")
    both = pairs.join(few.withColumnsRenamed({"node": "p", "set": "sp"}), "p").join(few.withColumnsRenamed({"node": "q", "set": "sq"}), "q").select("a", "b", "sp", "sq")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), spec) for p, q in zip(b.column(2), b.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(verify, "a bigint, b bigint").distinct()


def _relabel(spark: SparkSession, comp: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """Components after edges between them, and how many were joined to another."""
    edges = saved(spark, edges.where("a <> b").distinct(), "links")
    if edges.isEmpty():
        return comp, 0
    wide = saved(spark, components(spark, edges).select(F.col("node").alias("label"), F.col("label").alias("wide")), "merges")
    known = comp.join(wide, "label", "left").select("node", F.coalesce("wide", "label").alias("label"))
    alone = wide.join(comp.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("wide").alias("label"))
    return saved(spark, known.unionByName(alone), "components"), wide.where("label <> wide").count()


def _joined_across(src: DataFrame, named: DataFrame, comp: DataFrame, nodes: DataFrame, spec: Spec) -> DataFrame:
    """Components after the links between those that still share a tile."""
    spark = src.sparkSession
    wanted = saved(spark, named.select("node").distinct().join(nodes.select("node", "id", "h"), "node"), "late")
    sets = saved(spark, members(texts_of(src, wanted), spec).dropDuplicates(["node"]), "sets", codec="none")
    release(spark)
    for turn in range(MERGE_ROUNDS):
        comp, joined = _relabel(spark, comp, _merge_round(named, sets, spec, turn))
        if not joined:
            break
        named = saved(spark, _named(named.drop("comp"), comp), "mixed")
    final, _ = _relabel(spark, comp, _last_round(named, sets, spec))
    discard(sets)
    return final


def _classes(src: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(id, h, n, node) of each row; and of nodes whose class has several rows: node, low (a struct none, id, h of the class's first row), rows. src: id, h, text."""
    spark = src.sparkSession
    arrow_batches(spark)
    bytes_ = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    both = saved(spark, survey(src, spec, bytes_), "survey")
    release(spark)
    known = both.where("n IS NOT NULL").select("id", "h", "n", "node", "spare0", "spare1")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("low")
    nodes = known.where("node IS NOT NULL").groupBy("node").agg(first, F.count("*").alias("rows"), *(F.min(c).alias(c) for c in ("n", "spare0", "spare1")))
    nodes = saved(spark, nodes.select("node", "low", "rows", "n", "spare0", "spare1", "low.id", "low.h"), "nodes")
    shared, home = pruned(both.where("tile IS NOT NULL").select("tile", "member", "low", "c"), nodes)
    comp = saved(spark, components(spark, _first_round(src, home, nodes, spec)), "components")
    named = saved(spark, _named(shared, comp), "mixed")
    discard(shared)
    if not named.isEmpty():
        comp = _joined_across(src, named, comp, nodes, spec)
    discard(named)
    per = nodes.select("node", "low", "rows").join(comp, "node", "left").select("node", "low", "rows", F.coalesce("label", "node").alias("class"))
    per = saved(spark, per, "per-node")
    lows = per.groupBy("class").agg(F.min("low").alias("first"), F.sum("rows").alias("total"), F.count("*").alias("parts")).where("total > 1").drop("total")
    lows = saved(spark, lows, "lows")
    groups = attach(per.select("node", "class", "rows"), lows, "class", "parts").where("first IS NOT NULL")
    return known.select("id", "h", "n", "node"), saved(spark, groups.select("node", F.col("first").alias("low"), "rows"), "groups")


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    value = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(value).alias("h"), value.alias("text"))


def join(docs: DataFrame, spec: Spec = Spec(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id (under its own name), n_shingles, component_id (smallest id connected by links)."""
    known, groups = _classes(_source(docs, doc_id, text), spec)
    out = attach(known, groups, "node", "rows")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("low.id", "id").alias("component_id"))


def deduplicate(docs: DataFrame, spec: Spec = Spec(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: one with the smallest id, null ids last. All columns stay, under any names.

    Rows go by id and a 64-bit hash of the text, so an id with several texts may be in
    several groups. Of rows equal in both, any one stays. Rows without shingles are in
    no group: repeats of one id and text leave one row, and those with a null id all stay.
    """
    spark = docs.sparkSession
    known, groups = _classes(_source(docs, doc_id, text), spec)
    found = saved(spark, attach(known, groups, "node", "rows"), "classes")
    several = found.where("low IS NOT NULL")
    first = F.col("id").eqNullSafe(F.col("low.id")) & (F.col("h") == F.col("low.h"))
    blank = found.where("node IS NULL AND id IS NOT NULL").select("id", "h")
    gone = saved(spark, several.where(~first).select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct(), "gone")
    stay = several.where(first).select("id", "h").unionByName(blank)
    again = saved(spark, stay.groupBy("id", "h").agg(F.count("*").alias("m")).where("m > 1").select(F.col("id").alias("__id"), F.col("h").alias("__h")), "repeats")
    own = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own).withColumn("__row", F.xxhash64(F.col(f"__c{docs.columns.index(text)}").cast("string")))
    key = f"__c{docs.columns.index(doc_id)}"

    def pick(keys: DataFrame, how: str) -> DataFrame:
        return rows.join(bounded(keys), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__h")), how)

    if again.isEmpty():
        kept = pick(gone, "left_anti")
    else:
        # The aggregation keeps one row a task before the shuffle, however often a row repeats.
        kept = pick(gone.unionByName(again), "left_anti").unionByName(pick(again, "left_semi").dropDuplicates([key, "__row"]))
    return kept.drop("__row").toDF(*own.values())
