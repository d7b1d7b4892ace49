"""Vector search: exact masked top-k, all-pairs kNN by blocks or by bounded cells, best pairs, a cell index.

Ranks and thresholds go by the whole score (12 places, so that the order of a sum makes
no ties or breaks them); 4 places are shown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import saved
from . import blocks

#: Vectors that are broadcast at most; larger sides meet block by block.
BROADCAST_BYTES, BLOCK = 64 << 20, 2048
#: Rows of a group of cells, and queries of a group, in a search.
PART = 20_000
#: Bytes of vectors that a task of a join of blocks holds of the other side.
HELD = 32 << 20
#: As k: no more others than this are told apart, so none are ranked or left out.
ALL = 1 << 30
PLACES, SHOWN = 12, 4


def shown(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores as results give them."""
    return df.withColumn(score, F.round(score, SHOWN))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))


def normalize(v: Column) -> Column:
    """The norm is made once a vector: within the lambda it would be made for each component."""
    both = F.array(F.struct(v.cast("array<double>").alias("v"), norm(v).alias("n")))
    return F.element_at(F.transform(both, lambda p: F.transform(p["v"], lambda x: x / p["n"])), 1)


def rounded(x: Column, places: int) -> Column:
    """Rounded half away from 0, as the sign goes: what rounds to 0 from below is -0.0."""
    below = (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))
    return F.when(below, -F.round(-x, places)).otherwise(F.round(x, places))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def ivf_params(rows: int, dim: int) -> tuple[int, int]:
    """Cells: the root of the row count, 1 to 4096; sub-vectors: the largest divisor of dim up to an eighth of it."""
    cells = min(max(int(rows**0.5), 1), 4096)
    return cells, next(d for d in range(max(dim // 8, 1), 0, -1) if dim % d == 0)


def top_k(rows: DataFrame, query: list[float] | Column, k: int, id_: str = "image_id", vector: str = "vector", allowed: Column | DataFrame | None = None, min_score: float | None = None, exclude: int | None = None) -> DataFrame:
    """Exact cosine top-k among allowed rows: filtered first, then a distributed top-k; ties by id. Zero vectors score 0. Scores are whole; `shown` rounds them."""
    if isinstance(allowed, DataFrame):
        rows = rows.join(allowed.select(id_), id_, "left_semi")
    elif allowed is not None:
        rows = rows.where(allowed)
    if exclude is not None:
        rows = rows.where(F.col(id_) != exclude)
    q = query if isinstance(query, Column) else literal(query)
    score = F.round(dot(F.col(vector), q) / (norm(F.col(vector)) * norm(q)), PLACES)
    df = rows.where(F.col(vector).isNotNull()).select(id_, score.alias("score"))
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    return df.orderBy(F.desc("score"), F.asc(id_)).limit(k)


def similar(rows: DataFrame, id_value: int, k: int = 24, id_: str = "image_id", vector: str = "vector", **kw) -> DataFrame:
    """Nearest rows to one row, itself left out."""
    got = rows.where(F.col(id_) == id_value).select(vector).head()
    if not got or got[0] is None:
        return rows.select(id_, F.lit(0.0).alias("score")).limit(0)
    return top_k(rows, list(got[0]), k, id_, vector, exclude=id_value, **kw)


def text_top_k(rows: DataFrame, model, text: str, k: int, **kw) -> DataFrame:
    """Nearest rows to a text, by a model with embed_texts; the one query is embedded on the driver."""
    return top_k(rows, [float(x) for x in model.embed_texts([text])[0]], k, **kw)


def mean_direction(rows: DataFrame, vector: str = "vector") -> list[float] | None:
    """Normalised mean of a bounded set of vectors."""
    got = rows.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("v")).orderBy("pos").collect()
    v = np.array([r.v for r in got])
    return (v / max(np.linalg.norm(v), 1e-12)).tolist() if len(v) else None


def _pieces(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other: np.ndarray, k: int, threshold: float) -> Iterator[pd.DataFrame]:
    """The k best others of each row, by blocks of rows. A block meets the others by tiles of BLOCK rows; what is held of it is cut to the k best a row when it has more, and these bound what the next tiles add. With k above the number of others nothing is held."""
    for lo in range(0, len(ids) if len(other) else 0, BLOCK):
        mine, least = x[lo : lo + BLOCK], np.full(min(BLOCK, len(ids) - lo), threshold)
        held, size = [], 0

        def cut(held: list[pd.DataFrame]) -> pd.DataFrame:
            d = pd.concat(held).sort_values(["a", "score", "b"], ascending=[True, False, True])
            return d.groupby("a", sort=False).head(k)

        for at in range(0, len(other), BLOCK):
            s = np.round(mine @ other[at : at + BLOCK].T, PLACES)
            s[ids[lo : lo + BLOCK, None] == other_ids[None, at : at + BLOCK]] = -np.inf
            r, c = np.nonzero(s >= least[:, None])
            d = pd.DataFrame({"r": r, "a": ids[lo + r], "b": other_ids[at + c], "score": s[r, c]})
            if k >= len(other):
                yield d.drop(columns="r")
                continue
            held.append(d)
            size += len(d)
            if size > 2 * k * len(mine):
                held = [cut(held)]
                size = len(held[0])
                full = held[0].groupby("r")["score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                least[full.index] = np.maximum(threshold, full["min"])
        if held:
            yield cut(held).drop(columns="r")


def _best(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other: np.ndarray, k: int, threshold: float) -> pd.DataFrame:
    out = list(_pieces(ids, x, other_ids, other, k, threshold))
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64"), "score": np.zeros(0)})


def _unit(column) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_cells(x: np.ndarray, k: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """Directions of at most k cells of unit vectors."""
    k = min(k, len(x)) or 1
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)] if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        at = (x @ centres.T).argmax(1)
        for c in np.unique(at):
            m = x[at == c].mean(0)
            centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return centres


@dataclass
class CellJoin:
    """edges of `knn`; of all pairs of cells that hold rows, how many were looked at."""

    edges: DataFrame
    pairs: int
    made: int


def _candidates(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose score is at least that of x's row, and the scores. Single precision, with its largest error allowed for, leaves few pairs to score in full; where it leaves many, all are."""
    s = x32 @ y32.T
    slack = (x.shape[1] + 8) * 1.2e-7
    at = np.flatnonzero(s >= (least - slack).astype(np.float32)[:, None] - np.float32(2e-7))
    if len(at) * 20 > s.size:
        s = np.round(x @ y.T, PLACES)
        r, c = np.nonzero(s >= least[:, None])
        return r, c, s[r, c]
    r, c = np.divmod(at, len(y))
    score = np.round(np.einsum("ij,ij->i", x[r], y[c]), PLACES)
    ok = score >= least[r]
    return r[ok], c[ok], score[ok]


class _Nearest:
    """The k best others of each row so far, of all that `meet` was given; cut to k a row when more than twice that are held, and these bound what later ones add."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, threshold: float):
        self.ids, self.x, self.x32, self.k = ids, x, x.astype(np.float32), k
        self.least, self.held, self.size = np.full(len(ids), threshold), [], 0

    def meet(self, at: np.ndarray, other_ids: np.ndarray, other: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows `at` meet others. Yields what need not be held."""
        other32 = other.astype(np.float32)
        for lo in range(0, len(at), BLOCK // 4):
            mine = at[lo : lo + BLOCK // 4]
            x, x32 = self.x[mine], self.x32[mine]
            for to in range(0, len(other), BLOCK):
                r, c, score = _candidates(x, other[to : to + BLOCK], x32, other32[to : to + BLOCK], self.least[mine])
                keep = self.ids[mine[r]] != other_ids[to + c]
                d = pd.DataFrame({"r": mine[r[keep]], "b": other_ids[to + c[keep]], "score": score[keep]})
                if self.k >= ALL:
                    yield self._named(d)
                    continue
                self.held.append(d)
                self.size += len(d)
                if self.size > 2 * self.k * len(self.ids) + BLOCK:
                    self._cut()

    def _cut(self) -> None:
        d = pd.concat(self.held).sort_values(["r", "score", "b"], ascending=[True, False, True])
        d = d.groupby("r", sort=False).head(self.k)
        full = d.groupby("r")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.least[full.index] = np.maximum(self.least[full.index], full["min"])
        self.held, self.size = [d], len(d)

    def _named(self, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": self.ids[d["r"]], "b": d["b"], "score": d["score"]})

    def best(self) -> Iterator[pd.DataFrame]:
        if self.held:
            self._cut()
            yield self._named(self.held[0])


def _packed(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, v, block, *keys) as blocks: a row a block, with ids, vectors and int keys as bytes, in the order of the keys. Vectors of floats stay such."""
    kind = np.float32 if "float" in dict(rows.dtypes)["v"] else np.float64

    def pack(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values([*keys, "id"])
        v = np.stack([np.asarray(r, kind) for r in d["v"]])
        out = {"ids": d["id"].to_numpy(np.int64), "v": v} | {k: d[k].to_numpy(np.int32) for k in keys}
        return pd.DataFrame({"block": [d["block"].iloc[0]], "double": [kind is np.float64], **{k: [x.tobytes()] for k, x in out.items()}})

    return rows.groupBy("block").applyInPandas(pack, ", ".join(["block int, double boolean, ids binary, v binary", *[f"{k} binary" for k in keys]]))


def _unpacked(d: pd.Series, of: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block."""
    ids = np.frombuffer(d[f"ids_{of}"], np.int64)
    v = np.frombuffer(d[f"v_{of}"], np.float64 if d[f"double_{of}"] else np.float32).reshape(len(ids), -1).astype(np.float64)
    return ids, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def knn_by_cells(rows: DataFrame, k: int = 20, threshold: float = 0.42, id_: str = "image_id", vector: str = "vector", cells: int | None = None, sample: int = 20_000, part_rows: int = 4096) -> CellJoin:
    """The exact edges of `knn` for tables that cannot be broadcast.

    Rows are dealt into cells by direction (centres fitted on at most `sample` rows), large
    cells into parts of about `part_rows`, and parts into blocks of about as many rows. Each
    cell is first joined with itself. Then a pair of cells is joined only if the best cosine
    that their centres and widths allow reaches the threshold and the worst k-th score that
    the first cell has so far. Blocks meet where they lie (`blocks.met`): vectors are not
    copied for the pairs, and a task keeps the k best of its block in HELD bytes of others.
    What reaches the driver are centres, and widths of cells. Vectors without a direction
    are a cell of their own that meets all, or have no edge above 0.
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    src = rows.where(F.col(vector).isNotNull()).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))
    n, dim = src.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "a bigint, b bigint, score double"
    if not n:
        return CellJoin(spark.createDataFrame([], schema), 0, 0)
    k = k if k < n else ALL
    centres = fit_cells(_unit(src.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["v"]), cells or min(ivf_params(n, 8)[0], 1024))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _unit(b["v"])
                s, none = x @ centres.T, ~x.any(1)
                d = b.assign(cell=np.where(none, len(centres), s.argmax(1)).astype("int32"), near=np.where(none, -1.0, s.max(1)))
                yield d[~none] if threshold > 0 else d

    dealt = saved(spark, src.mapInPandas(deal, f"id bigint, v {dict(src.dtypes)['v']}, cell int, near double"), "dealt")
    stat = {r.cell: (r.n, r.low) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("low")).collect()}  # a row a cell
    if not stat:
        return CellJoin(spark.createDataFrame([], schema), 0, 0)
    there = np.array(sorted(stat), int)
    width = np.arccos(np.clip([stat[c][1] for c in there], -1, 1)) + 1e-7
    at = np.concatenate([centres, np.zeros_like(centres[:1])])[there]
    between = np.arccos(np.clip(at @ at.T, -1, 1)) - 1e-7
    best = np.cos(np.maximum(between - width[:, None] - width[None, :], 0)) + 1e-9

    # Parts of cells, in the order of cells, fill one block after another.
    lots, first, rows_ = [], 0, 0.0
    holds: dict[int, set[int]] = {}
    for i, c in enumerate(there.tolist()):
        size, m = stat[c][0], -(-stat[c][0] // part_rows)
        own = []
        for _ in range(m):
            if rows_ and rows_ + size / m > part_rows:
                first, rows_ = first + 1, 0.0
            rows_ += size / m
            own.append(first)
            holds.setdefault(first, set()).add(i)
        lots.append((c, i, own))
    total = first + 1
    where = F.broadcast(spark.createDataFrame(lots, "cell int, at int, lots array<int>"))
    lot = F.element_at("lots", F.pmod(F.xxhash64("id"), F.size("lots")).cast("int") + 1)
    blocked = saved(spark, _packed(dealt.join(where, "cell").select("id", "v", lot.alias("block"), "at"), ("at",)), "blocks")
    others = max(1, -(-n * dim * 4 // HELD), -(-4 * spark.sparkContext.defaultParallelism // total))
    others = min(others, total)

    def joined(need: np.ndarray) -> DataFrame:
        """The best of cells i and j where need[i, j]."""
        members = [np.array(sorted(holds.get(b, ())), int) for b in range(total)]
        wants = np.zeros((total, len(there)), bool)
        for b, m in enumerate(members):
            wants[b] = need[m].any(0)
        asks = [(b, [o for o, m in enumerate(members) if wants[b, m].any()]) for b in range(total)]
        partners = F.broadcast(spark.createDataFrame(asks, "block int, partners array<int>"))
        bits, shape = np.packbits(need), need.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            need = np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape).astype(bool)
            now, mine = None, None
            for batch in batches:
                for _, d in batch.iterrows():
                    if d["block_x"] != now:
                        if mine is not None:
                            yield from mine.best()
                        now, mine, cell = d["block_x"], _Nearest(*_unpacked(d, "x"), k, threshold), np.frombuffer(d["at_x"], np.int32)
                    ids, y = _unpacked(d, "y")
                    theirs = np.frombuffer(d["at_y"], np.int32)
                    cx, cy = np.unique(cell), np.unique(theirs)
                    kinds, which = np.unique(need[np.ix_(cx, cy)], axis=0, return_inverse=True)
                    for i, asked in enumerate(kinds):  # cells of the same partners meet them together
                        if asked.any():
                            rows, cols = np.isin(cell, cx[which.ravel() == i]), np.isin(theirs, cy[asked])
                            yield from mine.meet(np.flatnonzero(rows), ids[cols], y[cols])
            if mine is not None:
                yield from mine.best()

        x = blocked.join(partners, "block")
        return blocks.met(x, total, blocked, others, F.array_contains("partners_x", F.col("block_y"))).mapInPandas(run, schema)

    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    ranked = lambda df: df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k) if k < ALL else df.withColumn("n", F.lit(0))
    own = saved(spark, ranked(joined(np.eye(len(there), dtype=bool))), "own-edges")
    full = own.where(F.col("n") == k).select(F.col("a").alias("id"), "score")
    worst = dealt.select("id", "cell").join(full, "id", "left").groupBy("cell").agg(F.min(F.coalesce("score", F.lit(-2.0))).alias("s"))
    need = {r.cell: max(threshold, r.s) for r in worst.collect()}  # a row a cell
    least = np.array([need[c] for c in there])
    np.fill_diagonal(best, -9.0)
    more = best >= least[:, None]
    edges = own.drop("n")
    if more.any():
        edges = ranked(edges.unionByName(joined(more))).drop("n")
    return CellJoin(edges, len(there) ** 2, len(there) + int(more.sum()))


def knn(rows: DataFrame, k: int = 20, threshold: float = 0.42, id_: str = "image_id", vector: str = "vector", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(a, b, score): the k most similar other rows of each row, at least as similar as the threshold; ties by id.

    Blocks are multiplied as matrices. A table of up to broadcast_bytes is broadcast; beyond
    that rows meet by cells (`knn_by_cells`).
    """
    spark: SparkSession = rows.sparkSession
    ship(spark)
    src = rows.where(F.col(vector).isNotNull()).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))
    stat = src.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if stat[0] * stat[1] * 8 > broadcast_bytes:
        return knn_by_cells(rows, k, threshold, id_, vector).edges
    src = src.repartition(max(spark.sparkContext.defaultParallelism * 4, 1))  # the work is the product of a task's rows with all
    local = src.toPandas().sort_values("id")
    sent = spark.sparkContext.broadcast((local["id"].to_numpy(), _unit(local["v"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = sent.value
        for b in batches:
            if len(b):
                yield from _pieces(b["id"].to_numpy(), _unit(b["v"]), ids, x, k, threshold)

    return src.mapInPandas(run, "a bigint, b bigint, score double")


def _top(held: pd.DataFrame, n: int) -> pd.DataFrame:
    return held.sort_values(["score", "a", "b"], ascending=[False, True, True]).head(n)


def _top_pairs(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, other: np.ndarray, n: int, threshold: float, held: pd.DataFrame, apart: bool = False) -> pd.DataFrame:
    """The best n pairs a < b of held and new ones; of rows that are apart, no row is on both sides and a may be of either. The threshold rises to the worst of n, so few pairs are made."""
    parts, size, x32, other32 = [held], len(held), x.astype(np.float32), other.astype(np.float32)
    for lo in range(0, len(ids) if len(other) else 0, BLOCK // 4):
        for at in range(0, len(other), BLOCK):
            i, j = slice(lo, lo + BLOCK // 4), slice(at, at + BLOCK)
            r, c, score = _candidates(x[i], other[j], x32[i], other32[j], np.full(len(x[i]), threshold))
            a, b = ids[lo + r], other_ids[at + c]
            d = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})
            parts.append(d if apart else d[a < b])
            size += len(parts[-1])
            if size > 2 * n:
                parts = [_top(pd.concat(parts), n)]
                size, threshold = n, max(threshold, float(parts[0]["score"].iloc[-1]))
    return _top(pd.concat(parts), n)


def top_pairs(rows: DataFrame, n: int, threshold: float, id_: str = "image_id", vector: str = "vector", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(a, b, score): the n most similar pairs of rows, a < b; ties by ids. Each task keeps n pairs, so pairs are never listed in full."""
    spark: SparkSession = rows.sparkSession
    ship(spark)
    src = rows.where(F.col(vector).isNotNull()).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))
    stat = src.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    schema = "a bigint, b bigint, score double"
    none = pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64"), "score": np.zeros(0)})
    if stat[0] * stat[1] * 8 <= broadcast_bytes:
        local = src.toPandas()
        sent = spark.sparkContext.broadcast((local["id"].to_numpy(), _unit(local["v"])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, least = none, threshold
            for b in batches:
                held = _top_pairs(b["id"].to_numpy(), _unit(b["v"]), *sent.value, n, least, held)
                least = max(threshold, float(held["score"].iloc[-1])) if len(held) == n else threshold
            yield held

        part = src.mapInPandas(run, schema)
    else:
        m = max(2, int(-(-stat[0] * stat[1] * 8 // (broadcast_bytes // 4))))
        blocked = saved(spark, _packed(src.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))), "blocks")

        def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, d in batch.iterrows():
                    yield _top_pairs(*_unpacked(d, "x"), *_unpacked(d, "y"), n, threshold, none, d["block_x"] != d["block_y"])

        part = blocks.met(blocked, m, blocked, m, F.col("block_x") <= F.col("block_y")).mapInPandas(pair, schema)
    return part.orderBy(F.desc("score"), "a", "b").limit(n)


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that exist in both directions, once, a < b. They are made once, not for each side."""
    edges = saved(edges.sparkSession, edges, "edges")
    return edges.alias("x").join(edges.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b").select("x.a", "x.b", "x.score")


class CellIndex:
    """Approximate search: rows sorted by k-means cells, so that a scan of the nearest cells skips most row groups; those are ranked exactly."""

    def __init__(self, spark: SparkSession, rows: DataFrame, id_: str = "image_id", vector: str = "vector", sample: int = 50_000, cells: int | None = None, seed: int = 1):
        """Fitted on at most `sample` rows, chosen by hash of the id; every row is indexed."""
        ship(spark)
        self.spark, self.id_, self.vector = spark, id_, vector
        src = rows.where(F.col(vector).isNotNull()).select(id_, vector)
        n = src.count()
        x = _unit(src.orderBy(F.xxhash64(id_)).limit(sample).toPandas()[vector])
        self.centres = fit_cells(x, cells or ivf_params(n, x.shape[1])[0], seed)
        centres = self.centres

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(cell=(_unit(b[vector]) @ centres.T).argmax(1).astype("int32"))

        types = dict(src.dtypes)
        cells_df = src.mapInPandas(assign, f"{id_} {types[id_]}, {vector} {types[vector]}, cell int")
        self.rows = saved(spark, cells_df.repartition("cell").sortWithinPartitions("cell"), "cells")

    def search(self, query: list[float], k: int, probes: int = 24, **kw) -> DataFrame:
        q = np.asarray(query) / max(np.linalg.norm(query), 1e-12)
        near = np.argsort(-(self.centres @ q), kind="stable")[:probes].tolist()
        return top_k(self.rows.where(F.col("cell").isin(near)), list(map(float, query)), k, self.id_, self.vector, **kw)

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.9, sample: int = 256) -> int:
        """The fewest nearest cells that hold at least `target` of the exact k nearest other rows of the queries.

        Measured against all rows, for at most `sample` queries chosen by hash of the id:
        rows in probed cells are ranked exactly, so the recall is the share of them there.
        """
        id_, vector = self.id_, self.vector
        asked = queries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_), id_).limit(sample).select(id_, vector).toPandas()
        if not len(asked):
            return 1
        ids, q = asked[id_].to_numpy(), _unit(asked[vector])

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    cell = dict(zip(b[id_], b["cell"], strict=True))
                    d = _best(ids, q, b[id_].to_numpy(), _unit(b[vector]), k, -2.0)
                    yield d.assign(cell=d["b"].map(cell).astype("int32"))

        w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
        part = self.rows.select(id_, vector, "cell").mapInPandas(nearest, "a bigint, b bigint, score double, cell int")
        true = part.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("a", "cell").toPandas()
        rank = np.argsort(np.argsort(-(q @ self.centres.T), axis=1, kind="stable"), axis=1)
        at = {i: n for n, i in enumerate(ids.tolist())}
        need = np.sort([rank[at[a], c] for a, c in zip(true["a"], true["cell"], strict=True)])
        return int(need[max(int(np.ceil(target * len(need))) - 1, 0)]) + 1 if len(need) else 1

    def search_all(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, score): for each query row the k best other rows of its nearest cells; ties by id.

        Cells and queries are dealt into groups of about PART rows; a task multiplies a group
        of cells with a group of queries, each cell with the queries that probe it.
        """
        id_, vector, centres, least = self.id_, self.vector, self.centres, -2.0
        src = queries.where(F.col(vector).isNotNull()).select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))
        rows = self.rows.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"), "cell")
        many = max(-(-rows.count() // PART), min(self.spark.sparkContext.defaultParallelism, len(centres)))
        lots = max(-(-src.count() // PART), 1)
        kind = dict(src.dtypes)["v"]

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(-(_unit(b["v"]) @ centres.T), axis=1, kind="stable")[:, :probes]
                    yield b.assign(near=list(near.astype("int32")))

        asked = src.mapInPandas(cells, f"id bigint, v {kind}, near array<int>").withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int"))
        asked = asked.withColumn("part", F.explode(F.array_distinct(F.transform("near", lambda c: c % many))))
        rows = rows.withColumn("part", F.col("cell") % many).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

        def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(x) and len(y):
                q, near = _unit(x["v"]), np.zeros((len(x), len(centres)), bool)
                np.put_along_axis(near, np.stack(x["near"].to_list()), True, 1)
                for cell, d in y.groupby("cell"):
                    at = np.flatnonzero(near[:, cell])
                    if len(at):
                        out.append(_best(x["id"].to_numpy()[at], q[at], d["id"].to_numpy(), _unit(d["v"]), k, least))
            d = pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64"), "score": np.zeros(0)})
            return d.sort_values(["a", "score", "b"], ascending=[True, False, True]).groupby("a", sort=False).head(k)

        scored = asked.groupBy("part", "lot").cogroup(rows.groupBy("part", "lot")).applyInPandas(met, "a bigint, b bigint, score double")
        w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
        best = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
        types = dict(self.rows.dtypes)
        return best.select(F.col("a").cast(types[id_]).alias("query_id"), F.col("b").cast(types[id_]).alias(id_), "score")
