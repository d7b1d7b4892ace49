"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Best fit depends on lengths alone, and there are at most `capacity` of them. The
driver therefore packs the length histogram: lengths in falling order, each into
the tightest open bin, found in a segment tree over remaining capacities in
logarithmic time; runs of equal lengths and of equal bins are placed together. The
result is exactly that of placing one document after another. Executors then look
up each piece by its length and its rank among pieces of that length.

Ranks come from per-task running counts and a prefix sum over (task, length)
pairs, so no task sees all pieces of a common length. The sums travel as one packed
array a task where they take few bytes, else pieces meet them by (task, length).

Defined results: a null text is empty and gives one piece, the end token; repeated
documents give repeated rows; an empty table gives no sequences; extra columns are
ignored unless named in `keep`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .bytekit import arrow_batches
from .storage import bounded, saved

CAPACITY, END_ID = 2048, 0
#: The word pattern of the byte-level pre-tokeniser (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a tokenizers file, without special tokens added.

    A plain byte-level BPE file is run by tiktoken, which gives the same ids several
    times faster; a text with an added token's string, or any other kind of file,
    goes through tokenizers itself.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        if not plain:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if len(set(ranks.values())) != len(ranks) or any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        import tiktoken

        return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(a in text for a in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # its pattern engine gives up on some huge runs
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class SegmentTree:
    """Which remaining capacities have an open bin."""

    def __init__(self, n: int):
        self.size = 1 << max(n - 1, 1).bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, i: int, on: bool) -> None:
        i += self.size
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def at_least(self, i: int) -> int | None:
        """The smallest set place from i on."""
        i += self.size
        while not self.any[i]:
            while i & 1:  # a right child: nothing further under its parent
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing. Rows: length, first rank, last rank (exclusive), first bin, pieces a bin, offset in it; and the number of bins."""
    tree = SegmentTree(capacity + 1)
    bins: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int, int, int]] = []
    used = 0

    def put(room: int, lo: int, hi: int) -> None:
        if room and lo < hi:
            bins.setdefault(room, []).append((lo, hi))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                room, lo, hi = capacity, used, used + -(-left // (capacity // length))
                used = hi
            else:
                lo, hi = bins[room].pop()
                if not bins[room]:
                    tree.put(room, False)
            each = room // length
            full = min(hi - lo, left // each)
            for n_bins, n in ((full, each), (1, left - full * each)):
                if n_bins and n and lo < hi and n <= each:
                    rows.append((length, rank, rank + n_bins * n, lo, n, capacity - room))
                    put(room - n * length, lo, lo + n_bins)
                    rank, left, lo = rank + n_bins * n, left - n_bins * n, lo + n_bins
            put(room, lo, hi)
    return rows, used


def pieces(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces: the kept columns, piece, start, length, ids (binary, little-endian unsigned 32-bit), and the writing task's number with the piece's rank in it."""
    arrow_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    types = dict(picked.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["piece int, start bigint, length bigint, ids binary, task int, task_rank bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, length, ids, rank = [], [], [], [], [], []
            column = b.column(len(keep))
            for r in range(b.num_rows):
                t = column[r].as_py() or ""
                got = np.append(encode(t), np.uint32(END_ID)).astype("<u4") if t else np.array([END_ID], "<u4")
                n = len(got)
                head = n % capacity if n > capacity else n
                at = 0
                for p in range(1 + (n - (head or capacity)) // capacity):
                    size = (head or capacity) if p == 0 else capacity
                    row.append(r)
                    piece.append(p)
                    start.append(at)
                    length.append(size)
                    ids.append(got[at : at + size].tobytes())
                    rank.append(int(seen[size]))
                    seen[size] += 1
                    at += size
            at_rows = pa.array(row, pa.int32())
            kept = [b.column(i).take(at_rows) for i in range(len(keep))]
            cols = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(row), task, np.int32)), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*keep, "piece", "start", "length", "ids", "task", "task_rank"])

    return picked.mapInArrow(run, schema)


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its place: the kept columns, piece, start, length, ids, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    cut = saved(spark, pieces(docs, keep, text, tokenizer, capacity), "pieces")
    by_task = saved(spark, cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity)
    places = spark.createDataFrame(rows, "length bigint, lo bigint, hi bigint, bin bigint, each bigint, at bigint")
    ordered = Window.partitionBy("length").orderBy("task")
    before = by_task.select("task", "length", (F.sum("n").over(ordered) - F.col("n")).alias("before"))
    before = saved(spark, before, "ranks")
    # One array a task, with a place for every length.
    blank = by_task.select("task").distinct().select("task", F.explode(F.expr(f"sequence(0L, {capacity}L)")).alias("length"), F.lit(0).cast("bigint").alias("before"))
    dense = before.unionByName(blank).groupBy("task", "length").agg(F.max("before").alias("before"))
    packed = dense.groupBy("task").agg(F.transform(F.sort_array(F.collect_list(F.struct("length", "before"))), lambda x: x["before"]).alias("before"))
    tasks = by_task.select("task").distinct().count()
    if tasks * (capacity + 4) * 8 <= storage.BROADCAST_BYTES:
        ranked = cut.join(F.broadcast(packed), "task").withColumn("before", F.get("before", F.col("length").cast("int")))
    else:
        ranked = cut.join(before, ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("task_rank"))
    p = bounded(places).alias("p")  # runs of the plan: bounded by lengths, not by documents
    placed = ranked.alias("r").join(p, (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *[F.col(f"r.`{c}`") for c in keep],
        "piece",
        "start",
        F.col("r.length").alias("length"),
        "ids",
        (F.col("bin") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("r.length")).cast("bigint").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_pieces, length and ids (binary). A group holds at most one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    glue = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    return joined.select("sequence_id", F.size("parts").alias("n_pieces"), "length", glue.alias("ids"))
