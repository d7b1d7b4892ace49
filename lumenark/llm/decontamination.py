"""Benchmark decontamination: a prefix-filtered set join with exact containment.

A window is `width` consecutive words of a benchmark item (a shorter item is one
window). The set of a window is its 5-word shingles. Shingles are ordered by how
often they occur in the whole corpus; as containment must be complete, the
necessary prefix is one shingle, the rarest. Documents are probed for prefix
shingles only; a probe fixes where the window would start, which gives the
positional and length bounds, and all its words are then compared.

Words are compared by 64-bit fingerprints, and equal windows are found by one. The index of a block of items is
broadcast; blocks hold at most `block_bytes` of item text (or one item). A larger
benchmark is probed block by block: each is an exact pass over all documents that
writes its hits alone, and its index is destroyed before the next one is built, so
driver, executors and workers hold one index at a time however large it is.

Defined results: null and empty texts have no words and are never hit; an item
without words has no window; repeated documents give repeated rows; repeated
item rows count as one item; an item with a null id is no item of the benchmark (a
hit could not name it); with an empty benchmark nothing is contaminated;
extra columns are ignored by `find` and kept, under any name, by `filter_documents`.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import ALNUM, LOWER_TABLE, U64, Words, arrow_batches, chunks, gram_starts, grams, per_text, string_bytes
from .storage import attach, saved

#: The index of a block takes about 6 times its text once made, and the driver about 30 times while it is made (500 MB for 16 MB).
WIDTH, SHINGLE, BLOCK_BYTES = 10, 5, 16 << 20
_FILTER_BITS = 22


class KeySet:
    """Sorted fingerprints behind a bit filter."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in g of members, and their numbers."""
        at = np.flatnonzero(self.filter[(g & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        ok = self.keys[k] == g[at]
        return at[ok], k[ok]


class Index:
    """Windows of a block of items, by the width of their shingles (under 5 words: the window itself).

    All of it is arrays: the words of the items one after another, the distinct
    windows as places in them, and the items of each window.
    """

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        items = sorted({(str(i), t) for i, t in items if t}, key=lambda x: (x[0], x[1]))
        data, offs = string_bytes(pa.array([t for _, t in items], pa.large_string()))
        self.names = [i for i, _ in items]
        parts, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in chunks(offs):
            w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
            parts.append(w.hashes(LOWER_TABLE))
            count.append(w.count)
        self.h, n = np.concatenate(parts), np.concatenate(count)
        first = np.cumsum(n) - n
        windows = np.where(n > 0, np.maximum(n - width, 0) + 1, 0)
        owner = np.repeat(np.arange(len(n)), windows)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
        length = np.minimum(n, width)[owner]
        own = np.zeros(len(start), np.uint64)  # of a window: its words and their number
        for size in np.unique(length).tolist():
            at = np.flatnonzero(length == size)
            own[at] = grams(self.h, size)[start[at]]
        _, once, window = np.unique(own, return_index=True, return_inverse=True)
        self.start, self.length = start[once], length[once]
        pairs = np.unique(window.astype(np.int64) * max(len(n), 1) + owner)
        self.owner = (pairs % max(len(n), 1)).astype(np.int32)
        self.owners = np.searchsorted(pairs, np.arange(len(once) + 1) * max(len(n), 1))
        by_item = np.concatenate([first, [len(self.h)]]).astype(np.int64)
        self.groups: dict[int, dict] = {}
        for k in np.unique(np.minimum(self.length, SHINGLE)).tolist():
            # Shorter shingles stand for whole items alone; others for all places.
            at = self.start[self.length == k] if k < SHINGLE else gram_starts(by_item, k)
            self.groups[k] = {"all": KeySet(grams(self.h, k)[at])}

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.owners[window] : self.owners[window + 1]].tolist()]

    def count(self, h: np.ndarray, by_text: np.ndarray) -> dict[int, np.ndarray]:
        """Occurrences of each shingle."""
        out = {}
        for k, x in self.groups.items():
            starts = gram_starts(by_text, k)
            _, num = x["all"].find(grams(h, k)[starts])
            out[k] = np.bincount(num, minlength=len(x["all"].keys))
        return out

    def choose_prefix(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps, of each window, the rarest shingle (ties: the first)."""
        for k, x in self.groups.items():
            g, keys = grams(self.h, k), x.pop("all").keys
            mine = np.flatnonzero(np.minimum(self.length, SHINGLE) == k)
            at = np.zeros(len(mine), np.int64)
            for size in np.unique(self.length[mine]).tolist():
                these = np.flatnonzero(self.length[mine] == size)
                begin = self.start[mine[these]]
                best = None
                for o in range(size - k + 1):
                    freq = counts[k][np.searchsorted(keys, g[begin + o])]
                    better = freq < best if best is not None else np.ones(len(begin), bool)
                    best = np.where(better, freq, best) if best is not None else freq
                    at[these[better]] = o
            prefix = g[self.start[mine] + at]
            by = np.argsort(prefix, kind="stable")
            x["prefix"], x["u"], x["o"] = KeySet(prefix), mine[by].astype(np.int32), at[by].astype(np.int16)
            x["from"] = np.searchsorted(prefix[by], x["prefix"].keys).astype(np.int32)
            x["to"] = np.searchsorted(prefix[by], x["prefix"].keys, "right").astype(np.int32)

    def probe(self, h: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start word, window and text of every occurrence of a window."""
        found = []
        texts = np.repeat(np.arange(len(by_text) - 1), np.diff(by_text))
        for k, x in self.groups.items():
            starts = gram_starts(by_text, k)
            at, num = x["prefix"].find(grams(h, k)[starts])
            n = (x["to"][num] - x["from"][num]).astype(np.int64)
            pos = np.repeat(starts[at], n)
            slot = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x["from"][num], n)
            win = x["u"][slot]
            start = pos - x["o"][slot]
            text = texts[pos]
            ok = (start >= by_text[text]) & (start + self.length[win] <= by_text[text + 1])
            start, win, text = start[ok], win[ok], text[ok]
            for lo in range(0, len(start), 1 << 17):  # bounded memory however common a passage is
                s, u, t = start[lo : lo + (1 << 17)], win[lo : lo + (1 << 17)], text[lo : lo + (1 << 17)]
                same = np.ones(len(s), bool)
                for j in range(int(self.length[u].max())):
                    inside = self.length[u] > j
                    same &= ~inside | (h[np.minimum(s + j, len(h) - 1)] == self.h[np.minimum(self.start[u] + j, len(self.h) - 1)])
                found.append((s[same], u[same], t[same]))
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(benchmark: DataFrame, block_bytes: int, item_id: str, text: str) -> Iterator[list]:
    """Items in blocks whose text is bounded; an item longer than a block is a block of its own."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("i IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)
        yield [tuple(r) for r in part.collect()]


def _index(docs: DataFrame, items: list, width: int) -> Index:
    """The index of a block, its prefixes chosen by the counts of all documents."""
    spark = docs.sparkSession
    index = Index(items, width)
    sent = spark.sparkContext.broadcast(index)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        total = {k: np.zeros(len(x["all"].keys), np.int64) for k, x in ix.groups.items()}
        for b in batches:
            data, offs = string_bytes(b.column(0))
            for i, j in chunks(offs):
                w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
                for k, c in ix.count(w.hashes(LOWER_TABLE), w.by_text).items():
                    total[k] += c
        for k, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], names=["k", "num", "n"])

    counts = {k: np.zeros(len(x["all"].keys), np.int64) for k, x in index.groups.items()}
    if counts:
        found = docs.select("__text").mapInArrow(counted, "k bigint, num bigint, n bigint").groupBy("k", "num").agg(F.sum("n").alias("n")).toArrow()  # at most the shingles of one block
        size, num, n = (found.column(c).to_numpy() for c in ("k", "num", "n"))
        for k, c in counts.items():
            c[num[size == k]] = n[size == k]
    index.choose_prefix(counts)
    sent.destroy()
    return index


HITS = "n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, hits array<struct<start:bigint,end:bigint>>"


def _probed(docs: DataFrame, sent, all_rows: bool) -> DataFrame:
    """The columns before __text, and HITS by the index that was sent; only rows with a hit unless all_rows. docs: ..., __text."""
    keep, types = docs.columns[:-1], dict(docs.dtypes)
    tail = ["n_words", "n_hit", "n_items", "item_ids", "hits"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value if sent is not None else None
        for b in batches:
            if not b.num_rows:
                continue
            data, offs = string_bytes(b.column(len(keep)))
            n_words, n_hit, names, spans = [], [], [], []
            for i, j in chunks(offs):
                w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
                h = w.hashes(LOWER_TABLE) if ix else np.zeros(len(w.starts), np.uint64)
                edge = np.zeros(len(h) + 1, np.int64)
                items: dict[int, set[str]] = {}
                if ix:
                    start, win, t = ix.probe(h, w.by_text)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + ix.length[win], -1)
                    for pair in np.unique(t * len(ix.length) + win).tolist() if len(t) else ():
                        items.setdefault(pair // len(ix.length), set()).update(ix.items_of(pair % len(ix.length)))
                hit = np.cumsum(edge[:-1]) > 0
                n_words.append(w.count)
                n_hit.append(per_text(hit, w.by_text))
                for d in range(j - i):
                    names.append(sorted(items.get(d, ())))
                    if d in items:
                        x = np.diff(np.concatenate([[0], hit[w.by_text[d] : w.by_text[d + 1]].astype(np.int8), [0]]))
                        spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist(), strict=True)])
                    else:
                        spans.append([])
            cols = [pa.array(np.concatenate(n_words).astype(np.int64)), pa.array(np.concatenate(n_hit).astype(np.int64)), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(span))]
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=[*keep, *tail])
            yield out if all_rows else out.filter(pa.array(np.concatenate(n_hit) > 0))

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), HITS]))


def _merged(spans):
    """Sorted spans of several blocks as disjoint ones."""
    joined = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), joined)


def find(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, block_bytes: int = BLOCK_BYTES, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: the kept columns, n_words, n_hit (words inside windows), n_items, item_ids (sorted strings) and hit spans (word start and end, end exclusive)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    blocks = _blocks(benchmark, block_bytes, item_id, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _probed(picked, spark.sparkContext.broadcast(_index(picked, first, width)), True)
    keyed = picked.withColumn("__key", F.md5("__text"))  # hits depend on the text alone
    parts: list[DataFrame] = []
    for items in itertools.chain((first, second), blocks):
        sent = spark.sparkContext.broadcast(_index(picked, items, width))
        hits = _probed(keyed.select("__key", "__text"), sent, False).groupBy("__key").agg(F.first("item_ids").alias("item_ids"), F.first("hits").alias("hits"), F.count("*").alias("m"))
        parts.append(saved(spark, hits, "block-hits"))
        sent.destroy()
    every = functools.reduce(DataFrame.unionByName, parts)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids"))))
    every = every.groupBy("__key").agg(ids.alias("item_ids"), _merged(F.flatten(F.collect_list("hits"))).alias("hits"), F.max("m").alias("m"))  # a row a block at most
    counts = _probed(keyed.select(*[F.col(f"`{c}`") for c in keep], "__key", "__text"), None, True).select(*[F.col(f"`{c}`") for c in keep], "__key", "n_words")
    got = attach(counts, saved(spark, every, "hits"), "__key", "m")
    hits = F.coalesce("hits", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    n_hit = F.aggregate(hits, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    names = F.coalesce("item_ids", F.array().cast("array<string>"))
    return got.select(*[F.col(f"`{c}`") for c in keep], "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), names.alias("item_ids"), hits.alias("hits"))


def filter_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The documents without a hit, with all their columns under any names."""
    own = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    found = find(docs.toDF(*own), benchmark, tuple(own), text=f"__c{docs.columns.index(text)}", **kw)
    return found.where("n_hit = 0").select(*own).toDF(*own.values())


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], width: int = WIDTH) -> dict[object, tuple[int, int, list[str]]]:
    """For tests: words, hit words and items of each document, by looking at every place."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(str(i), tuple(w[s : s + width])) for i, t in items if i is not None and (w := split(t)) for s in range(max(len(w) - width, 0) + 1)]
    out = {}
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for name, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    names.add(name)
        out[d] = (len(w), len(hit), sorted(names))
    return out


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
