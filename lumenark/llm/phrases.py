"""Phrase collocation mining: sketch bounds, automata of candidates, exact counts.

Texts are lower-cased (A-Z) and cut at delimiters into pieces, pieces into words.

1. Each task joins the texts of a language to units of a few MB, written once. A unit's
   runs of 1 to 4 words are hashed and counted; (cell, count) goes to the slice of a
   count sketch that holds the cell. The sketch has a cell for every few runs of
   the corpus, so it grows with it; each slice is one task's work.
2. A cell whose sum reaches the threshold bounds from above the counts of its runs. The
   slice sends each unit the cells that the unit itself met: nothing is broadcast, and
   no task holds more than its unit's own candidates.
3. A unit compiles its candidates into one automaton, delimiters at both ends, and scans
   its text once, counting all matches, overlapping ones too. Counts are summed over
   units and thresholds applied: the sketch only saves work, the counts are exact.
4. Scores, contained phrases and ranks are joins and aggregations of the counted runs.

Defined results: a null text is empty, a null language is `und`; an empty table gives
no rows; repeated rows count each time; ids and further columns are not looked at. Long
texts are cut between pieces, which loses no run. Scores are decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytekit import TABLE, U64, Words, arrow_batches, byte_class, grams, mix, string_bytes
from .storage import bounded, discard, saved

UNIT_BYTES, CHUNK_BYTES, SLICE_BITS = 4 << 20, 1 << 18, 20
_UPPER, _CUTS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?\x0b\x0c\r"
_WORD = ~byte_class((0x20, 0x20), (0x0A, 0x0A))



@dataclass(frozen=True)
class Spec:
    longest: int = 4
    least: int = 30  # occurrences
    scale: int = 2_000_000
    inside: int = 80  # hundredths of a phrase's occurrences that a longer one explains
    top: int = 2000


def _squeezed(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(b)


def _plain(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def units(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """unit, lang, size, text (zstd): the pieces of a task's texts by language, one a line, in units of about UNIT_BYTES."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    t = F.translate(t, _UPPER + _CUTS + "\t", _UPPER.lower() + "\n" * len(_CUTS) + " ")
    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.regexp_replace(t, " {2,}", " ").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal serial
            blob = b"\n".join(held.pop(lang))
            del size[lang]
            while blob:
                cut = len(blob)
                if cut > 2 * UNIT_BYTES:
                    cut = blob.rfind(b"\n", 0, UNIT_BYTES) + 1 or blob.find(b"\n", UNIT_BYTES) + 1 or cut
                yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + serial], pa.int64()), pa.array([lang]), pa.array([cut], pa.int64()), pa.array([_squeezed(blob[:cut])], pa.binary())], names=["unit", "lang", "size", "text"])
                serial, blob = serial + 1, blob[cut:]

        for b in batches:
            data, offs = string_bytes(b.column(1))
            raw = data.tobytes()
            for i, name in enumerate(b.column(0).to_pylist()):
                piece = raw[offs[i] : offs[i + 1]]
                held.setdefault(name, []).append(piece)
                size[name] = size.get(name, 0) + len(piece) + 1
                if size[name] >= UNIT_BYTES:
                    yield from out(name)
            if sum(size.values()) >= 4 * UNIT_BYTES:
                for name in list(held):
                    yield from out(name)
        for name in list(held):
            yield from out(name)

    return src.mapInArrow(run, "unit bigint, lang string, size bigint, text binary")


def _chunks(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK_BYTES, cut between pieces."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK_BYTES:
            end = text.rfind(b"\n", at, at + CHUNK_BYTES) + 1 or text.find(b"\n", at + CHUNK_BYTES) + 1 or end
        yield text[at:end]
        at = end


def _runs(text: bytes, lang: str, longest: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, and for each length: the first words of runs inside one piece and their fingerprints."""
    data = np.frombuffer(text, np.uint8)
    w = Words(data, np.array([0, len(data)]), _WORD)
    h = w.hashes()
    piece = np.cumsum(data == 10)[w.starts] if len(h) else np.zeros(0, np.int64)
    salt = U64(0)
    for x in lang.encode():
        salt = mix(np.array([salt ^ TABLE[x]], np.uint64))[0]
    out = []
    for n in range(1, longest + 1):
        g = mix(grams(h, n) ^ salt)
        at = np.flatnonzero(piece[: len(g)] == piece[n - 1 : n - 1 + len(g)]) if len(g) else np.zeros(0, np.int64)
        out.append((at, g[at]))
    return w, out


def _planes(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as gaps, byte by byte, compressed."""
    return _squeezed(np.diff(x.astype(np.int64), prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplaned(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(_plain(b), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def candidate_cells(src: DataFrame, spec: Spec, bits: int) -> DataFrame:
    """unit, cells: the cells of each unit whose sum over all units reaches the threshold, by slice. src: units."""
    slices = 1 << (bits - SLICE_BITS)
    cap = np.uint8 if spec.least <= 255 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                every = [g >> U64(64 - bits) for part in _chunks(_plain(text)) for _, g in _runs(part, lang, spec.longest)[1]]
                cells, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
                del every
                n = np.minimum(n, spec.least).astype(cap)
                at = np.searchsorted(cells, np.arange(slices + 1, dtype=np.uint64) << U64(SLICE_BITS))
                full = np.flatnonzero(np.diff(at))
                low = (cells & U64((1 << SLICE_BITS) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), unit), pa.int64()), pa.array([_planes(low[at[i] : at[i + 1]]) for i in full], pa.binary()), pa.array([_squeezed(n[at[i] : at[i + 1]].tobytes()) for i in full], pa.binary())], names=["slice", "unit", "cells", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: dict[int, list[tuple[int, bytes, bytes]]] = {}  # of the few slices that one task is dealt
        for b in batches:
            for s, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lots.setdefault(s, []).append(rest)
        while lots:
            s, lot = lots.popitem()
            total = np.zeros(1 << SLICE_BITS, np.int64)
            for _, cells, n in lot:
                total[_unplaned(cells)] += np.frombuffer(_plain(n), cap)  # cells of one unit are distinct
            high = total >= spec.least
            unit, found = [], []
            for u, cells, _ in lot:
                x = _unplaned(cells)
                if len(x := x[high[x]]):
                    unit.append(u)
                    found.append(_planes(x))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(np.full(len(unit), s), pa.int64()), pa.array(found, pa.binary())], names=["unit", "slice", "cells"])

    parts = max(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), slices // 2)
    dealt = src.select("unit", "lang", "text").mapInArrow(count, "slice bigint, unit bigint, cells binary, counts binary").repartition(parts, "slice")
    return dealt.mapInArrow(meet, "unit bigint, slice bigint, cells binary")


def _bucket(phrases: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((crc32(p.encode()) % buckets for p in phrases), np.int64, len(phrases))


def unit_counts(src: DataFrame, cells: DataFrame, spec: Spec, bits: int, buckets: int) -> DataFrame:
    """lang, phrase, words, n: exact counts of all units' candidates together; and, without a phrase, of all words.

    Counts travel packed: each task sums those of some units, and sends each bucket of
    phrases its own in one compressed piece. A bucket's task sums piece by piece.
    """
    by_unit = cells.groupBy("unit").agg(F.collect_list(F.struct("slice", "cells")).alias("own"))  # as many as the unit's text has
    both = src.join(by_unit, "unit", "left").select("lang", "text", "own")

    def packed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        rows = []
        for lang, count in held.items():
            phrases = sorted(count)
            at = _bucket(phrases, buckets)
            for b in np.unique(at).tolist():
                mine = [phrases[i] for i in np.flatnonzero(at == b).tolist()]
                rows.append((b, lang, _squeezed("\n".join(mine).encode()), _squeezed(np.array([count[p] for p in mine], "<i8").tobytes())))
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["bucket", "lang", "phrases", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, None

        def merged() -> pa.Table:
            parts = [pa.table([pa.array([lang] * len(n)), pa.array(phrases), pa.array(n)], names=["lang", "phrase", "n"]) for lang, phrases, n in held]
            held.clear()
            every = pa.concat_tables([*parts, *([total] if total is not None else [])])
            return every.group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

        for b in batches:
            for lang, phrases, n in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                held.append((lang, _plain(phrases).decode().split("\n"), np.frombuffer(_plain(n), "<i8")))
                size += len(held[-1][1])
                if size > 200_000:
                    total, size = merged(), 0
        if held or total is not None:
            total = merged()
            for b in total.combine_chunks().to_batches(10_000):
                phrases = b.column(1).to_pylist()
                words = [p.count(" ") + 1 if p else 0 for p in phrases]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p or None for p in phrases], pa.string()), pa.array(words, pa.int32()), b.column(2)], names=["lang", "phrase", "words", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *((_unplaned(x["cells"]).astype(np.uint64) | (U64(x["slice"]) << U64(SLICE_BITS))) for x in own or [])]))
                text, automaton = _plain(text), ahocorasick.Automaton()
                spans, offset = [np.zeros((4, 0), np.int64)], 0
                maybe = np.zeros(1 << 22, bool)
                maybe[(hot & U64((1 << 22) - 1)).astype(np.int64)] = True
                for part in _chunks(text) if len(hot) else ():
                    w, runs = _runs(part, lang, spec.longest)
                    for n, (at, g) in enumerate(runs, 1):
                        cell = g >> U64(64 - bits)
                        pick = np.flatnonzero(maybe[(cell & U64((1 << 22) - 1)).astype(np.int64)])
                        pick = pick[hot[np.minimum(np.searchsorted(hot, cell[pick]), len(hot) - 1)] == cell[pick]]
                        g, first = np.unique(g[pick], return_index=True)
                        at = at[pick[first]]
                        spans.append(np.stack([g.view(np.int64), offset + w.starts[at], offset + w.ends[at + n - 1], np.full(len(at), n)]))
                    offset += len(part)
                span = np.concatenate(spans, 1)
                span = span[:, np.unique(span[0], return_index=True)[1]]
                phrases = [text[i:j].decode() for i, j in zip(span[1].tolist(), span[2].tolist(), strict=True)]
                words = span[3].tolist()
                # Single words are no candidates, only parts of them: they are counted as words.
                string = text.decode()
                single = Counter(string.replace("\n", " ").split(" "))
                single.pop("", None)
                n_of = np.zeros(len(phrases), np.int64)
                for i, phrase in enumerate(phrases):
                    if words[i] > 1:
                        automaton.add_word(f" {phrase} ", i)
                    else:
                        n_of[i] = single[phrase]
                if len(automaton):
                    automaton.make_automaton()
                    guarded = f" {string} ".replace("\n", " \n ")
                    n_of += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(guarded)), np.int64), minlength=len(phrases))
                held.setdefault(lang, Counter()).update(dict(zip(phrases, n_of.tolist(), strict=True)) | {"": single.total()})
                if sum(map(len, held.values())) > 200_000:
                    yield from packed(held)
        if held:
            yield from packed(held)

    parts = both.mapInArrow(scan, "bucket bigint, lang string, phrases binary, counts binary")
    return parts.repartition(buckets, "bucket").mapInArrow(merge, "lang string, phrase string, words int, n bigint")


def frequent(docs: DataFrame, spec: Spec = Spec(), lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, phrase, words, n: all runs of up to `longest` words with `least` occurrences; a row without a phrase has n of all words."""
    spark = docs.sparkSession
    arrow_batches(spark)
    src = saved(spark, units(docs, lang, text), "units")
    size = src.agg(F.sum("size")).first()[0] or 0
    bits = SLICE_BITS + max(6, int(np.ceil(np.log2(max(1.0, size / 8) / (1 << SLICE_BITS)))))
    cells = candidate_cells(src, spec, min(bits, SLICE_BITS + 32))
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 25)
    counted = unit_counts(src, cells, spec, min(bits, SLICE_BITS + 32), buckets)
    out = saved(spark, counted.where(F.col("phrase").isNull() | (F.col("n") >= spec.least)), "runs")
    discard(src)
    return out


def scored(runs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the candidates, by their weakest cut. runs: of `frequent`, saved."""
    known = runs.where("phrase IS NOT NULL")
    w = F.split("phrase", " ")
    cut = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), w.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    side = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cut = cut.select("lang", "phrase", "words", "a", "k", side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    # Parts occur at least as often as the whole, so they are among the runs.
    table = known.select("lang", "phrase", "n")
    cut = cut.join(table.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(table.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr(f"CAST({spec.scale} AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def contained(runs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """lang, phrase, longer: the most occurrences of a longer candidate that a phrase lies in."""
    w = F.split("phrase", " ")
    spans = [(lo, n) for n in range(2, spec.longest) for lo in range(1, spec.longest - n + 2)]
    parts = F.array_compact(F.array(*[F.when((F.col("words") > n) & (F.col("words") >= lo + n - 1), F.array_join(F.slice(w, lo, n), " ")) for lo, n in spans]))
    return runs.where("words > 2").select("lang", F.explode(parts).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine(docs: DataFrame, spec: Spec = Spec(), lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    runs = frequent(docs, spec, lang, text)
    rows = scored(runs, spec).join(contained(runs, spec), ["lang", "phrase"], "left")
    rows = rows.where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer") < F.lit(spec.inside).cast("decimal(3,0)") * F.col("a")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of each of 64 parts first, so that no task sorts all of a language.
    part = Window.partitionBy("lang", "part").orderBy(*order)
    few = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= spec.top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= spec.top)
    totals = bounded(runs.where("phrase IS NULL").select("lang", F.col("n").alias("total")))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
