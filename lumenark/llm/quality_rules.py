"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the measurements and
one failure bit per rule. Policies are versioned masks over those bits, so a new
policy, or an ablation of an old one, never reads a text again.

Defined results: a null text is empty (0 words, so `few_words` fails); repeated
rows give repeated rows; an empty table gives an empty ledger; other columns of
the input are kept only if named in `keep`, and may have any name but those of
the ledger's own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import NON_SPACE, U64, Words, arrow_batches, byte_class, chunks, covered, gram_starts, grams, mix, per_text, span_hash, string_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_same_next")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER, _DIGIT = byte_class((65, 90)), byte_class((65, 90), (97, 122)), byte_class((48, 57))


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements holds. Conditions are whole-number arithmetic, alike in any SQL engine."""

    name: str
    fails: str


#: The position of a rule is its bit. Append only: stored ledgers depend on it.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines"),
    Rule("shouting", "n_letters >= 20 AND 10 * n_upper > 5 * n_letters"),
    Rule("digits", "n_letters + n_digits >= 20 AND 10 * n_digits > 5 * (n_letters + n_digits)"),
    Rule("word_length", "word_chars > 40 * n_words OR word_chars < n_words"),
    Rule("stutter", "n_words >= 10 AND 10 * n_same_next > 3 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_words")),
    "v1": Policy("v1", ("few_words", "repeated_words", "symbols", "duplicate_lines")),
    "v2": Policy("v2", tuple(BIT)),
}
CURRENT = "v2"


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of the texts of one chunk."""
    w = Words(data, offs, NON_SPACE)
    n = len(w.count)
    head = (data & 0xC0) != 0x80
    h = w.hashes()
    out = {
        "n_words": w.count,
        "word_chars": per_text(w.mask & head, offs),
        "n_symbols": per_text(_SYMBOL[data], offs),
        "n_upper": per_text(_UPPER[data], offs),
        "n_letters": per_text(_LETTER[data], offs),
        "n_digits": per_text(_DIGIT[data], offs),
    }
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    begin = begin[begin < len(data)] if len(data) else begin[:0]
    begin = np.unique(begin)
    end = np.minimum(np.append(begin[1:], len(data)), len(data))
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10)) if len(begin) else end
    has_word = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[has_word], end[has_word]
    text = np.searchsorted(offs, begin, "right") - 1
    key = mix(span_hash(data, begin, end) + text.astype(np.uint64) * U64(0xD1342543DE82EF95))
    _, at = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text[at], minlength=n)
    texts = w.texts()
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (texts[1:] == texts[:-1])
    out["n_same_next"] = per_text(same, w.by_text)
    starts = gram_starts(w.by_text, 5)
    if len(starts):
        key = mix(grams(h, 5)[starts] + texts[starts].astype(np.uint64) * U64(0xD1342543DE82EF95))
        order = np.argsort(key)
        key = key[order]
        twin = np.zeros(len(key), bool)
        eq = key[1:] == key[:-1]
        twin[1:] |= eq
        twin[:-1] |= eq
        out["n_repeat_words"] = per_text(covered(len(h), starts[order[twin]], 5), w.by_text)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the kept columns, the measurements (long) and `failed` (long, one bit per rule)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    types = dict(picked.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{m} bigint" for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data, offs = string_bytes(b.column(len(keep)))
            got = [measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
            cols = [pa.array(np.concatenate([g[m] for g in got]).astype(np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *cols], names=[*keep, *MEASURES])

    measured = picked.mapInArrow(run, schema)
    bits = " + ".join(f"CASE WHEN {r.fails} THEN CAST({BIT[r.name]} AS BIGINT) ELSE 0 END" for r in RULES)
    return measured.withColumn("failed", F.expr(bits))


def verdict(policy: str | Policy = CURRENT) -> F.Column:
    """True where the policy keeps the row of a ledger."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    return (F.col("failed").bitwiseAND(F.lit(p.mask)) == 0).alias("kept")


def patterns(led: DataFrame) -> DataFrame:
    """The ledger in at most 2 to the number of rules rows: documents by set of failed rules."""
    return led.groupBy("failed").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablation(led: DataFrame, policies: dict[str, Policy] = POLICIES) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that only this rule rejects, and that the policy without it keeps."""
    grid = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit"), F.lit(p.mask).cast("bigint").alias("mask")) for p in policies.values() for r in p.rules])
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda cond: F.sum(F.when(cond, F.col("n_docs")).otherwise(0))
    return (
        patterns(led)
        .select("*", F.inline(grid))  # a fixed grid on at most 2^rules patterns
        .groupBy("policy", "rule")
        .agg(
            count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            count(hit == F.col("bit")).alias("n_only_this"),
            count(hit == 0).alias("n_kept"),
            count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        )
    )


def filter_documents(docs: DataFrame, policy: str | Policy = CURRENT, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns under any names."""
    own = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    led = ledger(docs.toDF(*own), f"__c{docs.columns.index(text)}", tuple(own))
    return led.where(verdict(policy)).select(*own).toDF(*own.values())
