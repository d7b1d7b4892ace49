"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier gives each document evidence from measurements of its whole
text. Evidence is summed by host and by (host, path); a host's rate of good
documents is shrunk toward the global rate, a path's toward its host's, each with a
strength estimated by moments from the spread of groups about the rate that they shrink to. The final log-odds
are the document's own plus what its path's posterior says beyond the global rate.

Fitting reads at most `max_labels` labelled rows (a documented bound, chosen by hash
of the id); every other count covers all documents.

Defined results: a null text is empty and is scored like one; a null host or path is a
group of its own; repeated rows count as often as they occur and give repeated rows;
without labels of both kinds the classifier gives the share of good labels, or one
half; an empty table gives no rows; extra columns are ignored unless in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekit import NON_SPACE, U64, Words, arrow_batches, chunks, mix, string_bytes
from .quality_rules import measure
from .storage import attach, saved

MAX_LABELS = 20_000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "stutter", "distinct")


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of features per text of a chunk; shares saturate, as twice too many symbols are not twice as bad."""
    m = {k: v.astype(float) for k, v in measure(data, offs).items()}
    w = Words(data, offs, NON_SPACE)
    key = mix(w.hashes() + w.texts().astype(np.uint64) * U64(0xD1342543DE82EF95))
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(w.texts()[at], minlength=len(offs) - 1)
    n = np.maximum(m["n_words"], 1)
    marks = np.maximum(m["n_letters"] + m["n_digits"], 1)
    cols = [
        np.log1p(m["n_words"]),
        np.minimum(m["word_chars"] / n, 40) / 10,
        np.minimum(m["n_symbols"] / n, 0.3) / 0.3,
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        np.minimum(m["n_repeat_words"] / n, 0.3) / 0.3,
        np.minimum(m["n_upper"] / marks, 0.5) / 0.5,
        np.minimum(m["n_digits"] / marks, 0.3) / 0.3,
        np.minimum(m["n_same_next"] / n, 0.2) / 0.2,
        np.log(np.maximum(distinct, 1) / n) / np.log1p(n),
    ]
    return np.stack(cols, 1)


def measured(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The kept columns and the features."""
    arrow_batches(docs.sparkSession)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    types = dict(picked.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{f} double" for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = string_bytes(b.column(len(keep)))
            got = [features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
            if got:
                x = np.concatenate(got)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(x[:, k].copy()) for k in range(x.shape[1]))], names=[*keep, *FEATURES])

    return picked.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """Log-odds of a good document: weights @ features + bias."""

    weights: tuple[float, ...]
    bias: float

    def log_odds(self) -> Column:
        out = F.lit(self.bias)
        for name, w in zip(FEATURES, self.weights, strict=True):
            out = out + F.lit(w) * F.col(name)
        return out


def fit_rows(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> Model:
    """Logistic regression by Newton steps on standardised features."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model((0.0,) * len(FEATURES), float(np.log(share / (1 - share))))
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    theta = np.zeros(z.shape[1])
    reg = ridge * np.eye(z.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + reg, z.T @ (p - y) / len(z) + reg @ theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    w = theta[:-1] / sd
    return Model(tuple(w.tolist()), float(theta[-1] - w @ mean))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labels: int = MAX_LABELS) -> Model:
    """From at most max_labels labelled documents."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), (F.col(label) > 0).cast("double").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_labels)
    rows = docs.join(F.broadcast(chosen), F.col(f"`{doc_id}`") == F.col("__id")).select("__y", F.col(f"`{text}`").alias("__t"))
    got = np.array(measured(rows, ("__y",), "__t").collect(), float).reshape(-1, 1 + len(FEATURES))
    got = got[np.lexsort(got.T)]
    return fit_rows(got[:, 1:], got[:, 0])


def _strength(groups: DataFrame, rate: Column) -> float:
    """Prior counts: how many documents the wider rate is worth, by moments of the groups about it (n, s: evidence, ss: its squares)."""
    m = F.col("s") / F.col("n")
    within = F.when(F.col("n") > 1, (F.col("ss") - F.col("n") * m * m) / (F.col("n") - 1))
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (m - rate) ** 2).alias("between"), F.sum(within).alias("w"), F.count(within).alias("k"), F.count("*").alias("g")).first()
    if not row.n or row.g < 2:
        return 10.0
    noise = (row.w or 0.0) / max(row.k, 1)
    spread = max((row.between - row.g * noise) / row.n, 1e-6)
    return float(np.clip(noise / spread, 1.0, 1e4))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, path_rate, host_rate) from rows of host, path, p; and the global rate."""
    spark = evidence.sparkSession
    total = lambda: (F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = saved(spark, evidence.groupBy("host", "path").agg(*total()), "path-evidence")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    row = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(row.s / row.n) if row.n else 0.5
    k_host = _strength(hosts, F.lit(rate))
    shrunk = hosts.select("host", ((F.col("s") + F.lit(k_host * rate)) / (F.col("n") + F.lit(k_host))).alias("host_rate"))
    joined = saved(spark, paths.alias("p").join(shrunk.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_rate"), "path-hosts")
    k_path = _strength(joined, F.col("host_rate"))
    path_rate = (F.col("s") + F.lit(k_path) * F.col("host_rate")) / (F.col("n") + F.lit(k_path))
    return joined.select("host", "path", "n", path_rate.alias("path_rate"), "host_rate"), rate


def _site(host: str, path: str) -> Column:
    """One string for a host and a path, nulls told apart."""
    mark = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return F.concat(mark(host), F.lit("/"), mark(path))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """Per document: its id, doc_score, path_rate, host_rate, score and kept (score reaches the threshold)."""
    spark = docs.sparkSession
    model = model or fit(docs, labels, doc_id, text)
    col = lambda c: (F.col(f"`{c}`") if isinstance(c, str) else c).cast("string")
    src = docs.select(F.col(f"`{doc_id}`").alias("__id"), col(host).alias("host"), col(path).alias("path"), F.col(f"`{text}`").alias("__t"))
    odds = measured(src, ("__id", "host", "path"), "__t").select("__id", "host", "path", model.log_odds().alias("odds"))
    evidence = saved(spark, odds.withColumn("p", 1 / (1 + F.exp(-F.col("odds")))), "evidence")
    rates, rate = posteriors(evidence)
    rates = saved(spark, rates, "rates")
    sites = rates.select(_site("host", "path").alias("site"), "path_rate", "host_rate", "n")
    joined = attach(evidence.withColumn("site", _site("host", "path")), sites, "site", "n")
    final = F.col("odds") + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    score = 1 / (1 + F.exp(-final))
    return joined.select(F.col("__id").alias(doc_id), F.round("p", 6).alias("doc_score"), F.round("path_rate", 6).alias("path_rate"), F.round("host_rate", 6).alias("host_rate"), F.round(score, 6).alias("score"), (score >= threshold).alias("kept"))
