"""Personal data: weak supervision over span candidates.

Fixed patterns give the base spans, which always stay. Wider patterns propose more
candidates. Five labelers (strict form, checksum, gazetteer, context, counter-
context) vote on every candidate; expectation-maximisation over the counts of all
vote patterns in the corpus estimates how reliable each labeler is, without any
truth; its posteriors train a logistic span classifier, which decides on the
proposed candidates. Fitting sees counts of (kind, votes, length class) only, at
most 8 * 3^5 * 8 rows, gathered over all documents.

Defined results: a null text is empty and has no spans; repeated rows give repeated
rows; with no candidates at all the priors decide; extra columns are ignored by
`find` and kept, under any name, by `redact`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import arrow_batches, byte_class, chunks, per_text, string_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("national_id", "iban", "local_phone", "person")
KINDS = (*BASE_KINDS, *MORE_KINDS)
LABELERS = ("form", "checksum", "gazetteer", "context", "counter")
ABSTAIN, YES, NO = 0, 1, 2

# Gazetteers and context words.
GIVEN_NAMES = frozenset("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah karen charles nancy lisa daniel matthew anthony mark sandra steven ashley paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick frank raymond jack dennis jerry tyler aaron jose adam nathan henry peter anna maria laura julia claire sophie pierre jean marie michel hans klaus wolfgang heinrich ursula petra carlos juan luis pedro carmen lucia sofia elena".split())
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CONTEXT = {
    "email": ("mail", "contact", "e-mail"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "national_id": ("ssn", "social security", "taxpayer"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "person": ("name", "dear", "sincerely", "signed"),
}
COUNTER = ("version", "invoice", "isbn", "page", "figure", "chapter", "serial", "order no")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_LOCAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9.-])")
_PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?\b")
_LOCAL_CHAR = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SIGNS = byte_class((48, 57), (64, 64), (43, 43))
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i & 1))
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(t: str) -> list[Span]:
    """Around each @, for a long run without one would cost the square of its length."""
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL_CHAR:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = t.find("@", at + 1)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(t: str) -> str:
    return "".join(c for c in t if c in "0123456789")


def base_spans(t: str) -> list[Span]:
    """The fixed patterns, leftmost and not overlapping within a kind; by start, then kind."""
    out = _emails(t)
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(t):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in t:
        out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple:
    return s[1], KINDS.index(s[0]), s[2]


def more_spans(t: str, base: list[Span]) -> list[Span]:
    """Candidates beyond the base spans; one that touches a base span is left out."""
    found = [(k, *m.span()) for k, p in (("national_id", _NATIONAL), ("iban", _IBAN), ("local_phone", _LOCAL)) for m in p.finditer(t)]
    found += [("person", *m.span()) for m in _PERSON.finditer(t)]
    starts, ends = sorted(b for _, b, _ in base), sorted(e for _, _, e in base)
    # As many base spans end by its start as begin before its end: none touches it.
    return [s for s in sorted(found, key=_order) if bisect_right(ends, s[1]) == bisect_left(starts, s[2])]


def votes(t: str, span: Span) -> tuple[int, ...]:
    """What each labeler says of a candidate."""
    kind, start, end = span
    s, before = t[start:end], t[max(0, start - 40) : start].lower()
    form = checksum = gazetteer = ABSTAIN
    if kind == "email":
        form = YES if re.search(r"\.[A-Za-z]{2,}$", s) else NO
    elif kind == "ip":
        form = YES if all(p == "0" or p[0] != "0" for p in s.split(".")) else NO
    elif kind == "card":
        checksum = YES
        form = YES if _digits(s)[0] in "3456" else ABSTAIN
    elif kind == "phone":
        form = YES if s.count("(") == s.count(")") else NO
    elif kind == "national_id":
        form = NO if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else YES
    elif kind == "iban":
        flat = s.replace(" ", "")
        gazetteer = YES if flat[:2] in IBAN_LENGTH else NO
        form = YES if IBAN_LENGTH.get(flat[:2]) == len(flat) else NO if flat[:2] in IBAN_LENGTH else ABSTAIN
        checksum = YES if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else NO
    elif kind == "local_phone":
        form = YES if _digits(s)[0] not in "01" else NO
    else:
        words = s.split(" ")[1:]
        gazetteer = YES if words[0].lower() in GIVEN_NAMES else ABSTAIN
        form = YES if len(words) == 2 else ABSTAIN
    context = YES if any(c in before for c in CONTEXT[kind]) else ABSTAIN
    counter = NO if any(c in before for c in COUNTER) else ABSTAIN
    return form, checksum, gazetteer, context, counter


def _length_class(span: Span) -> int:
    return min((span[2] - span[1]) // 5, 7)


@dataclass
class Model:
    """Reliabilities by labeler: P(vote | not personal) and P(vote | personal); priors by kind; classifier weights."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, span: Span, vote: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-_features(KINDS.index(span[0]), vote, _length_class(span)) @ self.weights)))


def _features(kind: int, vote: tuple[int, ...], length: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 3 * len(LABELERS) + 8)
    x[0] = x[1 + kind] = x[1 + len(KINDS) + 3 * len(LABELERS) + length] = 1
    for i, v in enumerate(vote):
        x[1 + len(KINDS) + 3 * i + v] = 1
    return x


def fit_patterns(patterns: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 60) -> Model:
    """EM, then the classifier, from (kind, votes, length class, count) rows."""
    rel = np.zeros((len(LABELERS), 2, 3))
    rel[:, 1], rel[:, 0] = [0.35, 0.6, 0.05], [0.35, 0.1, 0.55]
    seed = rel * 20  # pseudo-counts: a labeler starts as better than chance
    prior = np.array([0.9 if k in BASE_KINDS else 0.5 for k in KINDS])
    first = prior * 10
    post = np.zeros(len(patterns))
    if patterns:
        kind = np.array([p[0] for p in patterns])
        vote = np.array([p[1] for p in patterns])
        n = np.array([p[3] for p in patterns], float)
        for _ in range(rounds):
            like = np.stack([np.log(rel[np.arange(len(LABELERS)), c, vote]).sum(1) for c in (0, 1)], 1)
            like += np.log(np.stack([1 - prior[kind], prior[kind]], 1))
            post = 1 / (1 + np.exp(like[:, 0] - like[:, 1]))
            for c, p in ((0, 1 - post), (1, post)):
                for i in range(len(LABELERS)):
                    rel[i, c] = seed[i, c] + np.bincount(vote[:, i], p * n, minlength=3)
                    rel[i, c] /= rel[i, c].sum()
            up, all_ = np.bincount(kind, post * n, minlength=len(KINDS)), np.bincount(kind, n, minlength=len(KINDS))
            prior = np.clip((first + up) / (10 + all_), 0.01, 0.99)
    # Patterns that the corpus lacks are taught by the priors, with little weight.
    rows = [(k, tuple(v), ln, w) for k, v, ln, w in patterns]
    x = np.array([_features(*r[:3]) for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, len(_features(0, (0,) * 5, 0))))
    grid = [(k, v) for k in range(len(KINDS)) for v in np.ndindex(*(3,) * len(LABELERS))]
    gx = np.array([_features(k, v, 3) for k, v in grid])
    gl = np.array([np.log(rel[np.arange(len(LABELERS)), 1, v]).sum() - np.log(rel[np.arange(len(LABELERS)), 0, v]).sum() + np.log(prior[k] / (1 - prior[k])) for k, v in grid])
    x, y = np.concatenate([x, gx]), np.concatenate([post, 1 / (1 + np.exp(-gl))])
    w = np.concatenate([np.array([1 + np.log1p(r[3]) for r in rows]), np.full(len(grid), 0.05)])
    w /= w.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-x @ theta))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(theta))
        step = np.linalg.solve(h, x.T @ (w * (p - y)) + 1e-3 * theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(rel, prior, theta)


def _texts(batch_column) -> Iterator[tuple[int, str]]:
    """The texts that can hold a span; a glance at the bytes spares decoding the others."""
    data, offs = string_bytes(batch_column)
    for i, j in chunks(offs):
        part = offs[i : j + 1] - offs[i]
        chunk = data[offs[i] : offs[j]]
        signs = per_text(_SIGNS[chunk], part)
        raw = chunk.tobytes()
        for d in range(j - i):
            t = raw[part[d] : part[d + 1]]
            if signs[d] or b"Mr. " in t or b"Mrs. " in t or b"Ms. " in t or b"Dr. " in t or b"Prof. " in t:
                yield i + d, t.decode("utf-8", "replace")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Reliabilities and classifier from the candidates of all documents."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple, int] = {}
        for b in batches:
            for _, t in _texts(b.column(0)):
                base = base_spans(t)
                for s in [*base, *more_spans(t, base)]:
                    key = (KINDS.index(s[0]), *votes(t, s), _length_class(s))
                    count[key] = count.get(key, 0) + 1
        cols = list(zip(*[(*k, n) for k, n in count.items()], strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f"f{i}" for i in range(7)] + ["n"])

    keys = [f"f{i}" for i in range(7)]
    got = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, ", ".join(f"{k} bigint" for k in [*keys, "n"])).groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    return fit_patterns(sorted((r[0], tuple(r[1:6]), r[6], r[7]) for r in got))


def spans_of(t: str, model: Model, threshold: float = 0.5) -> list[tuple[Span, bool, float]]:
    """Spans of a text, whether each is a base span, and its score; by start, then kind."""
    base = base_spans(t)
    scored = [(s, True, 1.0) for s in base]
    for s in more_spans(t, base):
        if (p := model.score(s, votes(t, s))) >= threshold:
            scored.append((s, False, p))
    return sorted(scored, key=lambda x: _order(x[0]))


def redacted(t: str, spans: list[Span]) -> str:
    """t with [KIND] in place of its sorted spans; overlapping ones become one, of the first one's kind. One pass, each part copied once."""
    parts, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            parts += [t[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, t[done:]])


def find(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: the kept columns and `spans`, an array of (kind, start, end, base, score) by start, then kind; code points, end exclusive."""
    arrow_batches(docs.sparkSession)
    model = model or fit(docs, text)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    types = dict(picked.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[]] * b.num_rows
            for r, t in _texts(b.column(len(keep))):
                rows[r] = [{"kind": s[0], "start": s[1], "end": s[2], "base": is_base, "score": p} for s, is_base, p in spans_of(t, model, threshold)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(rows, kind)], names=[*keep, "spans"])

    return picked.mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model | None = None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """All documents, their spans replaced by [KIND]; overlapping spans become one, of the first one's kind. A column n_chars follows the new text."""
    arrow_batches(docs.sparkSession)
    names = docs.columns
    own = [f"__c{i}" for i in range(len(names))]
    at = names.index(text)
    model = model or fit(docs, text)
    src = docs.toDF(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, new = [], []
            for r, t in _texts(b.column(at)):
                if spans := [s for s, _, _ in spans_of(t, model, threshold)]:
                    row.append(r)
                    new.append(redacted(t, spans))
            hit = np.zeros(b.num_rows, bool)
            hit[row] = True
            mask, columns = pa.array(hit), list(b.columns)
            columns[at] = pc.replace_with_mask(columns[at], mask, pa.array(new, columns[at].type))
            yield pa.RecordBatch.from_arrays([*columns, mask], names=[*own, "__hit"])

    types = dict(src.dtypes)
    out = src.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in own), "__hit boolean"]))
    size = lambda i, c: F.when(F.col("__hit"), F.length(own[at]).cast(docs.schema[c].dataType)).otherwise(F.col(own[i])) if c == "n_chars" and i != at else F.col(own[i])
    return out.select(*[size(i, c).alias(c) for i, c in enumerate(names)])
