"""License recognition by sentence rules.

Texts are cut into pieces (at line ends, and after . ; : ! ? before white space);
a piece is normalised to its lower-cased words. A sentence is a piece, or pieces that
follow each other across single line ends: texts may be wrapped at any column, under
comment signs that are not words. Blank lines, and marks before a line's end, end it.
It is mapped, by the fingerprint of its word sequence, to the number of a known
licence sentence, the first and then the longest where several overlap. The
sequence of known numbers in a document is then matched against ordered rules: the
first rule in order that fits at a place wins and consumes its sentences. Up to
`gap` unknown sentences may stand between the sentences of a rule (holders' names,
addresses); a wrapped one counts once. Counts and places in the results go by pieces.

The tables are fixed and small; they travel with the function.

Defined results: null and empty texts have no sentences; repeated rows give
repeated rows; ties between rules go to the one listed first, which is the longer;
an empty table gives no rows; extra columns are ignored unless named in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import ALNUM, LOWER_TABLE, U64, Words, arrow_batches, chunks, mix, string_bytes

# Names by which licences are referred to, by SPDX identifier.
NAMES = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License, Version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "BSD-3-Clause"],
    "ISC": ["ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0-1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"],
}
# Sentences that refer to a licence; {} is a name.
REFERENCES = [
    f"{subject}{verb} under {article}{{}}{noun}"
    for subject in ("", "This work is ", "This software is ", "This file is ", "This project is ", "This code is ", "This document is ", "This program is ", "The code is ", "The content is ")
    for verb in ("licensed", "released", "distributed", "available", "published", "made available")
    for article in ("", "the ", "a ", "the terms of the ")
    for noun in ("", " license", " licence")
] + ["SPDX-License-Identifier: {}", "License: {}", "License: {} License", "{} License"]
# Sentences of licence texts and notices, in order.
TEXTS = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License");',
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Sentences that end the texts of some licences; the texts are known with and without them.
DISCLAIMERS = {
    lic: [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ]
    for lic in ("BSD-2-Clause", "BSD-3-Clause")
}
GAP = 2
_MARKED = re.compile(r"[.;:!?](?=\s|$)", re.ASCII)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CUT = np.zeros(256, bool)
_CUT[list(b".;:!?")] = True
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\r\n\v\f")] = True
_SEQ = U64(0xD6E8FEB86659FD93)
_SEQ_INV = U64(pow(int(_SEQ), -1, 1 << 64))


def split_sentences(text: str) -> list[tuple[str, ...]]:
    """Normalised sentences that have a word."""
    out = []
    for s in re.split(r"\n|(?<=[.;:!?])(?=[ \t\r\v\f])", text):
        if w := _WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), s)):
            out.append(tuple(w))
    return out


@dataclass(frozen=True)
class Rule:
    name: str
    license: str
    sentences: tuple[int, ...]


class Tables:
    """Known sentences by number, and the ordered rules over them. names and texts: by licence, for example read from a full list of licences."""

    def __init__(self, names: dict[str, list[str]] = NAMES, texts: dict[str, list[str]] = TEXTS, disclaimers: dict[str, list[str]] = DISCLAIMERS):
        number: dict[tuple[str, ...], int] = {}
        full, part, refer = [], [], {}
        for lic, sentences in texts.items():
            ids = [number.setdefault(x, len(number)) for s in sentences for x in split_sentences(s)]
            full.append(Rule(f"{lic}/text", lic, tuple(ids)))
            if lic in disclaimers:
                more = [number.setdefault(x, len(number)) for s in disclaimers[lic] for x in split_sentences(s)]
                full.append(Rule(f"{lic}/whole", lic, (*ids, *more)))
            part.append((lic, ids))
        # One sentence alone tells a licence if no other licence has it.
        owners: dict[int, set[str]] = {}
        for lic, ids in part:
            for i in ids:
                owners.setdefault(i, set()).add(lic)
        single = [Rule(f"{lic}/sentence", lic, (i,)) for lic, ids in part for i in dict.fromkeys(ids) if owners[i] == {lic} and len(list(number)[i]) >= 8]
        for lic, called in names.items():
            for name in called:
                for form in REFERENCES:
                    words = split_sentences(form.format(name.replace("Apache, Version", "Apache License, Version") if "Apache, " in name else name).replace("\n", " "))
                    flat = tuple(w for s in words for w in s)
                    if len(flat) > 1 and flat not in number:
                        number[flat] = len(number)
                        refer[number[flat]] = lic
        self.sentences = list(number)
        self.rules = sorted(full, key=lambda r: -len(r.sentences)) + single + [Rule(f"{lic}/reference", lic, (i,)) for i, lic in refer.items()]
        self.starting: dict[int, list[Rule]] = {}
        for r in self.rules:
            self.starting.setdefault(r.sentences[0], []).append(r)
        data, offs = string_bytes(pa.array([" ".join(x) for x in self.sentences], pa.large_string()))
        w = Words(data, offs, ALNUM)
        keys = sequence_hash(w.hashes(LOWER_TABLE), w.by_text[:-1], w.by_text[1:])
        self.longest = max(map(len, self.sentences))
        self.openers = np.unique(w.hashes(LOWER_TABLE)[w.by_text[:-1]])
        self.number = np.argsort(keys)
        self.keys = keys[self.number]


def sequence_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of word runs [start, end)."""
    n = len(h)
    power, inverse = np.full(n + 1, _SEQ, np.uint64), np.full(n + 1, _SEQ_INV, np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


_tables: Tables | None = None


def tables() -> Tables:
    global _tables
    if _tables is None:
        _tables = Tables()
    return _tables


@dataclass(frozen=True)
class Known:
    """A known sentence: first and last piece, number, and the whole sentences that the pieces before and after it are of."""

    first: int
    last: int
    number: int
    before: int
    after: int

    def unknown_to(self, other: Known) -> int:
        return 0 if other.first == self.last + 1 else other.before - self.after + 1


def match_rules(known: list[Known], t: Tables, gap: int = GAP) -> list[tuple[Rule, int, int]]:
    """Rules over the known sentences of one document: rule, first and last piece."""
    out, i = [], 0
    while i < len(known):
        for rule in t.starting.get(known[i].number, ()):
            k = i
            for want in rule.sentences[1:]:
                nxt = k + 1
                if nxt >= len(known) or known[nxt].number != want or known[k].unknown_to(known[nxt]) > gap:
                    break
                k = nxt
            else:
                out.append((rule, known[i].first, known[k].last))
                i = k
                break
        i += 1
    return out


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (first, last, number), those that do not overlap: the first, then the longest."""
    out, end = [], -1
    for a, z, k in sorted(found, key=lambda x: (x[0], -x[1])):
        if a > end:
            out.append((a, z, k))
            end = z
    return out


def _next(at: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The first of the places from each position on."""
    return np.append(places, size)[np.searchsorted(places, at)]


def sentences_of(data: np.ndarray, offs: np.ndarray, t: Tables) -> tuple[np.ndarray, dict[int, list[Known]]]:
    """The text of every piece of one chunk, and the known sentences by text."""
    w = Words(data, offs, ALNUM)
    h = w.hashes(LOWER_TABLE)
    if not len(h):
        return np.zeros(0, np.int64), {}
    after = np.ones(len(data), bool)
    after[:-1] = _WHITE[data[1:]]
    line, mark = data == 10, _CUT[data] & after
    passed = np.zeros(len(data) + 1, np.int64)
    np.cumsum(line | mark, out=passed[1:])
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(line, out=lines[1:])
    texts = w.texts()
    new = np.ones(len(h), bool)
    new[1:] = (passed[w.starts[1:]] != passed[w.starts[:-1]]) | (texts[1:] != texts[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(h))
    text = texts[starts]
    # A mark behind a line end stands before the line's first word: it is a comment sign.
    here, last = w.starts[starts[1:]], w.starts[starts[1:] - 1]
    marked = _next(last, np.flatnonzero(mark), len(data))
    whole = np.zeros(len(starts), np.int64)
    np.cumsum((text[1:] != text[:-1]) | (lines[here] - lines[last] > 1) | ((marked < here) & (marked < _next(last, np.flatnonzero(line), len(data)))), out=whole[1:])
    pieces = np.arange(len(starts))
    first, final = [pieces], [pieces]
    a, z = pieces[np.isin(h[starts], t.openers)], 1
    while len(a := a[a + z < len(starts)]) and len(a := a[(whole[a + z] == whole[a]) & (ends[a + z] - starts[a] <= t.longest)]):
        first.append(a)
        final.append(a + z)
        z += 1
    i, j = np.concatenate(first), np.concatenate(final)
    key = sequence_hash(h, starts[i], ends[j])
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    hit = np.flatnonzero(t.keys[at] == key)
    n = np.bincount(text, minlength=len(offs) - 1)
    zero = np.cumsum(n) - n
    out: dict[int, list[Known]] = {}
    for a, z, k in _apart(list(zip(i[hit].tolist(), j[hit].tolist(), t.number[at[hit]].tolist(), strict=True))):
        d = int(text[a])
        base = int(zero[d])
        out.setdefault(d, []).append(Known(a - base, z - base, k, int(whole[max(a - 1, 0)]), int(whole[min(z + 1, len(whole) - 1)])))
    return text, out


MATCH = "array<struct<rule:string,license:string,first:bigint,last:bigint>>"


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", gap: int = GAP, licenses: Tables | None = None) -> DataFrame:
    """Per document: the kept columns, n_sentences, n_known and matches (rule, license, first and last sentence, from 0)."""
    arrow_batches(docs.sparkSession)
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    types = dict(picked.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"n_sentences bigint, n_known bigint, matches {MATCH}"])
    kind = pa.list_(pa.struct([("rule", pa.string()), ("license", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = licenses or tables()
        for b in batches:
            data, offs = string_bytes(b.column(len(keep)))
            total, known, found = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [[]] * b.num_rows
            for i, j in chunks(offs):
                text_, by = sentences_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], t)
                total[i:j] = np.bincount(text_, minlength=j - i)
                for d, seq in by.items():
                    known[i + d] = len(seq)
                    found[i + d] = [{"rule": r.name, "license": r.license, "first": a, "last": z} for r, a, z in match_rules(seq, t, gap)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(total), pa.array(known), pa.array(found, kind)], names=[*keep, "n_sentences", "n_known", "matches"])

    return picked.mapInArrow(run, schema)


def brute_force(text: str | None, gap: int = GAP) -> tuple[int, list[tuple[str, int, int]]]:
    """For tests: sentences, and matches by comparing word sequences themselves."""
    t = tables()
    number = {s: i for i, s in enumerate(t.sentences)}
    pieces: list[tuple[str, ...]] = []
    whole: list[int] = []
    ended, at = True, -1  # whether what stands before the next word ends a sentence
    for line in re.split(r"\n", text or ""):
        words = split_sentences(line)
        if not words:
            ended = True
        for n, s in enumerate(words):
            at += ended or n > 0
            ended = False
            pieces.append(s)
            whole.append(at)
        if words:
            rest = _WORD.split(line.lower())[-1]
            ended = bool(_MARKED.search(rest))
    found = [(i, j, number[s]) for i in range(len(pieces)) for j in range(i, len(pieces)) if whole[j] == whole[i] and (s := sum(pieces[i : j + 1], ())) in number]
    known = [Known(i, j, k, whole[i - 1], whole[min(j + 1, len(whole) - 1)]) for i, j, k in _apart(found)]
    return len(pieces), [(r.license, a, z) for r, a, z in match_rules(known, t, gap)]
