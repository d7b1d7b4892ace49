"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat
from .quality_rules import BIT, CURRENT, POLICIES, RULES

_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BITS = " + ".join(f"CASE WHEN {r.fails} THEN CAST({BIT[r.name]} AS BIGINT) ELSE 0 END" for r in RULES)
_ONLY = "length(regexp_replace(t, '[^{}]', '', 'g'))"
OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACE}') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, range(5) r(k)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_SPACE}') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 {_ONLY.format("#*$%&|<>")} AS n_symbols, coalesce(lines.n - lines.u, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
 {_ONLY.format("A-Z")} AS n_upper, {_ONLY.format("A-Za-z")} AS n_letters, {_ONLY.format("0-9")} AS n_digits,
 len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same_next
 FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, {_BITS} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {POLICIES["base"].mask} <> 0 AS base_failed, (failed & {POLICIES[CURRENT].mask}) = 0 AS kept, failed AS failed_bits FROM f"""

OP5 = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(ws[i:i + 9], ' ') AS win, least(len(ws), 10) AS n FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS ws FROM documents),
p AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN win USING (win, n)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_SPACE}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a"""

OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((strpos('0123456789abcdef', substr(x, 1 + 5 * k // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(x, 2 + 5 * k // 4, 1)) - 1) >> (3 - (5 * k) % 4)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (x)"""


def _escaped(column: str, newlines: bool) -> str:
    out = f"replace({column}, '\\', '{chat.BACKSLASH}')"
    for control, code in chat.CODES.items():
        out = f"replace({out}, '{control}', '{code}')"
    return f"replace({out}, chr(10), '{chat.NEWLINE}')" if newlines else out


OP9 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
 CAST(sum({len(chat.START) + len(chat.END) + 1} + length({_escaped("role", True)}) + length({_escaped("text", False)})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


OP11 = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 5) r(k))),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, words, a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND a >= 30),
part AS MATERIALIZED (SELECT lang, phrase, words, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
o AS MATERIALIZED (SELECT * FROM f WHERE a >= 30),
lefts AS MATERIALIZED (SELECT part.*, o.a AS l FROM part JOIN o ON o.lang = part.lang AND o.phrase = lp),
cut AS (SELECT t.*, o.a AS r, CAST(2000000::HUGEINT * t.a // (l + o.a) AS BIGINT) AS score FROM lefts t JOIN o ON o.lang = t.lang AND o.phrase = rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, m, unnest(range(1, words - m + 2)) AS i FROM c, range(2, 4) r(m) WHERE m < words) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n.n, score
FROM best b JOIN n USING (lang) LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000""".replace("\\", "\\")


def _op12() -> str:
    """The rounds one after another."""
    steps = ["""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 524288)) = 64)""", """c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q AS c FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 40))"""]
    for i in range(6):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT * FROM (SELECT row, vec_id, q, cluster, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1)""")
        if i < 5:
            steps.append(f"""m{i} AS (SELECT cluster, list(x ORDER BY j) AS c FROM (SELECT cluster, j, CAST(floor_div AS BIGINT) AS x FROM (SELECT cluster, j, (s - ((s % n) + n) % n) // n AS floor_div FROM (SELECT cluster, j, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY cluster, j))) GROUP BY cluster)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a5 JOIN c5 USING (cluster)"""


OP13 = r"""WITH u AS (SELECT page_id, url, instr(url, '://') AS pos, substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (SELECT page_id, url, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
t AS (SELECT *, regexp_matches(url, '[?&]utm_\w+=') AS tracked FROM p WHERE host <> ''),
listed AS (SELECT DISTINCT host || CASE WHEN path = '' THEN '/' ELSE path END AS key FROM t WHERE tracked UNION SELECT host FROM t GROUP BY host HAVING count(*) >= 5 AND count(*) FILTER (WHERE tracked) >= 0.2 * count(*)),
k AS (SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END AS key FROM p WHERE host <> ''
 UNION SELECT page_id, array_to_string(labels[i:], '.') FROM (SELECT page_id, labels, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT page_id, string_split(host, '.') AS labels FROM p WHERE host <> ''))),
hit AS (SELECT DISTINCT page_id FROM k JOIN listed USING (key)),
r AS (SELECT p.page_id, arg_max(rule || '/' || kind, length(rule)) AS best FROM p JOIN (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(kind, h, f) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f), LATERAL (SELECT h || f AS rule) GROUP BY p.page_id)
SELECT p.page_id, host, path, regexp_extract(best, '^(.*)/(allow|block)$', 1) AS rule, hit.page_id IS NOT NULL AS listed, CASE WHEN best IS NOT NULL THEN regexp_extract(best, '(allow|block)$') WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN hit USING (page_id) LEFT JOIN r USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op5_decontamination": OP5, "op6_jaccard": OP6, "op8_warc": OP8, "op9_chat": OP9, "op11_phrases": OP11, "op12_centroids": _op12(), "op13_url_filter": OP13}
