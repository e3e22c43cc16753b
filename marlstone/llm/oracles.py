"""DuckDB SQL for the corpus queries that SQL can express on the same tables."""

from __future__ import annotations

from . import decontaminate, secrets

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM split),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), {_LOWER}) AS k FROM lines),
bad AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT keyed.*, bad.k IS NULL OR doc_id = bad.last AS keep FROM keyed LEFT JOIN bad USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
first AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM win JOIN first USING (k) WHERE doc_id > d)),
word AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS x FROM w),
kept AS (SELECT word.*, gone.i IS NULL AS keep FROM word LEFT JOIN gone USING (doc_id, i)),
done AS (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT keep) AS m, string_agg(x, ' ' ORDER BY i) FILTER (keep) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN done USING (doc_id)
"""

QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
twin AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM twin GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls FROM w),
c AS (SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM b GROUP BY source),
p0 AS (SELECT least(greatest(sum(f) / sum(n), 1e-4), 1 - 1e-4) AS m, var_pop(f / n) AS v, avg(1 / n) AS c FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * c, 1e-9) - 1, 1.0), 1000.0) AS k FROM p0),
r AS (SELECT source, (f + m * k) / (n + k) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""


def _portable(pattern: str) -> str:
    """A case-insensitive pattern with its letters spelled out: engines differ in what else they fold."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, inside = "", False
    for c in pattern.removeprefix("(?i)"):
        inside = c == "[" or inside and c != "]"
        out += f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside and out[-1:] != "\\" else c
    return out.replace("[Xx]20", "x20")


_RULES = ", ".join(f"({k}, '{r.kind}', {r.min_length})" for k, r in enumerate(secrets.RULES))
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS whole, regexp_extract_all(t, '{p}', {r.group}) AS part FROM d"
    for k, r in enumerate(secrets.RULES)
    for p in [_portable(r.pattern).replace("'", "''")]
)

SECRET_SCANS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rule AS (SELECT * FROM (VALUES {_RULES}) v(k, kind, least)),
m AS ({_MATCHES}),
x AS (SELECT doc_id, k, unnest(generate_series(1, len(whole))) AS i, unnest(list_transform(gaps[1 : len(whole)], lambda g: length(g))) AS gap,
        unnest(list_transform(whole, lambda g: length(g))) AS size, unnest(list_transform(part, lambda g: length(g))) AS part FROM m),
s AS (SELECT doc_id, k, part, size, sum(gap + size) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM x),
f AS (SELECT doc_id, k, e - size AS b, kind || ':' || (e - size) || ':' || e AS span FROM s JOIN rule USING (k) WHERE part >= least)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY b, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY b, k), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""

_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
_EDGE = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"

DECONTAMINATION = f"""
WITH texts AS (SELECT 'item' AS side, min(item_id) AS id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT 'doc', doc_id, text FROM documents),
word AS (SELECT side, id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS p FROM (SELECT side, id, {_WORDS} AS ws FROM texts)),
bare AS (SELECT *, regexp_replace(regexp_replace(w, '^{_EDGE}', ''), '{_EDGE}$', '') AS c FROM word),
core AS (SELECT side, id, p, CASE WHEN c = '' THEN w ELSE c END AS c FROM bare),
kind0 AS (SELECT side, id, p, translate(c, {_LOWER}) AS c, CASE WHEN regexp_matches(c, '^[0-9]') THEN 1 WHEN regexp_matches(c, '^[A-Z\\x{{C0}}-\\x{{DE}}]') THEN 3 ELSE 0 END AS k FROM core),
kinds AS (SELECT side, id, p, c, CASE WHEN k = 0 AND lag(k) OVER (PARTITION BY side, id ORDER BY p) = 1 AND c IN ({_UNITS}) THEN 2 ELSE k END AS k FROM kind0),
lists AS (SELECT side, id, list(CASE WHEN k = 0 THEN c ELSE chr(1) || k END ORDER BY p) AS toks, list(c ORDER BY p) AS cs, list(k ORDER BY p) AS ks, list(CASE WHEN k > 0 THEN k || c END ORDER BY p) AS slots FROM kinds GROUP BY side, id),
items AS (SELECT *, least(len(toks), {decontaminate.WINDOW}) AS size FROM lists WHERE side = 'item'
          AND (len(toks) >= {decontaminate.WINDOW} OR length(array_to_string(cs, '')) >= {decontaminate.LONE_CHARS} * CASE WHEN len(toks) >= {decontaminate.LONE_WORDS} THEN 1 ELSE 2 END)),
sized AS (SELECT * FROM items UNION ALL SELECT * FROM lists, (SELECT DISTINCT size FROM items) WHERE side = 'doc'),
places AS (SELECT *, unnest(generate_series(1, len(toks) - size + 1)) AS p FROM sized),
win AS (SELECT side, id, p, size, array_to_string(toks[p : p + size - 1], ' ') AS h, array_to_string(cs[p : p + size - 1], ' ') AS c, list_filter(slots[p : p + size - 1], lambda x: x IS NOT NULL) AS slots,
        2 * len(list_filter(ks[p : p + size - 1], lambda x: x = 0)) >= size AS literal FROM places),
d AS (SELECT * FROM win WHERE side = 'doc'), i AS (SELECT * FROM win WHERE side = 'item'),
total AS (SELECT id, count(*) FILTER (literal) AS n_windows, count(*) AS n_all FROM i GROUP BY id),
hit AS (SELECT d.id AS doc_id, i.id AS item_id, d.p - i.p AS off, i.p, true AS template, i.slots AS a, d.slots AS b FROM d JOIN i ON d.size = i.size AND d.h = i.h WHERE d.literal AND i.literal UNION ALL
        SELECT d.id, i.id, d.p - i.p, i.p, false, [], [] FROM d JOIN i ON d.size = i.size AND d.c = i.c WHERE NOT d.literal OR NOT i.literal),
pair AS (SELECT DISTINCT * FROM (SELECT doc_id, item_id, off, p, unnest(a) AS a, unnest(b) AS b FROM hit WHERE template)),
filling AS (SELECT doc_id, item_id, off, a, b, true AS own FROM (SELECT doc_id, item_id, off, a, b, count(*) AS n FROM pair GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, off, a ORDER BY n DESC, b) = 1),
named AS (SELECT doc_id, item_id, off, b, count(*) AS names FROM filling WHERE a LIKE '3%' GROUP BY ALL),
astray AS (SELECT DISTINCT doc_id, item_id, off, p, true AS astray FROM pair LEFT JOIN filling USING (doc_id, item_id, off, a, b) LEFT JOIN named USING (doc_id, item_id, off, b) WHERE own IS NULL OR a LIKE '3%' AND names > 1),
alike AS (SELECT doc_id, item_id, off, bool_and(a = b) AS alike FROM hit GROUP BY ALL),
kept AS (SELECT hit.*, alike FROM hit JOIN alike USING (doc_id, item_id, off) LEFT JOIN astray USING (doc_id, item_id, off, p) WHERE NOT template OR astray IS NULL),
found AS (SELECT doc_id, item_id, count(DISTINCT p) FILTER (template) AS by_template, count(DISTINCT p) AS by_any, bool_and(alike) FILTER (template) AS alike_t, bool_and(alike) AS alike_any FROM kept GROUP BY doc_id, item_id),
s AS (SELECT *, coalesce(by_template / nullif(n_windows, 0), 0) >= {decontaminate.MIN_SHARE} AS enough FROM found JOIN total ON total.id = item_id)
SELECT doc_id, item_id, CASE WHEN enough THEN by_template ELSE by_any END AS n_windows, round(CASE WHEN enough THEN by_template / n_windows ELSE by_any / n_all END, 6) AS share, CASE WHEN enough THEN alike_t ELSE alike_any END AS verbatim
FROM s WHERE enough OR by_any / n_all >= {decontaminate.MIN_SHARE}
"""

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), {_LOWER}) AS x FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST, r) AS place FROM t),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(x) AS text_sha256 FROM p JOIN g USING (x)
"""

HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
