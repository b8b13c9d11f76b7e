"""DuckDB SQL for the queries of this subpackage."""

from __future__ import annotations

from tellurion.llm import licenses, quality

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT source, source_size, k, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(k % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
v AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY ratio, k) - cap))
             / (sum(w) OVER () - sum(w) OVER (ORDER BY ratio, k) + w) AS level FROM v),
m AS (SELECT arg_min(level, (ratio, k)) FILTER (level <= ratio) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE w * water END AS target FROM l, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
g AS (SELECT source, h, sum(size) AS gs FROM d GROUP BY source, h),
c AS (SELECT source, h, sum(gs) OVER (PARTITION BY source ORDER BY h) AS upto, gs FROM g),
x AS (SELECT c.source, c.h, CASE WHEN upto <= rest THEN 1 WHEN upto - gs > rest THEN 0 WHEN rest - (upto - gs) >= upto - rest THEN 1 ELSE 0 END AS more
      FROM c JOIN (SELECT *, target - passes * source_size AS rest FROM p) q ON c.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * (passes + more))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.STOP_WORDS)
_RULES = " AND ".join(f"{n} {d} {b}" for n, d, b in quality.RULES)

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
a AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
pos AS (SELECT doc_id, unnest(w[:greatest(len(w) - 7, 0)]) AS first, generate_subscripts(w[:greatest(len(w) - 7, 0)], 1) AS i FROM a),
win AS (SELECT p.doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM pos p JOIN a USING (doc_id)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(8) AS r(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             len(list_filter(w, lambda v: lower(v) IN ({_STOP})))::BIGINT AS n_stop,
             length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM a LEFT JOIN cov USING (doc_id)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols * 100.0 / n_words ELSE 0 END AS symbol_percent,
             CASE WHEN n_words > 0 THEN n_stop * 100.0 / n_words ELSE 0 END AS stop_percent,
             CASE WHEN n_lines > 0 THEN n_dup_lines * 100.0 / n_lines ELSE 0 END AS dup_line_percent,
             CASE WHEN word_chars > 0 THEN n_upper * 100.0 / word_chars ELSE 0 END AS shout_percent,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULES} AS kept FROM q
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT p.k, p.i, x.n, array_to_string(p.w[p.i:p.i + x.n - 1], ' ') AS g, len(p.w) AS total FROM p, (SELECT DISTINCT n FROM g) x WHERE p.i + x.n - 1 <= len(p.w)),
h AS (SELECT o.k, o.i, o.n, g.item_id FROM o JOIN g USING (n, g)),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
f AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN f USING (k)
"""

_TABLE = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
_HINT = licenses.HINT.replace("'", "''")


def _licenses() -> str:
    """The ordered rules as one common table each: what is left of the sequence, and what was found."""
    steps, last = [], "r0"
    for n, (pattern, name) in enumerate(licenses.RULES, 1):
        wide = "," + pattern.replace(",", ",,") + ","
        steps.append(
            f"r{n} AS (SELECT k, CASE WHEN contains(rest, '{wide}') THEN replace(rest, '{wide}', ',;,') ELSE rest END AS rest, "
            f"CASE WHEN contains(rest, '{wide}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{n}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x FROM documents),
x AS (SELECT k, string_split(regexp_replace(regexp_replace(x, '{licenses.BLANK}', chr(1), 'g'), '{licenses.BREAK}', '\1' || chr(1), 'g'), chr(1)) AS g FROM d WHERE regexp_matches(x, '{_HINT}')),
u AS (SELECT k, unnest(g) AS raw, generate_subscripts(g, 1) AS i FROM x),
v AS (SELECT k, i, raw, s FROM (SELECT *, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'), ' ') AS s FROM u) WHERE regexp_matches(s, '{licenses.HINT_LOW}')),
t(s, id) AS (VALUES {_TABLE}),
whole AS (SELECT k, i, 0 AS j, id FROM v JOIN t USING (s)),
part AS (SELECT k, i, unnest(g) AS line, generate_subscripts(g, 1) AS j FROM (SELECT k, i, string_split(raw, chr(10)) AS g FROM v ANTI JOIN whole USING (k, i))),
line AS (SELECT k, i, j, id FROM (SELECT k, i, j, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'), ' ') AS s FROM part) JOIN t USING (s)),
n AS (FROM whole UNION ALL FROM line UNION ALL SELECT k, i, 0, '?' FROM v ANTI JOIN (FROM whole UNION ALL FROM line) USING (k, i)),
e AS (SELECT k, list(id ORDER BY i, j) AS seq FROM n GROUP BY k),
best AS (SELECT d.k, coalesce(seq, []) AS seq, list_filter(coalesce(seq, []), lambda v: v <> '?') AS ids FROM d LEFT JOIN e USING (k)),
r0 AS (SELECT k, ',' || array_to_string(seq, ',,') || ',' AS rest, []::VARCHAR[] AS found FROM best WHERE len(ids) > 0),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_license_sentences, (len(seq) - len(ids))::BIGINT AS n_unknown, array_to_string(ids, ',') AS sentence_ids,
       coalesce(array_to_string(found, ','), '') AS licenses
FROM d JOIN best USING (k) LEFT JOIN {last} USING (k)
"""


LICENSES = _licenses()
