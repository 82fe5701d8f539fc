"""DuckDB SQL for the queries that SQL can express."""

from .quality import BOILERPLATE, SENTENCE_END, SEPARATORS, SYMBOLS

_END = SENTENCE_END.replace("'", "''")

OP1 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
f AS (SELECT *, list_filter(lines, lambda x: 2 * len(regexp_extract_all(x, '{SYMBOLS}')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
  OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 1 AND 2 * len(regexp_extract_all(x, '!')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
  OR NOT regexp_matches(x, '{_END}') OR len(regexp_extract_all(x, '{SEPARATORS}')) >= 3
  OR regexp_matches(x, '{BOILERPLATE}')) AS failed FROM w),
p AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) > 5),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM p),
d AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i + k) AS n FROM d, range(5) AS q(k) GROUP BY r),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, len(failed)::BIGINT AS n_lines_failed, coalesce(length(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(failed, x)), chr(10))), 0)::BIGINT AS clean_chars,
  coalesce(list_sum(list_transform(failed, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))), 0)::BIGINT AS n_words_lost
  FROM f LEFT JOIN n USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT 100 * n_words_lost > 30 * n_words AS kept FROM a
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
e AS (SELECT DISTINCT r, source, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM (SELECT r, source, unnest(l) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
b AS (SELECT source, list(k) AS ks FROM (SELECT e.source, k FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source
  GROUP BY e.source, k, n HAVING count(*) >= 5 AND count(*) > 0.03 * n) GROUP BY source),
o AS (SELECT d.*, CASE WHEN ks IS NULL THEN l ELSE list_filter(l, lambda x: NOT (regexp_matches(x, '[^\x20\x09-\x0D]')
  AND list_contains(ks, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')))) END AS k
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(k, chr(10)), '') END AS text,
  coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(k), 0)::BIGINT AS n_lines_dropped FROM o
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT *, least(10, len(w)) AS z FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, z, array_to_string(w[i:i+z-1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS i FROM bs)),
dw AS (SELECT r, z, i, array_to_string(w[i:i+z-1], ' ') AS win FROM (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, (SELECT DISTINCT z FROM bw) WHERE len(w) >= z)),
h AS (SELECT r, dw.z, i, item_id FROM dw JOIN bw ON dw.z = bw.z AND dw.win = bw.win),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + z)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""

SQL = {"op1_quality": OP1, "op4_line_dedup": OP4, "op6_decontaminate": OP6}
