"""DuckDB statements for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_SITE_LINES = """
WITH p AS (
  SELECT page_id, regexp_replace(lower(domain), ':\\d*$', '') AS site, string_split(clean_content, chr(10)) AS ls
  FROM pages WHERE domain IS NOT NULL AND clean_content IS NOT NULL
), l AS (
  SELECT page_id, site, CAST(i AS BIGINT) AS line_no, trim(regexp_replace(lower(ls[i]), '[^\\p{L}]+', ' ', 'g')) AS k
  FROM p, unnest(range(1, len(ls) + 1)) AS t(i)
), n AS (SELECT site, count(DISTINCT page_id) AS pages FROM p GROUP BY site),
f AS (
  SELECT l.site, k FROM l JOIN n ON l.site = n.site WHERE k <> ''
  GROUP BY l.site, k, n.pages HAVING count(DISTINCT page_id) >= 6 AND 20 * count(DISTINCT page_id) >= n.pages
)
"""

_SITE_BLOCKS = (
    _SITE_LINES.replace("WITH p AS", "WITH RECURSIVE p AS")
    + """, o AS (SELECT page_id, site, line_no, k, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS ord FROM l WHERE k <> ''),
m AS (SELECT o.* FROM o JOIN f ON o.site = f.site AND o.k = f.k),
e AS (
  SELECT x.site, x.k AS a, y.k AS b FROM m x JOIN m y ON x.page_id = y.page_id AND y.ord = x.ord + 1 JOIN n ON n.site = x.site
  GROUP BY x.site, x.k, y.k, n.pages HAVING count(DISTINCT x.page_id) >= 6 AND 20 * count(DISTINCT x.page_id) >= n.pages
),
g AS (SELECT site, a, b FROM e UNION SELECT site, b, a FROM e),
r AS (SELECT site, k AS a, k AS b FROM f UNION SELECT r.site, r.a, g.b FROM r JOIN g ON r.site = g.site AND r.b = g.a),
b AS (SELECT site, a AS k, min(b) AS block FROM r GROUP BY site, a),
s AS (
  SELECT page_id, line_no, ord, block, lag(block) OVER w AS before, lag(ord) OVER w AS last FROM m JOIN b ON m.site = b.site AND m.k = b.k
  WINDOW w AS (PARTITION BY page_id ORDER BY ord)
),
i AS (SELECT page_id, line_no, sum(CASE WHEN before = block AND last = ord - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY ord) AS run FROM s),
z AS (SELECT page_id, run, min(line_no) AS first, max(line_no) AS last FROM i GROUP BY page_id, run),
t AS (SELECT page_id, count(*) AS blocks, sum(last - first + 1) AS gone FROM z GROUP BY page_id),
d AS (SELECT DISTINCT z.page_id, l.line_no FROM z JOIN l ON l.page_id = z.page_id AND l.line_no BETWEEN z.first AND z.last),
c AS (
  SELECT page_id, array_to_string(list(line ORDER BY line_no), chr(10)) AS text FROM (
    SELECT page_id, CAST(u AS BIGINT) AS line_no, ls[u] AS line
    FROM (SELECT page_id, string_split(clean_content, chr(10)) AS ls FROM pages WHERE clean_content IS NOT NULL), unnest(range(1, len(ls) + 1)) AS q(u)
  ) a ANTI JOIN d USING (page_id, line_no) GROUP BY page_id
)
"""
)

_CONTACT_FORMS = r"""
WITH c AS (
  SELECT contact_id, contact_type, lower(value) AS v, regexp_replace(lower(source_url), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g') AS u
  FROM contacts WHERE contact_type IS NOT NULL AND regexp_matches(value, '[\p{L}\p{N}]') AND regexp_matches(source_url, '[\p{L}\p{N}]')
), x AS (
  SELECT contact_id, contact_type,
    array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(v, '[,;|/]'), lambda s: regexp_replace(s, '[^\p{L}\p{N}]+', '', 'g')), lambda s: s <> '')), chr(1)) AS kv,
    regexp_extract(u, '^(?:([a-z][a-z0-9+.\-]*):)?', 1) AS scheme,
    regexp_extract(u, '^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)', 1) AS auth,
    regexp_extract(u, '^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
    regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q,
    regexp_extract(u, '^[^#]*#(.*)$', 1) AS frag
  FROM c
), k AS (
  SELECT contact_id, contact_type, concat_ws(chr(3), contact_type, kv, scheme, regexp_extract(auth, ':(\d*)\s*$', 1),
    regexp_replace(regexp_replace(auth, ':\d*\s*$', '') || path, '[^\p{L}\p{N}]+', '', 'g'),
    array_to_string(list_sort(list_filter(list_transform(string_split(q, '&'), lambda s: regexp_replace(s, '[^\p{L}\p{N}]+', '', 'g')), lambda s: s <> '')), chr(1)),
    regexp_replace(frag, '[^\p{L}\p{N}]+', '', 'g')) AS form
  FROM x
), g AS (SELECT form, min(contact_id) AS keep_id, count(*) AS n FROM k GROUP BY form HAVING count(*) > 1)
"""

_LEAKS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(ws[i:i+11], ' ') AS g FROM d, unnest(range(1, len(ws) - 10)) AS t(i)),
ew AS (SELECT item_id, array_to_string(ws[i:i+11], ' ') AS g FROM e, unnest(range(1, len(ws) - 10)) AS t(i)),
f AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g))
"""

_LEAK_RUNS = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, i, array_to_string(ws[i:i+WIDTH-1], ' ') AS g FROM d, unnest(range(1, len(ws) - WIDTH + 2)) AS t(i)),
ew AS (SELECT item_id, i AS j, array_to_string(ws[i:i+WIDTH-1], ' ') AS g FROM e, unnest(range(1, len(ws) - WIDTH + 2)) AS t(i)),
"""
# Twelve equal words with up to two others within them have four neighbours equal somewhere: those tell which alignments to compare.
_SUBSTITUTED = _LEAK_RUNS.replace("WIDTH", "4") + """
g AS (SELECT DISTINCT doc_id, item_id, dw.i - ew.j AS diag FROM dw JOIN ew USING (g)),
b AS (
  SELECT g.doc_id, g.item_id, greatest(0, diag) AS a, least(len(d.ws), diag + len(e.ws)) AS z,
    list_transform(range(greatest(0, diag), least(len(d.ws), diag + len(e.ws))), lambda p: d.ws[p+1] = e.ws[p+1-diag]) AS eq
  FROM g JOIN d USING (doc_id) JOIN e USING (item_id)
),
m AS (SELECT doc_id, item_id, list_concat([0], list_filter(range(1, len(eq) + 1), lambda p: NOT eq[p]), [len(eq) + 1]) AS m FROM b),
r AS (SELECT doc_id, item_id, m[least(k + 3, len(m))] - m[k] - 1 - (least(k + 3, len(m)) - k - 1) AS equal_words FROM m, unnest(range(1, len(m))) AS t(k))
SELECT doc_id, item_id, CAST(max(equal_words) AS BIGINT) AS equal_words FROM r GROUP BY doc_id, item_id HAVING max(equal_words) >= 12"""
_ITEM_RUNS = _LEAK_RUNS.replace("WIDTH", "12") + """
h AS (SELECT doc_id, item_id, i, i - j AS diag FROM dw JOIN ew USING (g)),
s AS (SELECT doc_id, item_id, diag, i - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS island FROM h),
r AS (SELECT doc_id, item_id, count(*) + 11 AS run FROM s GROUP BY doc_id, item_id, diag, island)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(run) AS longest_run FROM r GROUP BY item_id"""

_CLASSES = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i+4], ' '))))) AS gs FROM w WHERE len(ws) >= 5),
f AS (SELECT doc_id, gs, min(doc_id) OVER (PARTITION BY gs) AS rep FROM a),
s AS (SELECT rep, unnest(gs) AS g, len(gs) AS n FROM f WHERE doc_id = rep),
c AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
p AS (SELECT a, b FROM c WHERE 10 * shared >= 8 * (na + nb - shared)),
q AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
l AS (SELECT a AS rep, count(*) AS links FROM q GROUP BY a),
r AS (SELECT a AS rep, a AS near FROM q UNION SELECT r.rep, q.b FROM r JOIN q ON q.a = r.near),
k AS (SELECT rep, min(near) AS class_id FROM r GROUP BY rep)
SELECT d.doc_id AS id, coalesce(k.class_id, f.rep, d.doc_id) AS class_id, coalesce(l.links, 0) AS links
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN k ON k.rep = f.rep LEFT JOIN l ON l.rep = f.rep"""

_NEAR = """
WITH w AS (SELECT page_id, list_filter(regexp_split_to_array(lower(clean_content), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM pages WHERE clean_content IS NOT NULL),
s AS (SELECT DISTINCT page_id, hash(ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) AS g FROM w, unnest(range(1, len(ws) - 1)) AS t(i) WHERE len(ws) >= 50),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY page_id),
c AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.page_id < y.page_id GROUP BY 1, 2)
"""

SQL: dict[str, str] = {
    "p1_found": _SITE_LINES + "SELECT page_id, line_no FROM l JOIN f ON l.site = f.site AND l.k = f.k",
    "p1_clean": _SITE_BLOCKS + """SELECT p.page_id, coalesce(length(c.text), 0) AS n_chars, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed_lines,
  coalesce(t.blocks, 0) AS n_removed_blocks FROM pages p LEFT JOIN c USING (page_id) LEFT JOIN t USING (page_id) WHERE p.clean_content IS NOT NULL""",
    "p3_found": _CONTACT_FORMS + "SELECT keep_id, contact_id AS copy_id FROM k JOIN g USING (form) WHERE contact_id <> keep_id",
    "p3_collapsed": _CONTACT_FORMS + "SELECT c.contact_id, c.contact_type, CAST(coalesce(g.n, 1) AS BIGINT) AS n_copies FROM contacts c LEFT JOIN k ON c.contact_id = k.contact_id LEFT JOIN g ON k.form = g.form WHERE g.keep_id IS NULL OR g.keep_id = c.contact_id",
    "p6_found": _NEAR + "SELECT a AS page_id_a, b AS page_id_b FROM c JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE 10 * shared >= 7 * (x.n + y.n - shared)",
    "p6_classes": _CLASSES,
    "p9_items": _ITEM_RUNS,
    "p9_substituted": _SUBSTITUTED,
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM f",
}
