"""SQL for the corpus queries that SQL can express, by plain comparison of all shared shingles or variants."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    """Non-empty words of a text, A-Z lower-cased."""
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.d = e.x)
SELECT d AS doc_id, coalesce(min(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY 1
"""

#: Units of a line (words from 8 on, else characters), and whether it is long enough to have near lines.
UNITS = "CASE WHEN len(w) >= 8 THEN w ELSE list_transform(range(1, length(array_to_string(w, ' ')) + 1), lambda i: array_to_string(w, ' ')[i]) END"

LINES = f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
b AS (SELECT doc_id, unnest(own) AS t, unnest(range(len(own))) AS line FROM a),
c AS (SELECT doc_id, line, w FROM (SELECT doc_id, line, {_words("t")} AS w FROM b) WHERE len(w) > 0),
f AS (SELECT w, min({{'d': doc_id, 'l': line}}) AS first, len(w) >= 8 AS by_word, {UNITS} AS u FROM c GROUP BY w),
o AS (SELECT w, first, by_word, u, len(u) AS n FROM f WHERE by_word OR len(u) >= 20),
v AS (SELECT w, first, by_word, u, n, unnest(range(1, n + 1)) AS i FROM o),
k AS (SELECT w, first, by_word, list_concat(list_concat(u[1:i - 1], [chr(1)]), u[i + 1:n]) AS placed, list_concat(u[1:i - 1], u[i + 1:n]) AS less FROM v),
m AS (SELECT placed, by_word, min(first) AS least FROM k GROUP BY 1, 2 HAVING count(*) > 1),
g AS (SELECT k.w, m.least AS other FROM k JOIN m ON k.placed = m.placed AND k.by_word = m.by_word WHERE m.least < k.first
      UNION ALL SELECT k.w, o.first FROM k JOIN o ON o.u = k.less AND o.by_word = k.by_word WHERE o.first < k.first
      UNION ALL SELECT o.w, k.first FROM k JOIN o ON o.u = k.less AND o.by_word = k.by_word WHERE k.first < o.first),
near AS (SELECT w, min(other) AS other FROM g GROUP BY 1),
gone AS (SELECT c.doc_id, c.line, coalesce(near.other.d, f.first.d) AS earlier FROM c JOIN f ON c.w = f.w LEFT JOIN near ON near.w = c.w
         WHERE near.w IS NOT NULL OR f.first <> {{'d': c.doc_id, 'l': c.line}}),
counts AS (SELECT doc_id, count(*) AS n_lines FROM c GROUP BY 1),
drops AS (SELECT doc_id, count(*) AS n_dropped, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS dropped FROM gone GROUP BY 1),
origins AS (SELECT doc_id, string_agg(CAST(earlier AS VARCHAR), ',' ORDER BY earlier) AS earlier FROM (SELECT DISTINCT doc_id, earlier FROM gone) GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped, coalesce(earlier, '') AS earlier
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN counts USING (doc_id) LEFT JOIN drops USING (doc_id) LEFT JOIN origins USING (doc_id)
"""
