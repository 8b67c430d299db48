"""DuckDB SQL for the operators that SQL can express, by their definitions: all pairs, no hashes.

The others have brute-force tests: fitted scores (1, 2), alignments (3), file names of shards (5), seeded draws (7), a
tokenizer (10).
"""

_WORD = r"'[^\x20\x09-\x0D]+'"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_WORD}) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) // {32**k}) % 32 AS BIGINT) + 1, 1)" for g in range(8) for k in (3, 2, 1, 0))

WARC = f"""
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, regexp_extract_all(translate(t[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws
    FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))),
own AS (SELECT doc_id, line_no, array_to_string(ws, ' ') AS line, ws FROM l WHERE len(ws) > 0),
u AS (SELECT line, any_value(ws) AS ws, min((doc_id, line_no)) AS first FROM own GROUP BY line),
d AS (SELECT line, first, i AS at, array_to_string(ws[1:i - 1] || ws[i + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM u WHERE len(ws) >= 8)),
near AS (SELECT a.line, b.first FROM d a JOIN d b ON a.rest = b.rest AND a.at = b.at AND a.line <> b.line
    UNION ALL SELECT d.line, u.first FROM d JOIN u ON d.rest = u.line WHERE len(u.ws) >= 8 UNION ALL SELECT u.line, d.first FROM d JOIN u ON d.rest = u.line WHERE len(u.ws) >= 8),
best AS (SELECT u.line, u.first AS own, least(u.first, coalesce(min(near.first), u.first)) AS keep FROM u LEFT JOIN near USING (line) GROUP BY u.line, u.first)
SELECT doc_id, line_no, keep[1] AS first_doc_id, keep[2] AS first_line_no, CASE WHEN keep = best.own THEN 0 ELSE 1 END AS edits
FROM own JOIN best USING (line) WHERE (doc_id, line_no) > keep
"""

_GAP = r"'[\x20\x09-\x0D]+'"

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORD}) AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM d),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY k),
l AS (SELECT k, source, t, trim(translate(regexp_replace(x, {_GAP}, ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS line, len(regexp_extract_all(x, {_WORD})) AS n
    FROM (SELECT k, source, t, unnest(ls) AS x FROM w)),
h AS (SELECT source, count(DISTINCT t) AS documents FROM d GROUP BY source),
o AS (SELECT l.source, line FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, documents
    HAVING count(DISTINCT t) >= 10 AND count(DISTINCT t) > CAST(documents AS DOUBLE) * CAST('0.08' AS DOUBLE)),
x AS (SELECT k, sum(n) AS gone FROM l JOIN o ON l.line = o.line AND l.source IS NOT DISTINCT FROM o.source GROUP BY k),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, {_GAP}, '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.gone, 0) AS BIGINT) AS removed_words
    FROM w LEFT JOIN r USING (k) LEFT JOIN x USING (k))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= CAST(n_words AS DOUBLE) * CAST('0.2' AS DOUBLE) AS kept FROM f
"""

ORACLES = {"op9_quality_rules": QUALITY_RULES, "op4_near_duplicates": NEAR_DUPLICATES, "op6_warc": WARC, "op8_line_dedup": LINE_DEDUP}
