"""DuckDB SQL for the line deduplication, by whole variants (one row per code point of each line)."""

from __future__ import annotations


def dedup_lines_sql(near_chars: int) -> str:
    """Equal lines of any length, near ones from near_chars; blank lines (of ASCII white space) stay."""
    return f"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS pos FROM parts),
firsts AS (SELECT line, min(doc_id * 10000000 + pos) AS f FROM lines WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY line),
long AS (SELECT line, f FROM firsts WHERE length(line) >= {near_chars}),
places AS (SELECT line, f, unnest(range(1, length(line) + 1)) AS i FROM long),
variants AS (SELECT line, f, i, md5(substr(line, 1, i - 1) || substr(line, i + 1)) AS v FROM places),
late AS (
  SELECT CASE WHEN a.f > b.f THEN a.line ELSE b.line END AS line FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.f < b.f
  UNION SELECT CASE WHEN a.f > b.f THEN a.line ELSE b.line END FROM variants a JOIN long b ON a.v = md5(b.line) AND a.f <> b.f
),
kept AS (
  SELECT l.doc_id, l.pos, l.line, x.f IS NULL OR (l.line NOT IN (SELECT line FROM late) AND l.doc_id * 10000000 + l.pos = x.f) AS stays
  FROM lines l LEFT JOIN firsts x ON x.line = l.line
),
joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS t, bool_and(stays) AS whole FROM kept GROUP BY doc_id
)
SELECT d.doc_id, j.t AS text, d.lang, d.source, CASE WHEN j.whole THEN d.n_chars ELSE length(j.t) END AS n_chars
FROM documents d JOIN joined j USING (doc_id) WHERE j.whole OR trim(regexp_replace(j.t, '\\s+', '', 'g')) <> ''"""
