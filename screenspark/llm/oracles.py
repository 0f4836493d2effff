"""SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_MARKS = r"^[ \t]*(?:>[ \t]*)+"
_NORMAL = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def _normal(x: str) -> str:
    return _NORMAL.format(x=x)


OP9 = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM conversations),
raw AS (SELECT conv_id, turn, unnest(l) AS line, unnest(range(len(l))) AS i FROM m),
lines AS (SELECT *, length(regexp_replace(regexp_extract(line, '{_MARKS}'), '[^>]', '', 'g')) AS level FROM raw),
clean AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text,
  string_agg(CASE WHEN level > 0 THEN '' ELSE line END, chr(10) ORDER BY i) AS shown FROM lines GROUP BY conv_id, turn),
own AS (SELECT DISTINCT conv_id, turn, {_normal("piece")} AS k FROM (
  SELECT conv_id, turn, text AS piece FROM clean
  UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(shown, '\\n\\s*\\n')) FROM clean
  UNION ALL SELECT conv_id, turn, line FROM lines WHERE level = 0)),
origin AS (SELECT conv_id, k, min(turn) AS source_turn FROM own WHERE k <> '' GROUP BY conv_id, k),
quoted AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS run, regexp_replace(line, '{_MARKS}', '') AS part FROM lines WHERE level > 0),
passages AS (SELECT conv_id, turn, run, level, string_agg(part, ' ' ORDER BY i) AS passage FROM quoted GROUP BY conv_id, turn, run, level),
asked AS (SELECT DISTINCT conv_id, turn, level, k, length(k) AS size FROM (
  SELECT conv_id, turn, level, {_normal("passage")} AS k FROM passages UNION ALL SELECT conv_id, turn, level, {_normal("part")} FROM quoted) WHERE k <> ''),
links AS (SELECT a.conv_id, a.turn, a.level, o.source_turn, sum(a.size) AS size FROM asked a JOIN origin o ON a.conv_id = o.conv_id AND a.k = o.k WHERE o.source_turn < a.turn GROUP BY a.conv_id, a.turn, a.level, o.source_turn),
parents AS (SELECT conv_id, turn, source_turn AS parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY size DESC, source_turn DESC) AS n FROM links WHERE level = 1) WHERE n = 1),
up AS (SELECT conv_id, turn, parent_turn AS at_turn, 1 AS depth FROM parents
  UNION ALL SELECT u.conv_id, u.turn, p.parent_turn, u.depth + 1 FROM up u JOIN parents p ON p.conv_id = u.conv_id AND p.turn = u.at_turn),
roots AS (SELECT conv_id, turn, arg_max(at_turn, depth) AS root_turn, max(depth) AS depth FROM up GROUP BY conv_id, turn),
walk AS (SELECT DISTINCT c.conv_id, c.turn, [c.turn] AS path FROM clean c WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.conv_id = c.conv_id AND p.turn = c.turn)
  UNION ALL SELECT p.conv_id, p.turn, list_append(w.path, p.turn) FROM walk w JOIN parents p ON p.conv_id = w.conv_id AND p.parent_turn = w.turn),
places AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id, path[1] ORDER BY path) - 1 AS reply_pos FROM walk)
SELECT m.conv_id, m.turn, m.role, c.text, p.parent_turn, coalesce(r.root_turn, m.turn) AS root_turn, coalesce(r.depth, 0) AS depth, coalesce(w.reply_pos, 0) AS reply_pos,
  (SELECT count(*) FROM passages q WHERE q.conv_id = m.conv_id AND q.turn = m.turn) AS n_quotes,
  (SELECT count(*) FROM links k WHERE k.conv_id = m.conv_id AND k.turn = m.turn) AS n_links
FROM m JOIN clean c ON c.conv_id = m.conv_id AND c.turn = m.turn
LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn
LEFT JOIN places w ON w.conv_id = m.conv_id AND w.turn = m.turn
"""
