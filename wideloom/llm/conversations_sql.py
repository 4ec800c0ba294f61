"""SQL for the repair of conversations: the same edits as one walk through the states of the grammar.

States are 0 (nothing yet), 1 after s, 2 after u, 3 after a.  Up to two insertions may follow every turn.
"""

# One step of the checksum per bit; DuckDB has no crc32.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

REPAIR = f"""
WITH RECURSIVE
harmed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS harm
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
kept AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN harm = 0 THEN []::INT[] WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy FROM harmed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM kept),
turns AS (SELECT *, role[1] AS ini, lead(role[1]) OVER w AS next_ini,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
       WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (next_ini IS NOT NULL AND ini || next_ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
steps(was, sign, now) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(was, now, letters, cost) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (0, 3, 'II', 6),
  (1, 2, 'I', 3), (1, 3, 'II', 6), (2, 3, 'I', 3), (3, 2, 'I', 3)),
ways AS (
  SELECT c.conv_id, 0::BIGINT AS i, now AS state, cost, letters AS audit FROM (SELECT DISTINCT conv_id FROM conversations) c, added WHERE was = 0
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit FROM (
    SELECT w.conv_id, w.i + 1 AS i, a.now AS state, min({{'cost': w.cost + e.cost + a.cost, 'audit': w.audit || e.letter || a.letters}}) AS best
    FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1,
      LATERAL (SELECT w.state AS now, 'D' AS letter, 4 AS cost
               UNION ALL
               SELECT s.now, CASE WHEN t.ini = s.sign THEN 'K' ELSE 'R' END, CASE WHEN t.ini = s.sign THEN 0 ELSE 3 END + CASE WHEN t.fault = 'truncated' THEN 3 ELSE 0 END
               FROM steps s WHERE s.was = w.state AND t.fault NOT IN ('blank', 'duplicate') AND (t.ini = s.sign OR s.sign <> 's')) e
      JOIN added a ON a.was = e.now
    GROUP BY ALL)),
best AS (SELECT w.conv_id, min({{'cost': w.cost, 'audit': w.audit}}) AS b FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.i = coalesce(c.n, 0) AND w.state IN (0, 3) GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(string_split(b.audit, '')) AS letter, generate_subscripts(string_split(b.audit, ''), 1) AS place FROM best WHERE b.audit <> ''),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS p,
  count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS total FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
lines AS (SELECT l.conv_id, l.place, CASE WHEN letter = 'K' THEN t.role WHEN (p - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || CASE WHEN letter = 'I' THEN '' ELSE t.text END AS line
  FROM placed l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i AND l.letter <> 'I' WHERE letter <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS text FROM lines GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, b.b.cost::BIGINT AS cost, b.b.audit AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id"""
