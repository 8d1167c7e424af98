"""DuckDB SQL for conversation repair and the Merkle manifest; both need CRC-32, which is written out."""

from __future__ import annotations

from .repair import ENDS, INSERT, NEXT, REROLE, ROLES, STATES, TRUNCATED

#: A table of 256 remainders, one row.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), n)) AS t)"


def crc32_of(text: str) -> str:
    """CRC-32 of an ASCII text, where crc is joined."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295))"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, (int, str)) else "[" + ", ".join(map(repr, x)) + "]::VARCHAR[]" for x in r) + ")" for r in rows)


def _inserted() -> list[tuple]:
    """(state, state after inserted turns, cost, letters, turns): none, one or two in a row."""
    rows, now = [], [(q, q, 0, "", []) for q in STATES]
    for _ in range(3):
        rows += now
        now = [(a, NEXT[b, x], c + INSERT, s + "I", [*t, ROLES[x] + ":"]) for a, b, c, s, t in now for x in ROLES if (b, x) in NEXT]
    return rows


def repair_oracle() -> str:
    keeps = [(q, x, after) for (q, x), after in NEXT.items()]
    reroles = [(q, ROLES[x], after) for (q, x), after in NEXT.items() if x in ROLES]
    return rf"""
WITH RECURSIVE {CRC_TABLE},
ins(a, b, icost, iaudit, iturns) AS (VALUES {_values(_inserted())}),
keeps(st, ini, nst) AS (VALUES {_values(keeps)}), reroles(st, named, nst) AS (VALUES {_values(reroles)}),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_of("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS twice FROM k WHERE kind <> 0),
p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, twice) AS pos FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again > 1 THEN 'd' WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '.' END AS fault,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS ini FROM p),
e AS (
  SELECT conv_id, pos, st, st AS nst, 2 AS cost, 'D' AS letter, []::VARCHAR[] AS said FROM f, range(0, {len(STATES)}) q(st)
  UNION ALL SELECT conv_id, pos, st, nst, CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END, 'K', [role || ':' || text] FROM f JOIN keeps ON f.ini = keeps.ini WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, pos, st, nst, {REROLE} + CASE fault WHEN 't' THEN {TRUNCATED} ELSE 0 END, 'R', [named || ':' || text] FROM f, reroles WHERE fault NOT IN ('b', 'd')),
it AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS said FROM f
  UNION ALL
  SELECT conv_id, pos, st, cost, audit, said FROM (
    SELECT it.conv_id, it.pos + 1 AS pos, e.nst AS st, it.cost + icost + e.cost AS cost, it.audit || iaudit || e.letter AS audit, list_concat(list_concat(it.said, iturns), e.said) AS said,
      row_number() OVER (PARTITION BY it.conv_id, it.pos, e.nst ORDER BY it.cost + icost + e.cost, it.audit || iaudit || e.letter) AS best
    FROM it JOIN ins ON it.st = ins.a JOIN e ON e.conv_id IS NOT DISTINCT FROM it.conv_id AND e.pos = it.pos + 1 AND e.st = ins.b) WHERE best = 1),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY conv_id),
g AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair FROM f) GROUP BY conv_id),
z AS (
  SELECT it.conv_id, cost + icost AS cost, audit || iaudit AS audit, list_concat(said, iturns) AS said, row_number() OVER (PARTITION BY it.conv_id ORDER BY cost + icost, audit || iaudit) AS best
  FROM it JOIN s ON it.conv_id IS NOT DISTINCT FROM s.conv_id AND it.pos = s.n JOIN ins ON it.st = ins.a WHERE ins.b IN {ENDS}),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(z.cost, 0) AS cost, coalesce(z.audit, '') AS audit, sha256(coalesce(array_to_string(z.said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN s ON ids.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN g ON ids.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON ids.conv_id IS NOT DISTINCT FROM z.conv_id AND z.best = 1
"""


def manifest_oracle() -> str:
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    sides = """string_agg(CASE WHEN s.i < m.i THEN s.h ELSE '' END, '' ORDER BY s.i) || '|' || string_agg(CASE WHEN s.i > m.i THEN s.h ELSE '' END, '' ORDER BY s.i)"""
    rise = "sha256(string_agg(h, '' ORDER BY i))"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT doc_id, source, {leaf("text")} AS leaf, text, lang, n_chars, CASE WHEN doc_id IS NOT NULL AND {crc32_of("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents, crc),
d AS (SELECT row_number() OVER () AS r, doc_id, source, leaf, {leaf("tampered")} AS claim, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM k),
up AS (
  SELECT source, 0 AS level, i, leaf AS h, n FROM d
  UNION ALL SELECT source, level + 1, i // 3, {rise}, (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, level, i // 3, n),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, i, subroot AS h, n FROM sub
  UNION ALL SELECT level + 1, i // 3, {rise}, (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3, n),
low AS (
  SELECT d.r, m.level, {sides} AS x FROM d JOIN up m ON m.source IS NOT DISTINCT FROM d.source AND m.n > 1 AND m.i = d.i // CAST(pow(3, m.level) AS BIGINT)
  JOIN up s ON s.source IS NOT DISTINCT FROM m.source AND s.level = m.level AND s.i // 3 = m.i // 3 GROUP BY d.r, m.level),
high AS (
  SELECT sub.source, 1000 + m.level AS level, {sides} AS x FROM sub JOIN top m ON m.n > 1 AND m.i = sub.i // CAST(pow(3, m.level) AS BIGINT)
  JOIN top s ON s.level = m.level AND s.i // 3 = m.i // 3 GROUP BY sub.source, m.level),
p AS (SELECT r, list(x ORDER BY level) AS xs FROM (SELECT * FROM low UNION ALL SELECT d.r, high.level, high.x FROM d JOIN high ON high.source IS NOT DISTINCT FROM d.source) GROUP BY r),
f AS (
  SELECT d.*, sub.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(xs, []), ''), '|', '')) AS proof_sha256,
    list_reduce(coalesce(xs, []), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), claim) AS folded_root
  FROM d JOIN sub ON sub.source IS NOT DISTINCT FROM d.source LEFT JOIN p ON p.r = d.r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
