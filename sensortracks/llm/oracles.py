"""DuckDB statements for the training-data queries that SQL can express, put together from parts."""

from __future__ import annotations

# crc32 of a list of bytes: a table of the 256 steps, then one look-up a byte (fixed value: the reversed polynomial)
CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY v) AS tab FROM (
    SELECT v, list_reduce(list_prepend(v::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1)
      ELSE c >> 1 END) AS c FROM range(256) AS r(v)))"""


def crc(byte_list: str) -> str:
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte_list}), "
            "lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))")


UTF8 = """flatten(list_transform(string_split({x}, ''), lambda s: CASE
    WHEN unicode(s) < 128 THEN [unicode(s)]
    WHEN unicode(s) < 2048 THEN [192 + (unicode(s) >> 6), 128 + (unicode(s) & 63)]
    WHEN unicode(s) < 65536 THEN [224 + (unicode(s) >> 12), 128 + ((unicode(s) >> 6) & 63), 128 + (unicode(s) & 63)]
    ELSE [240 + (unicode(s) >> 18), 128 + ((unicode(s) >> 12) & 63), 128 + ((unicode(s) >> 6) & 63),
          128 + (unicode(s) & 63)] END))"""


def _edit(state: str, cost, letter: str, line: str | None = None) -> str:
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} END"


def op11() -> str:
    """The plain dynamic program, one row a step: the best edits that leave each of the four states."""
    insert = (f"least(s2, {_edit('s0', 2, 'I', chr(39) + 'user:' + chr(39))}, {_edit('s1', 2, 'I', chr(39) + 'user:' + chr(39))}, "
              f"{_edit('s3', 2, 'I', chr(39) + 'user:' + chr(39))})")
    keep = "r.role || ':' || r.text"
    gone = "(r.blank OR r.dup)"
    cut = "r.cut::INT"

    def when(cond: str, value: str) -> str:
        return f"CASE WHEN {cond} THEN {value} END"

    stay = f"NOT {gone}"
    return f"""
WITH RECURSIVE {CRC_TABLE},
dam AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s))")} % 20 AS kind
  FROM conversations, tab),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM dam WHERE kind <> 0),
n AS (
  SELECT coalesce('v' || conv_id::VARCHAR, 'null') AS conv, turn, role, text, substr(role, 1, 1) AS ini,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open FROM rows_),
r AS (SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND open AS cut,
             lag(ini) OVER (PARTITION BY conv ORDER BY rn) AS before FROM n),
w AS (
  SELECT conv, 0::BIGINT AS rn, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0,
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s2,
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s3 FROM (SELECT DISTINCT conv FROM r)
  UNION ALL
  SELECT conv, rn, d0, least(d1, k1), least(d2, k2, r2), least(d3, k3, r3) FROM (
    SELECT x.conv, r.rn, {_edit('i0', 3, 'D')} AS d0, {_edit('i1', 3, 'D')} AS d1, {_edit('i2', 3, 'D')} AS d2,
           {_edit('i3', 3, 'D')} AS d3,
           {when(stay + " AND ini = 's'", _edit('i0', cut, 'K', keep))} AS k1,
           {when(stay + " AND ini = 'u'", _edit('ib', cut, 'K', keep))} AS k2,
           {when(stay + " AND ini = 'a'", _edit('i2', cut, 'K', keep))} AS k3,
           {when(stay, _edit('ib', '2 + ' + cut, 'R', "'user:' || r.text"))} AS r2,
           {when(stay, _edit('i2', '2 + ' + cut, 'R', "'assistant:' || r.text"))} AS r3
    FROM (SELECT *, least(i0, i1, i3) AS ib FROM (
            SELECT conv, rn, s0 AS i0, s1 AS i1, i2, least(s3, {_edit('i2', 2, 'I', "'assistant:'")}) AS i3
            FROM (SELECT *, {insert} AS i2 FROM w))) x
    JOIN r ON r.conv = x.conv AND r.rn = x.rn + 1)),
ends AS (
  SELECT conv, least(s0, s3, {_edit('i2', 2, 'I', "'assistant:'")}) AS best FROM (SELECT *, {insert} AS i2 FROM w)
  QUALIFY row_number() OVER (PARTITION BY conv ORDER BY rn DESC) = 1),
c AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INT)::BIGINT AS blank,
         sum(dup::INT)::BIGINT AS duplicate, sum(cut::INT)::BIGINT AS truncated,
         sum((rn > 1 AND before || ini NOT IN ('su', 'ua', 'au'))::INT)::BIGINT AS illegal FROM r GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('v' || conv_id::VARCHAR, 'null') AS conv FROM conversations) o
LEFT JOIN c USING (conv) LEFT JOIN ends USING (conv)
"""


def op12() -> str:
    words = "regexp_extract_all({t}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH {CRC_TABLE},
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, 0 AS side, {words.format(t=lower)} AS w FROM documents
  UNION ALL SELECT row_number() OVER (), item_id, 1, {words.format(t=lower)} FROM benchmark),
grams AS (
  SELECT rid, side, array_to_string(w[i:i + k - 1], ' ') AS f
  FROM (SELECT rid, side, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, (VALUES (1), (2), (3)) AS o(k))),
seen AS (SELECT rid, side, f, count(*) AS n FROM grams GROUP BY ALL),
hashed AS (SELECT f, {crc(UTF8.format(x="f"))} % 10000 AS bucket FROM (SELECT DISTINCT f FROM seen), tab),
per AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t
        FROM seen JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM per) + 10000)::DOUBLE
         / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM per) + 10000)::DOUBLE)))::BIGINT AS g FROM per),
weights AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight
            FROM seen JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY rid),
noisy AS (
  SELECT rid, doc_id, len(w) >= 20 AS able,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
         / 4294967296::DOUBLE)))::BIGINT AS noise FROM texts WHERE side = 0),
scored AS (
  SELECT doc_id, able, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + noise)::BIGINT AS score FROM noisy LEFT JOIN weights USING (rid)),
placed AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN able AND place <= (SELECT 5 * count(*) // 100 FROM scored WHERE able) THEN place END AS rank FROM placed
"""
