"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""


def _edit(x: str, cost: str, letter: str, line: str | None = None, only: str = "true") -> str:
    """The state ``x`` (cost, audit, lines) after an edit; null if it can't be made."""
    lines = f"list_append({x}.o, {line})" if line else f"{x}.o"
    return f"CASE WHEN {x} IS NOT NULL AND {only} THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {lines}}} END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _repair_sql() -> str:
    """What is kept so far is a word of a regular language, so four states do: z nothing, s system, u user, d a pair."""
    user, assistant = "'user:' || text", "'assistant:' || text"
    inserted = [_edit(x, "3", "I", "'user:'") for x in "zsd"]
    more = "coalesce(CASE WHEN fault = 'truncated' THEN 3 END, 0)"
    held = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
    keep = lambda x, initial: _edit(x, more, "K", "role || ':' || text", f"{held} AND left(role, 1) = '{initial}'")
    rerole = lambda x, line: _edit(x, f"3 + {more}", "R", line, held)
    drop = lambda x: _edit(x, "4", "D")
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    closed = lambda frame: f"(SELECT *, {_least('u1', _edit('d', '3', 'I', chr(39) + 'user:' + chr(39)))} AS u2, {_least('d', _edit('u1', '3', 'I', chr(39) + 'assistant:' + chr(39)))} AS d2 FROM (SELECT *, {_least('u', *inserted)} AS u1 FROM {frame}))"
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hit AS (SELECT *, {crc} % 20 AS how FROM raw), damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hit WHERE how <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1, 's') AS tail FROM damaged
), judged AS (
  SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair, CASE WHEN tail = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM numbered
), run AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS z, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS s,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS d FROM conversations
  UNION ALL
  SELECT conv_id, p + 1, {drop("z")}, {_least(drop("s"), keep("z", "s"))},
    {_least(drop("u2"), *(f(x, *v) for x in ("z", "s", "d2") for f, v in ((keep, "u"), (rerole, (user,)))))}, {_least(drop("d2"), keep("u2", "a"), rerole("u2", assistant))}
  FROM (SELECT c.*, j.role, j.text, j.fault FROM {closed("run")} AS c JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.p = c.p + 1)
), ended AS (SELECT conv_id, {_least("z", "d2")} AS best FROM {closed("(SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1)")}), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM ended AS e LEFT JOIN counted AS c ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLES["op13_repair_structure"] = _repair_sql()

ORACLES["op12_phrase_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') AS ws FROM pieces), total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang), grams AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, greatest(len(ws) - m + 2, 1)), lambda i: array_to_string(ws[i : i + m - 1], ' '))))) AS phrase FROM w
), f AS (SELECT lang, phrase, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100), candidates AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE contains(phrase, ' ')
), cuts AS (
  SELECT c.*, unnest(range(1, len(ws))) AS k FROM candidates AS c
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.ws, k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') JOIN total AS t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM scored AS s WHERE NOT EXISTS (
    SELECT 1 FROM candidates AS c WHERE c.lang = s.lang AND len(c.ws) > len(s.ws) AND 100 * c.a >= 100 * s.a AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000"""
