"""The SQL of the conversation repair for DuckDB: a recursive query over turns, its layer four {cost, audit, made} structs.

A state that can't be reached is null. DuckDB has no crc32, so the reflected polynomial is applied bit by bit.
"""

from __future__ import annotations

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda r, c:
    list_reduce(list_prepend(xor(r, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda q, z: xor(q >> 1, 3988292384 * (q & 1)))))"""
_SPACE = r"[\x20\x09-\x0D]+"
_NONE = "NULL::STRUCT(cost BIGINT, audit VARCHAR, made VARCHAR[])"


def _more(state: str, cost: str, letter: str, line: str | None) -> str:
    made = f"{state}.made" if line is None else f"list_append({state}.made, {line})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{cost: {state}.cost + {cost}, audit: {state}.audit || '{letter}', made: {made}}} END"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _closed(source: str) -> str:
    users = (_more(x, "5", "I", "'user:'") for x in ("b0", "b1", "b3"))
    return f"""SELECT i, conv_id, b0, b1, b2, {_least("b3", _more("b2", "5", "I", "'assistant:'"))} AS b3 FROM
        (SELECT i, conv_id, b0, b1, {_least("b2", *users)} AS b2, b3 FROM ({source}))"""


def _stay(state: str, initial: str, role: str) -> str:
    keep, other = _more(state, "extra", "K", "role || ':' || text"), _more(state, "extra + 1", "R", f"'{role}:' || text")
    return f"CASE WHEN NOT dead AND c = '{initial}' THEN {keep} WHEN NOT dead THEN {other} END"


def _system() -> str:
    keep = _more("b0", "extra", "K", "role || ':' || text")
    return f"CASE WHEN NOT dead AND c = 's' THEN {keep} END"


_FIRST = f"SELECT 0::BIGINT AS i, conv_id, {{cost: 0::BIGINT, audit: '', made: []::VARCHAR[]}} AS b0, {_NONE} AS b1, {_NONE} AS b2, {_NONE} AS b3 FROM c"
_NEXT = f"""SELECT r.i, l.conv_id, {_more("b0", "2", "D", None)} AS b0, {_least(_more("b1", "2", "D", None), _system())} AS b1,
    {_least(_more("b2", "2", "D", None), *(_stay(b, "u", "user") for b in ("b0", "b1", "b3")))} AS b2,
    {_least(_more("b3", "2", "D", None), _stay("b2", "a", "assistant"))} AS b3
    FROM l JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i + 1"""

REPAIR = f"""
    WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    f AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS fault FROM o),
    d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
          CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
    g AS (SELECT *, regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
          lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, left(role, 1) AS c FROM n),
    r AS (SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut, body = '' OR again AS dead,
          CASE WHEN body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM g),
    c AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
          count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
    l AS ({_closed(_FIRST)} UNION ALL {_closed(_NEXT)}),
    e AS (SELECT c.*, {_least("b0", "b3")} AS best FROM l JOIN c ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = c.last)
    SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.made, chr(10))) AS repaired_sha256 FROM e
    UNION ALL
    SELECT conv_id, 0, 0, 0, 0, 0, 0, '', sha256('') FROM (SELECT DISTINCT conv_id FROM conversations) a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id IS NOT DISTINCT FROM a.conv_id)"""
