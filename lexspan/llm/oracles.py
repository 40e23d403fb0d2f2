"""SQL of the queries that SQL can express, for an engine that has lambdas and recursive queries but no CRC-32."""

from __future__ import annotations

#: One row with the 256 remainders of CRC-32, from its polynomial.
CRC = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def crc32(octets: str) -> str:
    """The unsigned checksum of a list of bytes; the table is in scope as t."""
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def octets(text: str) -> str:
    """UTF-8 of a string of characters below U+0100."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END))"


WITHOUT = "substring({0}, 1, {1}) || substring({0}, {1} + 2)"

SPELLING = f"""WITH RECURSIVE {CRC},
runs AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS word FROM documents) GROUP BY ALL),
summed AS (SELECT word, k, {crc32(octets("coalesce(doc_id::VARCHAR, '') || ':' || word"))} AS h FROM runs, crc),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN {WITHOUT.format("word", "(h % length(word))::BIGINT")} ELSE word END AS word, k FROM summed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, i, {WITHOUT.format("word", "i")} AS key FROM (SELECT word, unnest(range(length(word)))::BIGINT AS i FROM w)),
near AS (SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.key = y.key AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word FROM cut x JOIN w y ON x.key = y.word
  UNION SELECT y.word, x.word FROM cut x JOIN w y ON x.key = y.word),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(loss := -o.n, other := o.word)) AS top FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.loss >= 2 * w.n THEN top.other END AS form,
  CASE WHEN -top.loss >= 2 * w.n THEN -top.loss END AS form_n FROM w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS reached FROM forms UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.reached WHERE forms.form IS NOT NULL),
ends AS (SELECT ways.word, reached AS root FROM ways JOIN forms ON forms.word = ways.reached WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)"""

SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def step(state: int) -> str:
    """The least of what may be done to a row in a grammar state: cost, labels, lines."""
    to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    arc = lambda cost, label, nxt, line: f"struct_pack(c := {cost} + c{nxt}.c, a := '{label}' || c{nxt}.a, l := list_concat({line}, c{nxt}.l))"
    found = [arc(3, "D", state, "[]::VARCHAR[]")]
    for initial, nxt in to.items():
        found.append(f"CASE WHEN keepable AND initial = '{initial}' THEN {arc('more', 'K', nxt, '''[role || ':' || text]''')} END")
    initial, nxt = next((i, t) for i, t in to.items() if i != "s")
    name = {"u": "user", "a": "assistant"}[initial]
    reroled = f"['{name}:' || text]"
    found.append(f"CASE WHEN keepable THEN {arc('2 + more', 'R', nxt, reroled)} END")
    return f"list_min(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))"


def inserted(name: str, role: str) -> str:
    """A row of ``role`` before what the best way ``name`` does."""
    return f"struct_pack(c := 2 + {name}.c, a := 'I' || {name}.a, l := list_concat(['{role}:'], {name}.l))"


def closed() -> str:
    """The best ways b0 to b3 with rows inserted first; between two states at most one insertion can help."""
    return f"""least(b0, {inserted("d2", "user")}) AS c0, least(b1, {inserted("d2", "user")}) AS c1, d2 AS c2, least(b3, {inserted("b2", "user")}) AS c3"""


NEVER = "struct_pack(c := 1000000000::BIGINT, a := '', l := []::VARCHAR[])"
DONE = "struct_pack(c := 0::BIGINT, a := '', l := []::VARCHAR[])"

CONVERSATIONS = f"""WITH RECURSIVE {CRC},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32(octets("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
read AS (SELECT *, substring(role, 1, 1) AS initial, rtrim(text, {SPACE}) AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
  lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
fault AS (SELECT *, CASE WHEN said = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM read),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size FROM fault GROUP BY conv_id),
rows_ AS (SELECT conv_id, i, role, text, initial, f IN ('', 't') AS keepable, CASE WHEN f = 't' THEN 1 ELSE 0 END AS more FROM fault),
ways AS (SELECT conv_id, size AS i, {closed()} FROM (SELECT *, least(b2, {inserted("b3", "assistant")}) AS d2 FROM (SELECT conv_id, size, {DONE} AS b0, {NEVER} AS b1, {NEVER} AS b2, {DONE} AS b3 FROM facts))
  UNION ALL SELECT conv_id, i, {closed()} FROM (SELECT *, least(b2, {inserted("b3", "assistant")}) AS d2 FROM (
    SELECT w.conv_id, w.i - 1 AS i, {", ".join(f"{step(q)} AS b{q}" for q in range(4))} FROM ways w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE w.i > 0)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(c0.c, 0)::BIGINT AS cost, coalesce(c0.a, '') AS audit, sha256(coalesce(array_to_string(c0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM ways WHERE i = 0) w ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""
