"""DuckDB SQL for the queries that SQL can express."""

WHITE = r"[\x20\x09-\x0D]"

ORACLE: dict[str, str] = {}

ORACLE["op4_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
uniq AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
items AS (SELECT id, n, unnest(s) AS x FROM uniq),
pairs AS (
  SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM uniq UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id, s.doc_id = coalesce(comp.c, s.doc_id) AS kept
FROM sets s LEFT JOIN uniq u ON list_sort(s.s) = u.s LEFT JOIN comp ON comp.id = u.id
"""

ORACLE["op7_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

ORACLE["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS k, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, (k - 1) % 3 + 1 AS weight, 3 * total AS cap, sum(total) OVER () AS every FROM s),
f AS (
  SELECT *, (every - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
g AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS fill FROM f),
q AS (
  SELECT d.doc_id, d.size, g.k, g.weight, g.total, round(least(g.cap::DOUBLE, coalesce(g.fill, 0) * g.weight), 6) AS target,
    sum(d.size) OVER (PARTITION BY g.k ORDER BY d.h, d.doc_id, d.size) AS upto, g.every
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT q.*, e, (e * total + upto) * (6 // weight) AS v FROM q, range(3) r(e)),
r AS (SELECT *, sum(size) OVER (ORDER BY v, k, e, upto) AS run FROM c WHERE size > 0),
t AS (SELECT doc_id, sum(size) AS taken FROM r WHERE run <= every GROUP BY doc_id)
SELECT q.doc_id, q.size, q.total AS source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken FROM q LEFT JOIN t USING (doc_id)
"""

ORACLE["op9_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, upper(sha1(coalesce(html, ''))) AS h FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, (1 + 10 * (i // 8))::INTEGER, 10))::UBIGINT >> (35 - 5 * (i % 8))::UBIGINT) & 31)::INTEGER), 1)), '') AS digest,
    min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

#: The table of crc32 and, of a text whose letters are below U+0100, its bytes and their crc32.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""
BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))"
CRC = f"xor(list_reduce([4294967295] || {BYTES}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

ORACLE["op11_spelling"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  GROUP BY 1, 2),
hashed AS (SELECT run, k, {CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i::INTEGER) || substr(word, i::INTEGER + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word),
best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM near GROUP BY 1),
told AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN (-b[1])::BIGINT END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form FROM told UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.form)
SELECT told.word, told.form, chain.at AS root, n, n_near, form_n FROM told JOIN chain ON chain.word = told.word AND chain.form IS NULL
"""

STEP = "CASE {0} WHEN 2 THEN 3 ELSE 2 END"
#: Of four states (0 nothing yet, 1 after system, 2 after user, 3 after assistant) those with inserted turns before them.
_INSERT = lambda s, then: f"least({s}, {{'c': ({then}).c + 2, 'a': 'I' || ({then}).a, 'o': [{{role}}] || ({then}).o}})"


def _with_inserts(s: list[str]) -> list[str]:
    user = lambda own, then: _INSERT(own, then).replace("{role}", "'user:'")
    assistant = lambda own, then: _INSERT(own, then).replace("{role}", "'assistant:'")
    two = assistant(s[2], s[3])
    return [user(s[0], two), user(s[1], two), two, user(s[3], s[2])]


def _edit(cost: str, letter: str, then: str, line: str | None = None) -> str:
    return f"{{'c': ({then}).c + {cost}, 'a': '{letter}' || ({then}).a, 'o': {f'[{line}] || ' if line else ''}({then}).o}}"


def _row_states() -> list[str]:
    kept, out = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], []
    for state in range(4):
        new = 3 if state == 2 else 2
        tries = [_edit("3", "D", f"s{state}"), f"CASE WHEN fault NOT IN ('b', 'd') THEN {_edit('2 + (fault = $$t$$)::INT', 'R', f's{new}', ('$$assistant:$$' if new == 3 else '$$user:$$') + ' || text')} ELSE bad END"]
        for initial, to in kept[state].items():
            tries.append(f"CASE WHEN fault NOT IN ('b', 'd') AND role[1] = '{initial}' THEN {_edit('(fault = $$t$$)::INT', 'K', f's{to}', 'role || $$:$$ || text')} ELSE bad END")
        out.append(f"least({', '.join(tries)})")
    return out


_NONE, _BAD = "{'c': 0, 'a': '', 'o': []::VARCHAR[]}", "{'c': 1000000000, 'a': '', 'o': []::VARCHAR[]}"

ORACLE["op12_conversations"] = rf"""
WITH RECURSIVE {CRC_TABLE},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT given.*, {CRC.format("key")} % 20 AS h FROM given, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
ends AS (SELECT {_NONE} AS done, {_BAD} AS bad),
walk AS (
  SELECT conv_id, max(i) + 1 AS i, ANY_VALUE(w0) AS s0, ANY_VALUE(w1) AS s1, ANY_VALUE(w2) AS s2, ANY_VALUE(w3) AS s3
  FROM told, (SELECT {", ".join(f"{x} AS w{k}" for k, x in enumerate(_with_inserts(["done", "bad", "bad", "done"])))} FROM ends) GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {", ".join(f"{x} AS w{k}" for k, x in enumerate(_with_inserts(["b0", "b1", "b2", "b3"])))} FROM (
    SELECT told.conv_id, told.i, {", ".join(f"{x} AS b{k}" for k, x in enumerate(_row_states()))}
    FROM walk JOIN told ON told.conv_id IS NOT DISTINCT FROM walk.conv_id AND told.i = walk.i - 1, ends)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
found AS (SELECT c.*, s0.c::BIGINT AS cost, s0.a AS audit, array_to_string(s0.o, chr(10)) AS repaired FROM counted c JOIN walk ON walk.conv_id IS NOT DISTINCT FROM c.conv_id AND walk.i = 1)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM k.conv_id
"""
