"""SQL of the queries whose whole result SQL can express."""

from __future__ import annotations

from prefmine.llm import chat, lines

_MARKED = " OR ".join(f"contains(lower(line), '{phrase}')" for phrase in lines.BOILERPLATE)

LINE_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
f AS (SELECT doc_id, line, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '^(.*[^.!?])?[.!?]["'')\]]?$'))) AS ends,
        len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS noisy, len(regexp_extract_all(line, '[|>]')) AS seps, {_MARKED} AS marked FROM lw),
judged AS (SELECT doc_id, count(*) AS failed, sum(n) AS lost FROM f
           WHERE n > 0 AND (marked OR (seps > 1 AND seps * 8 > n) OR ends = 0 OR n > 120 * ends OR 5 * noisy > n) GROUP BY doc_id),
again AS (SELECT doc_id, sum(k - 1) AS n FROM (SELECT doc_id, line, count(*) AS k FROM f WHERE n > 0 GROUP BY 1, 2) GROUP BY doc_id),
runs AS (SELECT doc_id, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS r FROM w),
r AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM runs),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS k FROM r) WHERE k > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + s AS i FROM twice, range(3) t(s)) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        coalesce(again.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(failed, 0) AS n_lines_removed, coalesce(lost, 0) AS n_words_removed
      FROM w LEFT JOIN again USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN judged USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(n_words_removed AS BIGINT) AS n_words_removed,
       base_failed, NOT base_failed AND 10 * n_words_removed <= 3 * n_words AS kept FROM b
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)
      UNION ALL SELECT x.doc_id, y.doc_id FROM n x JOIN n y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b),
k AS (SELECT a AS doc_id, count(*) AS k FROM l GROUP BY 1)
SELECT n.doc_id, min(root) AS class_id, coalesce(max(k), 0) AS n_links FROM n JOIN r USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY 1
"""

_ESCAPED = r"len(regexp_extract_all({0}, '<\x{{200b}}*\|'))"
_FRAME = len(chat.START) + len(chat.END) + 2

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{chat.END}{chat.START}assistant ok'), (-1, 1, 'assistant', '{chat.END}{chat.START}assistant ok'))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, CAST(ceil(length(text) / 4.0) AS BIGINT) + 3 AS tokens FROM t),
p AS (SELECT *, max(role <> 'system') OVER (PARTITION BY conv_id ORDER BY place) = FALSE AS opening FROM o),
q AS (SELECT *, sum(CASE WHEN opening THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place) AS ends,
        {_FRAME} + length(role) + length(text) + {_ESCAPED.format('role')} + {_ESCAPED.format('text')} AS chars FROM p),
v AS (SELECT *, CASE WHEN NOT opening THEN CAST(ends - 1 AS BIGINT) // {chat.STRIDE} END AS win FROM q),
own AS (SELECT conv_id, win, max(ends) AS stop FROM v WHERE NOT opening GROUP BY 1, 2),
nexts AS (SELECT *, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS following FROM own),
placed AS (
  SELECT conv_id, win, tokens, chars FROM v WHERE NOT opening
  UNION ALL SELECT v.conv_id, following, tokens, chars FROM v JOIN nexts USING (conv_id, win) WHERE following IS NOT NULL AND stop - ends + tokens <= {chat.HISTORY}
  UNION ALL SELECT v.conv_id, coalesce(own.win, 0), tokens, chars FROM v LEFT JOIN own ON own.conv_id = v.conv_id WHERE opening),
g AS (SELECT conv_id, win, sum(tokens) AS tokens, sum(chars) AS chars FROM placed GROUP BY 1, 2),
z AS (SELECT conv_id, sum(chars) AS formatted_chars, count(*) AS n_windows, max(tokens) AS largest_window FROM g GROUP BY 1),
h AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss FROM o GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, n_windows,
       CAST(largest_window AS BIGINT) AS largest_window FROM h JOIN z USING (conv_id)
"""

_CRC = (
    "xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(k, '')]), "
    "lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_STATES = ("z", "s", "u", "a")  # nothing left yet, or the last role left


def _edit(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _where(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE {{'c': 1000000000, 'a': ''}} END"


#: cheapest edits row by row: the least (cost, audit) that leaves each last role
REPAIR = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
m AS (SELECT *, {_CRC} % 20 AS m FROM c),
d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
        CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS again FROM m WHERE m <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substring(role, 1, 1) AS l,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(l) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (SELECT *, CASE WHEN said = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN said[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM e),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
        count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) AS n,
        count(*) FILTER (WHERE before IS NOT NULL AND before || l NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
p AS (SELECT conv_id, n, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS z, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}} AS s,
        {{'c': CAST(2 AS BIGINT), 'a': 'I'}} AS u, {{'c': CAST(4 AS BIGINT), 'a': 'II'}} AS a FROM n
      UNION ALL
      SELECT conv_id, n, i, z, s, u, {_least('a', _edit('u', '2', 'I'))} AS a FROM (
        SELECT conv_id, n, i, z, s, {_least('u', *[_edit(x, '2', 'I') for x in 'zsa'])} AS u, a FROM (
          SELECT conv_id, n, i, {_edit('z', '3', 'D')} AS z,
            {_least(_edit('s', '3', 'D'), _where("kept AND l = 's'", _edit('z', 'more', 'K')))} AS s,
            {_least(_edit('u', '3', 'D'), _where("kept AND l = 'u'", _edit('x', 'more', 'K')), _where('kept', _edit('x', 'more + 2', 'R')))} AS u,
            {_least(_edit('a', '3', 'D'), _where("kept AND l = 'a'", _edit('u', 'more', 'K')), _where('kept', _edit('u', 'more + 2', 'R')))} AS a
          FROM (SELECT p.*  EXCLUDE (i), f.i, f.l, fault NOT IN ('b', 'd') AS kept, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS more, {_least('z', 's', 'a')} AS x
                FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)))),
best AS (SELECT conv_id, {_least('z', 'a')} AS best FROM p WHERE i = n),
w AS (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS place FROM best),
x AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER v AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER v AS nth FROM w WINDOW v AS (PARTITION BY conv_id ORDER BY place)),
y AS (SELECT x.*, f.role, f.text, max(CASE WHEN x.nth = 1 AND edit = 'K' AND l = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS opened
      FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i AND edit <> 'I'),
r AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
        chr(10) ORDER BY place) AS t FROM y WHERE edit <> 'D' GROUP BY conv_id),
g AS (SELECT DISTINCT conv_id FROM conversations)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.best.c, 0) AS cost, coalesce(best.best.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM g LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id
"""

_SHARE = "1 + CAST(1000000000 * CAST({0} + 2 AS HUGEINT) // ({1} + 2 * v) AS BIGINT)"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
c AS (SELECT lang, source, w, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY 1, 2, 3),
k AS (SELECT lang, w, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2 HAVING sum(docs) >= 10),
l AS (SELECT lang, count(w) AS v, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT s.lang, s.source, k.w, k.n AS all_n, l.v, l.total AS all_total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total
      FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.w = k.w),
p AS (SELECT lang, source, w, n, {_SHARE.format("n", "total")} AS p, {_SHARE.format("all_n", "all_total")} AS q FROM x),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
      UNION ALL SELECT lang, source, 'term', w, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
