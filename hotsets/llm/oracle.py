"""DuckDB SQL of the registered queries that SQL can express.

The others rest on hashes, tokenizers, fitted models or a linear program; tests/llm hold them
against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from hotsets.llm.chat import CONTROL, MARK

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = r"""WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND text <> ''),
line AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM split),
clean AS (SELECT doc_id, line_no, trim(regexp_replace(lower(line), '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS norm FROM line),
full_line AS (
  SELECT doc_id, line_no, norm, len(string_split(norm, ' ')) AS n_words, len(string_split(norm, ' ')) >= 3 OR length(norm) >= 20 AS comparable
  FROM clean WHERE norm <> ''),
first_line AS (SELECT norm, any_value(n_words) AS n_words, min({'d': doc_id, 'l': line_no}) AS id FROM full_line WHERE comparable GROUP BY norm),
edited AS (
  SELECT id, n_words >= 5 AS by_word, CASE WHEN n_words >= 5 THEN string_split(norm, ' ') ELSE string_split(norm, '') END AS ws
  FROM first_line WHERE n_words >= 5 OR length(norm) >= 20),
variant AS (
  SELECT id, by_word, i AS pos, list_concat(ws[1:i - 1], ws[i + 1:]) AS k FROM (SELECT id, by_word, ws, unnest(range(1, len(ws) + 1)) AS i FROM edited) t
  UNION ALL SELECT id, by_word, 0, ws FROM edited),
replaced AS (SELECT by_word, k, pos, min(id) AS lowest FROM variant WHERE pos > 0 GROUP BY by_word, k, pos),
entire AS (SELECT by_word, k, min(id) AS lowest FROM variant WHERE pos = 0 GROUP BY by_word, k),
shortened AS (SELECT by_word, k, min(id) AS lowest FROM variant WHERE pos > 0 GROUP BY by_word, k),
near AS (
  SELECT v.id FROM variant v JOIN replaced r ON v.by_word = r.by_word AND v.k = r.k AND v.pos = r.pos WHERE r.lowest < v.id
  UNION SELECT v.id FROM variant v JOIN entire e ON v.by_word = e.by_word AND v.k = e.k WHERE v.pos > 0 AND e.lowest < v.id
  UNION SELECT v.id FROM variant v JOIN shortened s ON v.by_word = s.by_word AND v.k = s.k WHERE v.pos = 0 AND s.lowest < v.id),
pair AS (
  SELECT doc_id, line_no AS a_no, norm AS a, comparable AS a_long, lead(line_no) OVER w AS b_no, lead(norm) OVER w AS b, lead(comparable) OVER w AS b_long
  FROM full_line WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
first_pair AS (SELECT a, b, min({'d': doc_id, 'l': a_no}) AS id FROM pair WHERE b IS NOT NULL AND NOT (a_long AND b_long) GROUP BY a, b),
again AS (SELECT p.* FROM pair p JOIN first_pair f ON p.a = f.a AND p.b = f.b WHERE {'d': p.doc_id, 'l': p.a_no} <> f.id),
gone AS (
  SELECT w.doc_id, w.line_no FROM full_line w JOIN first_line f ON w.norm = f.norm WHERE {'d': w.doc_id, 'l': w.line_no} <> f.id
  UNION SELECT id.d, id.l FROM near
  UNION SELECT doc_id, a_no FROM again WHERE NOT a_long
  UNION SELECT doc_id, b_no FROM again WHERE NOT b_long),
per_doc AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(p.n, 0) AS BIGINT) AS n_dropped, coalesce(p.lines, '') AS dropped_lines
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id"""

OP6 = f"""WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM benchmark WHERE text IS NOT NULL),
run AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item WHERE len(ws) > 0) t),
doc AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
place AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM run) s WHERE len(ws) >= n) t),
found AS (SELECT p.doc_id, p.i, p.n, r.item_id FROM place p JOIN run r ON p.k = r.k AND p.n = r.n),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM found) t GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id"""


def _escaped_length(c: str) -> str:
    """Length of a text in which every backslash and control string has become one longer."""
    signs = "|".join("".join(f"[{x}]" if x in "[]|()<>/" and x not in "[]" else "\\" + x if x in "[]" else x for x in s) for s in CONTROL)
    return f"(length({c}) + len(regexp_extract_all({c}, '{signs}|\\\\')))"


OP10 = f"""WITH line AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({2 * len(MARK)} + {_escaped_length('role')} + {_escaped_length('text')}) + {len(MARK)} AS n
  FROM line GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM whole"""

_RUNS = r"'[^\x20\x09-\x0D]+'"
OP11 = f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
word AS (SELECT r, doc_id, source, t, regexp_extract_all(t, {_RUNS}) AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_RUNS})) AS ls FROM doc),
run AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM word WHERE len(ws) >= 5) t),
again AS (SELECT r, i FROM run QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
inside AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) t GROUP BY r),
stat AS (
  SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words FROM word LEFT JOIN inside USING (r)),
broken AS (
  SELECT *, n_words < 10 AS a, 100 * n_repeat_words > 20 * n_words AS b, 10 * n_symbols > word_chars AS c, 10 * n_dup_lines > 3 * n_lines AS d FROM stat),
host AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed)::DOUBLE AS f
  FROM (SELECT source, unnest(['a', 'b', 'c', 'd']) AS rule, unnest([a::INT, b::INT, c::INT, d::INT]) AS failed FROM broken WHERE source IS NOT NULL) t
  GROUP BY source, rule),
total AS (SELECT rule, sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(f * f / n) AS ff FROM host GROUP BY rule),
corr AS (
  SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND n - nn / n - (k - 1) > 0
                       THEN least(1, ((ff - n * m * m) / (m * (1 - m)) - (k - 1)) / (n - nn / n - (k - 1))) ELSE 0 END AS r FROM total),
rate AS (SELECT source, CASE WHEN r > 1e-9 THEN (f + m * (1 - r) / r) / (n + (1 - r) / r) ELSE m END AS p FROM host JOIN corr USING (rule)),
verdict AS (SELECT source, max(p) > 0.5 AS blocked FROM rate GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, a OR b AS base_failed, NOT (a OR b) AND NOT coalesce(blocked, false) AS kept, coalesce(blocked, false) AS host_blocked
FROM broken LEFT JOIN verdict USING (source)"""

#: CRC-32, a byte at a time: ``crc`` holds the table of the 256 bytes' remainders
_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS table_ FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i)) t)"""
_CRC = """xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
        lambda c, b: xor(c // 256, table_[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

OP12 = f"""WITH {_CRC_TABLE},
line AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations),
conv AS (SELECT conv_id, {_CRC.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations) t, crc),
turn AS (
  SELECT c.conv_id, 0 AS part, p, role, text FROM conv c JOIN line l ON l.conv_id = c.conv_id - c.conv_id % 100 WHERE p <= h
  UNION ALL SELECT conv_id, 1, p, role, text FROM line JOIN conv USING (conv_id) WHERE p > h),
whole AS (
  SELECT conv_id, coalesce(list(strlen(role) || ':' || role || text ORDER BY part, p) FILTER (WHERE p IS NOT NULL), []) AS k,
         coalesce(list(length(text) ORDER BY part, p) FILTER (WHERE p IS NOT NULL), []) AS n
  FROM conv LEFT JOIN turn USING (conv_id) GROUP BY conv_id),
member AS (SELECT conv_id, d, k[1:d] AS k, coalesce(n[d], 0) AS n, len(k) = d AS ends FROM (SELECT *, unnest(range(len(k) + 1)) AS d FROM whole) t),
node AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM member GROUP BY d, k),
child AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
linked AS (SELECT a.*, coalesce(c.n, 0) AS n_children FROM node a LEFT JOIN child c ON a.d = c.d AND a.k = c.k),
below AS (
  SELECT u AS d, k[1:u] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS u FROM linked) t GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM linked a JOIN below b ON a.d = b.d AND a.k = b.k LEFT JOIN node p ON p.d = a.d - 1 AND p.k = a.k[1:a.d - 1]"""


def _leaf(n_chars: str) -> str:
    """Text whose hash is a document's leaf."""
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


OP13 = f"""WITH RECURSIVE {_CRC_TABLE},
leaf AS (
  SELECT doc_id, lang, sha256({_leaf('n_chars')}) AS leaf,
         CASE WHEN {_CRC.format('doc_id')} % 7 = 0 THEN sha256({_leaf('(CAST(n_chars AS HUGEINT) + 1)')}) ELSE sha256({_leaf('n_chars')}) END AS changed
  FROM documents, crc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
up AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM ranked
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, pos // 2, n),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, h, n FROM sub
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
step AS (
  SELECT r.doc_id, r.leaf, u.level, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < u.pos THEN 'L' || s.h ELSE 'R' || s.h END AS p
  FROM ranked r JOIN up u ON r.lang IS NOT DISTINCT FROM u.lang AND u.pos = r.pos >> u.level AND u.n > 1
  LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, 1000 + u.level, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < u.pos THEN 'L' || s.h ELSE 'R' || s.h END
  FROM ranked r JOIN sub b ON r.lang IS NOT DISTINCT FROM b.lang JOIN high u ON u.pos = b.pos >> u.level AND u.n > 1
  LEFT JOIN high s ON s.level = u.level AND s.pos = xor(u.pos, 1)),
path AS (SELECT doc_id, leaf, list(p ORDER BY level) AS ps FROM step GROUP BY doc_id, leaf),
folded AS (
  SELECT r.doc_id, r.leaf, b.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
         sha256(coalesce(array_to_string(list_transform(ps, lambda p: p[2:]), ''), '')) AS proof_sha256,
         list_reduce(coalesce(ps, []), lambda acc, p: CASE p[1] WHEN 'L' THEN sha256(p[2:] || acc) WHEN 'R' THEN sha256(acc || p[2:]) ELSE sha256(acc) END, r.changed) AS folded_root
  FROM ranked r JOIN sub b ON r.lang IS NOT DISTINCT FROM b.lang LEFT JOIN path t ON r.doc_id = t.doc_id AND r.leaf = t.leaf)
SELECT *, folded_root = root AS verified FROM folded"""

SQL: dict[str, str] = {"op3_line_dedup": OP3, "op6_decontamination": OP6, "op10_chat": OP10, "op11_host_rules": OP11, "op12_prefix_trie": OP12,
                       "op13_merkle": OP13}
