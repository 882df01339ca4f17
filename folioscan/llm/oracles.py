"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from folioscan.llm.quality import SENTENCE_END, SEPARATORS, STOCK, SYMBOLS

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"

_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
once AS (SELECT doc_id, l, count(*) AS n FROM lines GROUP BY doc_id, l),
judged AS (
  SELECT doc_id, l, n,
    regexp_matches(l, '{SENTENCE_END.replace("'", "''")}')
    AND len(regexp_replace(l, '{SYMBOLS.replace('[', '[^')}', '', 'g')) <= 0.05 * len(l)
    AND NOT (NOT regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, '(\p{{Lu}}[^\p{{Ll}}]*){{3}}'))
    AND NOT (len(l) <= 200 AND regexp_matches(lower(l), '{STOCK}'))
    AND NOT (len(regexp_replace(l, '{SEPARATORS.replace('[', '[^')}', '', 'g')) >= 3 AND len(l) <= 30 * (1 + len(regexp_replace(l, '{SEPARATORS.replace('[', '[^')}', '', 'g')))) AS good
  FROM once),
per_doc AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines, sum(n * len(l))::BIGINT AS chars, sum(CASE WHEN good THEN len(l) ELSE 0 END)::BIGINT AS good
  FROM judged GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '{_SPACE}+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_replace(t, '{SYMBOLS.replace('[', '[^')}', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(good, 0) AS good
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN per_doc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (chars - good) <= 50 * chars AS kept
FROM base
"""

_NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, w AS g FROM d WHERE len(w) BETWEEN 1 AND 2)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
two_way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, two_way.b FROM reach JOIN two_way ON reach.b = two_way.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN size USING (doc_id) JOIN comp USING (doc_id)
"""

_WINNOWING = r"""
WITH split AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM split),
item AS (SELECT id::VARCHAR AS item, w, least(len(w), 10) AS m FROM w WHERE side = 'i' AND len(w) > 0),
win AS (SELECT DISTINCT item, m, w[i + 1:i + m] AS g FROM (SELECT item, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM item)),
place AS (
  SELECT id, i, m, w[i + 1:i + m] AS g
  FROM (SELECT id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM (SELECT * FROM w, (SELECT DISTINCT m FROM item) WHERE side = 'd' AND len(w) >= m))),
hit AS (SELECT place.id, place.i, win.m, win.item FROM place JOIN win ON place.g = win.g),
covered AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT id, i, m FROM hit)) GROUP BY id),
listed AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(listed.n, 0)::BIGINT AS n_items,
  sha256(coalesce(listed.items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered ON covered.id = w.id LEFT JOIN listed ON listed.id = w.id WHERE side = 'd'
"""

#: Table of the CRC-32, made by its rule, as the first part of a WITH.
_CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8, given table crc."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


_SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
once AS (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 5 GROUP BY doc_id, r),
hashed AS (SELECT r, n, {_crc32("(doc_id || ':' || r)")} AS h FROM once, crc),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, length(word) AS size, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
pair AS (
  SELECT less.word AS a, less.n AS na, words.word AS b, words.n AS nb FROM less JOIN words ON less.rest = words.word
  UNION SELECT words.word, words.n, less.word, less.n FROM less JOIN words ON less.rest = words.word
  UNION SELECT x.word, x.n, y.word, y.n FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.size = y.size AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, max(nb) AS top FROM pair GROUP BY a),
form AS (SELECT pair.a, min(b) AS form, min(nb) AS form_n FROM pair JOIN best ON best.a = pair.a AND nb = top WHERE nb >= 2 * na GROUP BY pair.a),
way AS (SELECT word, word AS up FROM words UNION ALL SELECT way.word, form.form FROM way JOIN form ON form.a = way.up),
root AS (SELECT word, up AS root FROM way WHERE up NOT IN (SELECT a FROM form))
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words LEFT JOIN best ON best.a = word LEFT JOIN form ON form.a = word JOIN root USING (word)
"""

_TRIE = rf"""
WITH {_CRC_TABLE},
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (SELECT conv_id, ts, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM own, crc),
built AS (
  SELECT taken.conv_id, list_concat(coalesce(own.ts[1:h], []), taken.ts[h + 1:]) AS ts
  FROM taken LEFT JOIN own ON own.conv_id = taken.conv_id - taken.conv_id % 100),
member AS (SELECT conv_id, d, len(ts) AS size, ts[1:d] AS p, ts FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM built)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, length(any_value(ts[d].t)) AS chars,
    coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends
  FROM member GROUP BY p, d),
kids AS (SELECT up.p, count(*) AS n FROM node JOIN node up ON node.d = up.d + 1 AND node.p[1:up.d] = up.p GROUP BY up.p),
below AS (
  SELECT up.p, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((node.n_convs - 1) * coalesce(node.chars, 0)) AS saved
  FROM node LEFT JOIN kids k ON k.p = node.p JOIN (SELECT p, unnest(range(0, d + 1)) AS l FROM node) x ON x.p = node.p JOIN node up ON up.d = x.l AND up.p = node.p[1:x.l]
  GROUP BY up.p)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node LEFT JOIN node up ON node.d = up.d + 1 AND up.p = node.p[1:node.d - 1] LEFT JOIN kids ON kids.p = node.p JOIN below ON below.p = node.p
"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op9_near_dedup": _NEAR,
    "op10_quality_rules": _QUALITY,
    "op11_winnowing": _WINNOWING,
    "op12_spelling_variants": _SPELLING,
    "op13_prefix_trie": _TRIE,
}
