"""DuckDB SQL for the named queries."""

from __future__ import annotations

from folioscan import schema as S

_LABELS = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in S.FILE_TYPES.items())
TICKS = "(epoch_us({}) + 62135596800000000) * 10"

CORPUS = f"""corpus AS (
  SELECT doc_id, concat(folder_path, '/', file_name) AS file_path, file_name, folder_path, content, file_size, last_modified, {TICKS.format('last_modified')} AS last_modified_ticks,
    CASE ext {_LABELS} ELSE '{S.OTHER_TYPE}' END AS file_type
  FROM (SELECT doc_id, ext, concat('doc_', doc_id, ext) AS file_name, concat('/corpus/', source, '/', lang) AS folder_path, text AS content, strlen(text)::BIGINT AS file_size,
      TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS last_modified
    FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 3 = 1 THEN '.md' ELSE '.csv' END AS ext FROM documents)))"""
PAGES = """pages_corpus AS (SELECT concat('/pages/page_', page_id, '.html') AS file_path, html AS content FROM pages)"""
CHAT = """chat AS (SELECT concat('/chat/', conv_id, '/', turn, '.log') AS file_path, concat(turn, '.log') AS file_name, concat('/chat/', conv_id) AS folder_path,
  strlen(text)::BIGINT AS file_size, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 SECOND AS last_modified FROM conversations)"""

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"
TOKENS = "regexp_extract_all(lower(left(coalesce({}, ''), 500000)), '" + TOKEN.replace("{", "{{").replace("}", "}}") + "')"
_RESULT = "file_path, file_name, folder_path, file_size, last_modified_ticks, file_type"


def hits(words: list[str], where: str = "true", corpus: str = "corpus", content: list[str] | None = None, names: list[str] | None = None) -> str:
    """Scored hits (as CTE ``hits``) of words that are matched by substring, or by the
    given conditions on content and file name."""
    cs = content or [f"contains(lower(content), '{w}')" for w in words]
    fs = names or [f"contains(lower(file_name), '{w}')" for w in words]
    n = range(len(cs))
    flags = ", ".join(f"({cs[k]})::INT AS c{k}, ({fs[k]})::INT AS f{k}" for k in n)
    exists = ", ".join(f"max(c{k}) AS ec{k}, max(f{k}) AS ef{k}" for k in n)
    norm = " + ".join(f"ec{k} + 6.25 * ef{k}" for k in n)
    score = " + ".join(f"(c{k} + f{k}) / 2.0::DOUBLE * (c{k} + 2.5::DOUBLE * f{k})" for k in n)
    every = " AND ".join(f"c{k} + f{k} > 0" for k in n)
    return f"""flagged AS (SELECT *, {flags} FROM {corpus}), stats AS (SELECT {exists} FROM flagged),
hits AS (SELECT flagged.*, ({score}) / sqrt(({norm})::DOUBLE) AS score FROM flagged, stats WHERE {every} AND ({where}))"""


def ranked(words: list[str], limit: int = 20, **options) -> str:
    """The best hits of words."""
    return f"WITH {CORPUS}, {hits(words, **options)} SELECT {_RESULT}, round(score, 6) AS score FROM hits ORDER BY score DESC, file_path LIMIT {limit}"


def total(words: list[str], **options) -> str:
    """The number of hits of words."""
    return f"WITH {CORPUS}, {hits(words, **options)} SELECT count(*) AS total_hits FROM hits"


def encode(text: str) -> str:
    """HTML entities in a text expression."""
    named = f"replace(replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
    return f"list_aggregate(list_transform(string_split({named}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 160 AND 255 OR unicode(c) > 65535 THEN concat('&#', unicode(c), ';') ELSE c END), 'string_agg', '')"


def preview(patterns: list[tuple[str, str]], limit: int = 50000) -> str:
    """Preview lines (as CTE ``lines``): patterns for raw lines and for encoded ones."""
    cut = f"CASE WHEN len(content) > {limit} THEN concat(left(content, {limit}), chr(10), '... (省略)') ELSE content END"
    shown = "CASE WHEN raw = '' THEN '' ELSE " + encode("raw") + " END"
    for raw, encoded in patterns:
        shown = f"CASE WHEN regexp_matches(raw, '(?i){raw}') THEN regexp_replace({shown}, '{encoded}', '<mark>\\0</mark>', 'gi') ELSE {shown} END"
    found = " OR ".join(f"regexp_matches(raw, '(?i){raw}')" for raw, _ in patterns) or "false"
    return f"""{CORPUS}, raws AS (SELECT file_path, unnest(string_split({cut}, chr(10))) AS raw, generate_subscripts(string_split({cut}, chr(10)), 1)::BIGINT AS line_no FROM corpus),
lines AS (SELECT file_path, line_no, {shown} AS content, {found} AS has_match FROM (SELECT file_path, line_no, rtrim(raw, chr(13)) AS raw FROM raws))"""


PLACED = """placed AS (SELECT *, list_filter(string_split(substr(folder_path, len(target) + 1), '/'), lambda x: x <> '') AS parts
  FROM (SELECT *, {target} AS target FROM {corpus}) WHERE target IS NOT NULL)"""
TREE = """above AS (SELECT target, parts, n FROM (SELECT target, parts, unnest(range(0, len(parts) + 1)) AS n FROM placed)),
folders AS (SELECT target, concat_ws('/', target, CASE WHEN n > 0 THEN array_to_string(parts[1:n], '/') END) AS full_path,
    CASE WHEN n > 0 THEN concat_ws('/', target, CASE WHEN n > 1 THEN array_to_string(parts[1:n - 1], '/') END) END AS parent_path,
    CASE WHEN n = 0 THEN regexp_extract(target, '([^/]*)$', 1) ELSE parts[n] END AS name, true AS is_folder, n::BIGINT AS depth, NULL::VARCHAR AS file_path, 0::BIGINT AS file_size, NULL::TIMESTAMP AS last_modified, count(*) AS file_count
  FROM above GROUP BY ALL),
tree AS (SELECT * FROM folders UNION ALL
  SELECT target, file_path, concat_ws('/', target, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '/') END), file_name, false, (len(parts) + 1)::BIGINT, file_path, file_size, last_modified, 0 FROM placed)"""


def tree(targets: list[str], corpus: str = "corpus") -> str:
    """CTEs up to ``tree`` for the given targets."""
    target = "CASE " + " ".join(f"WHEN starts_with(lower(folder_path), '{t.lower()}') THEN '{t}'" for t in targets) + " END"
    return f"{CORPUS if corpus == 'corpus' else CHAT}, {PLACED.format(target=target, corpus=corpus)}, {TREE}"
