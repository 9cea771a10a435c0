"""SQL for the operators whose whole result SQL can say; DuckDB runs it on the same tables."""

from __future__ import annotations

from quillmap.llm.licenses import scan_sql
from quillmap.llm.quality_rules import BOILERPLATE

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def windows_sql(window: int = 35) -> str:
    """Removal of words in repeated windows, by grouping every window's text."""
    return rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT id, unnest(range(1, len(w) - {window - 2})) AS i, w FROM t WHERE len(w) >= {window}),
hashed AS (SELECT id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM windows),
repeated AS (SELECT id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT id, unnest(range(i, i + {window})) AS p FROM repeated),
words AS (SELECT id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM t),
kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (id, p) GROUP BY id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (id)"""


def bytes_sql(length: int = 100) -> str:
    """Removal of byte strings that start earlier, by ranking every string of the tables' bytes."""
    return rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT id, doc_id, p, md5_number(s) AS s
  FROM (SELECT id, doc_id, unnest(range(1, n - {length - 2})) AS p, unnest(list_transform(range(1, n - {length - 2}), lambda q: substr(h, 2 * q - 1, {2 * length}))) AS s FROM t WHERE n >= {length}) x),
later AS (SELECT id, p FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
-- starts that follow within the length of a string cover one run of bytes
chained AS (SELECT id, p, CASE WHEN p - lag(p) OVER (PARTITION BY id ORDER BY p) <= {length} THEN 0 ELSE 1 END AS begins FROM later),
numbered AS (SELECT id, p, sum(begins) OVER (PARTITION BY id ORDER BY p) AS run FROM chained),
runs AS (SELECT id, run, min(p) AS a, max(p) + {length} AS b FROM numbered GROUP BY id, run),
summed AS (SELECT id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(
    list_transform(range(0, n_spans + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 1 ELSE ends[k] END) - 1, 2 * ((CASE WHEN k = n_spans THEN n + 1 ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 1 ELSE ends[k] END)))), '') END)) AS kept_sha256
FROM t LEFT JOIN summed USING (id)"""


def quality_sql(max_loss: float = 0.3, least_words: int = 50) -> str:
    """Measures and verdict of the line rules."""
    without = lambda p: f"length(regexp_replace(x, '{p}', '', 'g'))"
    failing = rf"""(20 * (length(x) - {without('[#*$%&|<>!»•]')}) > length(x) + 20
      OR (length(x) > 30 AND 2 * {without(r'\p{Lu}+')} < length(x))
      OR (length(x) <= 40 AND NOT regexp_matches(x, '[.!?…:;。？！]["''”’»)\]]*[\x20\x09-\x0D]*\z'))
      OR (length(x) <= 300 AND regexp_matches(lower(x), '{BOILERPLATE}')))"""
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n
  FROM (SELECT id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2) x) y),
repeated AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) x GROUP BY id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS chars,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x: {failing}), lambda x: length(x))), 0) AS lost
  FROM t LEFT JOIN repeated USING (id)),
f AS (SELECT *, n_words < {least_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {max_loss} * chars AS kept FROM f"""


ORACLES = {
    "op2_licenses": scan_sql(),
    "op4_substring_dedup": windows_sql(),
    "op8_quality_rules": quality_sql(),
    "op9_suffix_dedup": bytes_sql(),
}
