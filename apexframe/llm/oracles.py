"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# A SHA-1 has 40 hexadecimal digits: eight groups of 20 bits, four letters each.
_PAYLOADS = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM payloads
)
"""

# The control strings of the chat template, and the characters each role's markers take.
_CONTROLS = r"<</NAME>>|<</ROLE>>|<</SYS>>|<<ROLE>>|\[/INST\]|<<SYS>>|\[INST\]|</s>|<s>"


def _escaped(text: str) -> str:
    """SQL for the length of an escaped text."""
    return (
        f"length({text}) + (length({text}) - length(replace({text}, chr(92), '')))"
        f" + (length({text}) - length(replace({text}, chr(0), ''))) + 2 * len(regexp_extract_all({text}, '{_CONTROLS}'))"
    )


_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# CRC-32 of a number's decimal digits, bit by bit, as DuckDB has no function for it.
_CRC32 = """
xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({c}::VARCHAR) + 1), lambda i: ascii(substr({c}::VARCHAR, i, 1))::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384) + 0 * y)))
"""

ORACLES: dict[str, str] = {
    "op11_setsketch_near_duplicates": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded
), listed AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM listed a JOIN listed b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM shingled LEFT JOIN least ON doc_id = a
""",
    "op13_conversation_prefix_trie": f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT DISTINCT c, {_CRC32.format(c="c")} % 4 AS h FROM own
), turns AS (
  SELECT h.c, pos, 0 AS late, role, text FROM heads h JOIN own ON own.c = h.c - h.c % 20 AND pos <= h
  UNION ALL SELECT own.c, pos, 1, role, text FROM own JOIN heads h ON own.c = h.c AND pos > h
), placed AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY late, pos) AS d FROM turns
), prefixes AS (
  SELECT c, d, text, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d)
    OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node FROM placed
  UNION ALL SELECT c, 0, '', 'root' FROM heads
), lengths AS (
  SELECT c, max(d) AS n FROM prefixes GROUP BY c
), nodes AS (
  SELECT node, min(p.c) AS conv, any_value(p.d) AS depth, count(*) AS n_convs, any_value(text) AS text,
    string_agg(CASE WHEN d = n THEN p.c::VARCHAR END, ',' ORDER BY p.c) AS ends
  FROM prefixes p JOIN lengths USING (c) GROUP BY node
), tied AS (
  SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN prefixes p ON p.c = n.conv AND p.d = n.depth - 1
), counted AS (
  SELECT t.*, coalesce(k, 0) AS n_children,
    (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(text, '{_WORD}')) END AS own
  FROM tied t LEFT JOIN (SELECT parent AS up, count(*) AS k FROM tied GROUP BY parent) ON up = node
), summed AS (
  SELECT p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
  FROM counted n JOIN prefixes p ON p.c = n.conv AND p.d <= n.depth GROUP BY p.node
)
SELECT n.conv AS conv_id, n.depth, u.conv AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN summed s USING (node) LEFT JOIN nodes u ON u.node = n.parent
""",
    "op9_chat_formatting": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
  SELECT *, {_escaped("text")} + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
    ELSE 26 + {_escaped("role")} END AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
""",
    "op5_warc": _PAYLOADS
    + f"""
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + CAST(
    (CAST('0x' || substr(digest, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > page_id THEN last END AS refers_to
FROM grouped
""",
}
