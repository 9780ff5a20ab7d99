"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('17:' || CAST(doc_id AS VARCHAR)) AS key FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w,
         CAST(source_size * 3 AS DOUBLE) AS cap FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), targets AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (
    SELECT r, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM docs WHERE len(words) > 7)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
    SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), stats AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(l.n, 0) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS capitals,
         len(regexp_extract_all(text, '\p{{Ll}}')) AS small, len(regexp_extract_all(text, '[!?]')) AS marks
  FROM docs d LEFT JOIN covered c ON c.r = d.r LEFT JOIN lines l ON l.r = d.r
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 40 * n_lines OR capitals > small
         OR 100 * marks > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM base
"""

SUBSTRINGS = rf"""
WITH docs AS (
  SELECT doc_id, {WORDS} AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w FROM (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM docs WHERE len(words) > 49)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE doc_id > first
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM later
), positions AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM docs
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.k) AS text, count(*) AS n
  FROM positions p ANTI JOIN covered c ON c.doc_id = p.doc_id AND c.k = p.k GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + 24 + len(regexp_extract_all(text,
         '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

WARC = """
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), firsts AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM digests
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM pieces GROUP BY lang
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), counted AS (
  SELECT lang, words[i:i + k - 1] AS ws, CAST(count(*) AS HUGEINT) AS f FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words)
  GROUP BY lang, words[i:i + k - 1] HAVING count(*) >= 100
), cands AS (
  SELECT lang, ws, f AS a FROM counted WHERE len(ws) > 1
), cuts AS (
  SELECT c.lang, c.ws, c.a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.a * n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM cands) c
  JOIN counted l ON l.lang = c.lang AND l.ws = c.ws[1:k] JOIN counted r ON r.lang = c.lang AND r.ws = c.ws[k + 1:]
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS most FROM (
    SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(ws))) AS m FROM cands)) GROUP BY lang, ws[i:i + m - 1]
), ranked AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(array_to_string(b.ws, ' '))) AS rank
  FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.ws = b.ws WHERE i.most IS NULL OR 100 * i.most < 100 * a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_source_mix": MIX,
    "op2_chat_format": CHAT,
    "op3_warc": WARC,
    "op5_quality_cascade": QUALITY,
    "op6_substring_dedup": SUBSTRINGS,
    "op13_collocations": COLLOCATIONS,
}
