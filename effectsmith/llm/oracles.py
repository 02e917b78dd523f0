"""SQL of the queries that SQL can say: op4, op7 and op10. The others learn, hash or decode."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

TOOL_CALLS = f"""WITH c AS (SELECT conv_id, turn AS call_id, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, turn, text, len({WORDS}) AS words,
  turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM conversations WHERE role IN ('user', 'system')),
 calls AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM c),
 results AS (SELECT conv_id, turn - 1 AS call_id, text AS content FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name, c.level,
 CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
 CASE WHEN c.call_id IS NOT NULL THEN c.text IS NOT NULL END AS valid, CASE WHEN c.call_id IS NOT NULL THEN 1 END AS n_calls, CASE WHEN r.call_id IS NOT NULL THEN 1 END AS n_results,
 '{{"after":' || CASE WHEN c.turn >= 2 THEN '"' || (c.turn - 2) || '"' ELSE 'null' END || ',"arguments":' ||
 CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{{' || coalesce('"text":' || to_json(c.text)::VARCHAR || ',', '') || '"turn":' || c.turn || ',"words":' || c.words || '}}' END ||
 ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","content":' || coalesce(to_json(r.content)::VARCHAR, 'null') || ',"name":' || coalesce('"' || c.name || '"', 'null') || '}}' AS json
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
 win AS (SELECT k, i, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
 hit AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
 inside AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY k),
 lines AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
 s AS (SELECT d.doc_id, d.source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (k) LEFT JOIN inside USING (k)),
 f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
 h AS (SELECT source, count(*) AS n, count(*) FILTER (n_words < 50) AS few, count(*) FILTER (100 * n_repeat_words > 50 * n_words) AS repeats,
  count(*) FILTER (n_symbols > 0.5 * n_words) AS symbols, count(*) FILTER (n_dup_lines > 20) AS lines FROM f GROUP BY source),
 u AS (UNPIVOT h ON few, repeats, symbols, lines INTO NAME rule VALUE bad),
 m AS (SELECT rule, sum(bad) / sum(n) AS m, sum(bad * bad / n) / sum(n) AS s FROM u GROUP BY rule),
 p AS (SELECT rule, m, least(greatest(m * (1 - m) / greatest(s - m * m, 1e-12) - 1, 1), 1e6) AS c FROM m),
 r AS (SELECT source, rule, n, m, c, (bad + m * c) / (n + c) AS rate FROM u JOIN p USING (rule)),
 v AS (SELECT source, rule, rate, rate - 0.5 * sqrt(rate * (1 - rate) / (n + c + 1)) > m + 1e-12 AS is_bad FROM r),
 w AS (SELECT source, max(rate) FILTER (rule = 'few') AS few_rate, max(rate) FILTER (rule = 'repeats') AS repeats_rate, max(rate) FILTER (rule = 'symbols') AS symbols_rate,
  max(rate) FILTER (rule = 'lines') AS lines_rate, bool_or(is_bad) FILTER (rule = 'symbols') AS symbols_bad, bool_or(is_bad) FILTER (rule = 'lines') AS lines_bad FROM v GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(few_rate, 6) AS few_rate, round(repeats_rate, 6) AS repeats_rate,
 round(symbols_rate, 6) AS symbols_rate, round(lines_rate, 6) AS lines_rate,
 NOT (base_failed OR greatest(few_rate, repeats_rate, symbols_rate, lines_rate) > 0.5 OR (n_symbols > 0.5 * n_words AND symbols_bad) OR (n_dup_lines > 20 AND lines_bad)) AS kept
FROM f JOIN w ON f.source IS NOT DISTINCT FROM w.source"""

_LETTERS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

DECONTAMINATE = f"""WITH it AS (SELECT item_id, {_LETTERS} AS w FROM benchmark), sized AS (SELECT item_id, w, least(len(w), 5) AS size FROM it WHERE len(w) > 0),
 ish AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM sized, unnest(range(1, len(w) - size + 2)) AS u(i)),
 n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id), sizes AS (SELECT DISTINCT size FROM ish),
 dw AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
 dsh AS (SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS u(i))
SELECT doc_id, item_id, count(*) AS shared, n FROM ish JOIN dsh USING (size, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)"""

ORACLES = {"op4_tool_calls": TOOL_CALLS, "op7_quality_rules": QUALITY, "op10_decontaminate": DECONTAMINATE}
