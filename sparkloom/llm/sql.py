"""DuckDB SQL for the queries that SQL can express."""

RULE_LEDGER = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (
  SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM again) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(body, '[^A-Z]+', '', 'g')) AS n_upper,
         length(regexp_replace(body, '[^!]+', '', 'g')) AS n_exclaim
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
),
b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_exclaim > 3 * n_words THEN 128 ELSE 0 END AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""

BITMAP_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 3 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
         coalesce(min(doc_id) OVER (PARTITION BY body) < doc_id, false) AS e
  FROM t
),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
g AS (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
),
p AS (
  SELECT part, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS fails, n, n_good, n_toxic
  FROM g
),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT v.k || w.k || x.k || y.k || z.k AS filter_order
  FROM x v, x w, x, x y, x z WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5
),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
m AS (SELECT filter_order, step, filter_order[step] AS own, string_split(left(filter_order, step - 1), '') AS earlier FROM s),
r AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, earlier)) AS kept,
         sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)) AS removed,
         sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, earlier)) AS redundant,
         sum(n) FILTER (fails = [own]) AS unique_fails,
         sum(n_good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)) AS good_lost,
         sum(n_toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, earlier)) AS toxic_lost
  FROM p, m GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM r
"""

RULE_ABLATIONS = f"""
WITH l AS ({RULE_LEDGER}),
r AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'duplicate_lines', 'short_words', 'long_words', 'upper_case', 'exclamations']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS bit)
SELECT rule, count(*) FILTER ((failed_bits & bit) <> 0) AS n_fails, count(*) FILTER (failed_bits = bit) AS n_alone, count(*) FILTER ((failed_bits & ~bit) = 0) AS n_kept_without
FROM l, r GROUP BY rule
"""
