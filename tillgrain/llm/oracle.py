"""The same results as SQL for DuckDB, where SQL can express them."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH w AS (SELECT doc_id, source, text, {WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)),
twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
places AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM windows JOIN twice USING (doc_id, win)),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY source),
total AS (SELECT sum(n) / count(*) AS per_host, (sum(f) + 0.5) / (sum(n) + 1.0) AS mean,
                 var_pop(f / n) AS variance, avg(1.0 / n) AS scatter FROM hosts),
spread AS (SELECT *, variance - mean * (1 - mean) * scatter AS between_hosts FROM total),
prior AS (SELECT mean, least(greatest(CASE WHEN between_hosts <= 0 THEN per_host ELSE mean * (1 - mean) / between_hosts - 1 END, 1.0), per_host + 1.0) AS strength FROM spread),
rates AS (SELECT source, (f + mean * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.75 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""

OP5 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""

OP10 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) > 12)),
first AS (SELECT win, min(doc_id) AS d FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN first USING (win), range(13) AS r(k) WHERE doc_id > d),
kept AS (
  SELECT t.doc_id, count(gone.i) AS n_removed, string_agg(t.word, ' ' ORDER BY t.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w) t
  LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

# crc32 of the decimal doc_id bit by bit; equal words at a lag in one piece are a
# run's word pairs, and of several lags on one stretch the least is its period
OP13 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w0, len({WORDS}) AS n FROM documents),
crc AS (
  SELECT doc_id, w0, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) AS h FROM w),
place AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS m FROM crc),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % (1 + (n - a) // (3 + m)) + 1] END) ELSE w0 END AS words
  FROM place),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM planted),
pairs AS (SELECT y.doc_id, y.i - x.i AS q, y.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
pieces AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM pieces GROUP BY doc_id, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS kept FROM word t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op4_host_quality": OP4, "op5_exact_blocks": OP5, "op10_substring_windows": OP10, "op13_periodic_runs": OP13}
