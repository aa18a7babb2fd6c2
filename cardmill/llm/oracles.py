"""SQL for the operators that DuckDB can express, over the same tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

#: Every word of every document with its place, and the window of words that begins there (NULL where it is cut off).
WINDOWS = f"""
docs AS (SELECT doc_id, coalesce(text, '') AS text, source, n_chars FROM documents),
words AS (
  SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS place
  FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS list FROM docs)),
windows AS (
  SELECT *, CASE WHEN count(*) OVER w = {{width}} THEN string_agg(word, ' ') OVER w END AS key FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {{last}} FOLLOWING))"""

SUBSTRING_DEDUP = f"""
WITH {WINDOWS.format(width=13, last=12)},
firsts AS (SELECT key, min(doc_id) AS first FROM windows WHERE key IS NOT NULL GROUP BY key),
marked AS (
  SELECT doc_id, place, word,
         max(coalesce(first < doc_id, FALSE)::INTEGER)
           OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN firsts USING (key)),
runs AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY place), 0) = 0 AS opens FROM marked)
SELECT docs.doc_id, count(word)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone = 0), '')) AS kept_sha256,
       (count(*) FILTER (WHERE opens))::INTEGER AS n_repeats
FROM docs LEFT JOIN runs USING (doc_id) GROUP BY docs.doc_id
"""

QUALITY_RULES = f"""
WITH {WINDOWS.format(width=8, last=7)},
twice AS (SELECT doc_id, key FROM windows WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
marked AS (
  SELECT windows.doc_id, word,
         max((twice.key IS NOT NULL)::INTEGER)
           OVER (PARTITION BY windows.doc_id ORDER BY place ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS repeated
  FROM windows LEFT JOIN twice ON windows.doc_id = twice.doc_id AND windows.key = twice.key),
counts AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(repeated) AS n_repeat_words
  FROM marked GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, text, line, len(regexp_extract_all(line, '{WORD}')) AS n,
         translate(array_to_string(regexp_extract_all(regexp_replace(line, '[0-9]', '0', 'g'), '{WORD}'), ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD}')),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
frequent AS (
  SELECT source, norm FROM lines GROUP BY ALL HAVING count(DISTINCT doc_id) > 50),
removed AS (
  SELECT doc_id, sum(n) AS gone
  FROM lines JOIN frequent ON lines.norm = frequent.norm AND lines.source IS NOT DISTINCT FROM frequent.source
  GROUP BY doc_id),
told AS (
  SELECT docs.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(gone, 0)::BIGINT AS n_frequent_words
  FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND n_words - n_frequent_words >= 20 AND 2 * (n_words - n_frequent_words) >= n_words AS kept
FROM told
"""

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, n_chars FROM documents),
parts AS (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS place
  FROM (SELECT doc_id, string_split(text, chr(10)) AS list FROM docs)),
lines AS (
  SELECT *, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS norm,
         len(regexp_extract_all(line, '{WORD}')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY place) AS number
  FROM parts WHERE regexp_matches(line, '{WORD}')),
windows AS (
  SELECT doc_id, number, 1 AS n, 1 AS there, words, norm AS key FROM lines
  UNION ALL
  SELECT doc_id, number, 2, count(*) OVER w, sum(words) OVER w, string_agg(norm, chr(10)) OVER w FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
  UNION ALL
  SELECT doc_id, number, 3, count(*) OVER w, sum(words) OVER w, string_agg(norm, chr(10)) OVER w FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
firsts AS (
  SELECT *, first_value(doc_id) OVER f AS first_id, first_value(number) OVER f AS first_number FROM windows
  WHERE there = n AND (n = 3 OR words >= 50) WINDOW f AS (PARTITION BY n, key ORDER BY doc_id, number)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(number, number + n - 1)) AS number FROM firsts
  WHERE first_id < doc_id OR number >= first_number + n),
kept AS (
  SELECT p.doc_id, coalesce(string_agg(p.line, chr(10) ORDER BY p.place) FILTER (WHERE gone.number IS NULL), '') AS text
  FROM parts p LEFT JOIN lines USING (doc_id, place)
  LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.number = lines.number GROUP BY p.doc_id)
SELECT doc_id, (n_chars - length(kept.text))::BIGINT AS n_removed_chars, sha256(kept.text) AS kept_sha256
FROM docs JOIN kept USING (doc_id)
"""

#: Terms of letters and digits, and of letters only; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED_SEARCH = f"""
WITH terms AS (
  SELECT number, doc_id, unnest(regexp_extract_all({SMALL.format("text")}, '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS number, doc_id, text FROM documents)),
tf AS (SELECT number, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT number, sum(tf)::BIGINT AS n FROM tf GROUP BY number),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
asked AS (
  SELECT item, item_id, term, count(*) AS times
  FROM (SELECT item, item_id, unnest(regexp_extract_all({SMALL.format("text")}, '{TERM}')) AS term
        FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark))
  GROUP BY ALL),
scores AS (
  SELECT item, item_id, number, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (number), totals GROUP BY ALL),
ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20
"""

SOURCE_DIVERGENCE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS number, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS text FROM documents),
words AS (SELECT number, lang, source, unnest(regexp_extract_all({SMALL.format("text")}, '{LETTERS}')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT number) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT groups.lang, groups.source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups LEFT JOIN counts USING (lang, source)
  GROUP BY ALL),
p_of AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 1)::HUGEINT) // (n + v) AS p
  FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
of_lang AS (
  SELECT lang, term, 1 + (1000000000 * (c + 1)::HUGEINT) // (n + v) AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM counts GROUP BY ALL)
  JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p_of a JOIN p_of b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p_of JOIN of_lang USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
places AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM ranked)
SELECT * FROM places WHERE part = 'pair' OR rank <= 200
"""
