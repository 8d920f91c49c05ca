"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import STOP_WORDS

SQL: dict[str, str] = {}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A-Z only: `translate` leaves other letters as they are.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
d AS (SELECT p.page_id, p.html, k.first_id, sha1(p.html) AS hex FROM p JOIN k ON p.html = k.html),
b AS (SELECT *, list_reduce(list_transform(range(40), lambda i: CAST(printf('%04b', instr('0123456789abcdef', hex[CAST(i + 1 AS INTEGER)]) - 1) AS VARCHAR)), lambda x, y: x || y) AS bits FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(i * 5 + j + 1 AS INTEGER), 1) AS INTEGER) * CAST(power(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b
"""

SQL["op6_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, string_split({_LOW}, chr(10)) AS lows FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line, unnest(lows) AS low FROM d),
k AS (SELECT doc_id, pos, line, trim(low, {_BLANKS}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keep IS NOT NULL AND k.doc_id <> c.keep AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

SQL["op10_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, s, p.k, item_id FROM p JOIN g ON p.k = g.k AND p.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

#: The stop words of the four languages, as the rule table has them.
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

SQL["op8_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, gram, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[CAST(i AS INTEGER)] || chr(32) || w[CAST(i + 1 AS INTEGER)] || chr(32) || w[CAST(i + 2 AS INTEGER)])) AS gram FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS symbols,
  len(l) - len(list_distinct(l)) AS dup, len(l) AS lines, coalesce(n_repeat, 0) AS rep, greatest(len(w), 1) AS k, len(list_filter(w, lambda x: list_contains([{_STOP}], lower(x)))) AS stop,
  length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS upper, greatest(length(regexp_replace(t, '\\P{{L}}+', '', 'g')), 1) AS letters FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
  n < 50 OR 100 * rep > 50 * n AS base_failed,
  NOT (n < 50 OR 100 * rep > 50 * n OR symbols / k > 0.25e0 OR stop / k < 0.02e0 OR upper / letters > 0.5e0 OR dup / greatest(lines, 1) > 0.5e0 OR chars / k < 1.5e0 OR chars / k > 20) AS kept FROM m
"""

SQL["op13_collocations"] = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[2:m], ' '), array_to_string(string_split(phrase, ' ')[1:m - 1], ' ')]) AS phrase FROM f WHERE m > 2) GROUP BY ALL),
k AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR most < a)
SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000
"""
