"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.line_rules import BOILERPLATE

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = rf"""
WITH sized AS (SELECT doc_id, source, cast(len({_WORDS}) AS BIGINT) AS size, md5('mix:' || doc_id) AS key FROM documents),
weighted AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, cast(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS DOUBLE)
            / cast(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS DOUBLE) AS level
  FROM weighted
  WINDOW earlier AS (ORDER BY 3 * source_size / cast(weight AS DOUBLE), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cast(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT doc_id, size, t.source_size, target, cast(floor(target) AS BIGINT) AS quota,
         cast(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size))
       + greatest(0, least(size, quota - start - 2 * source_size)) AS taken
FROM placed
"""


def _has(line: str, characters: str) -> str:
    return f"(length({line}) - length(translate({line}, '{characters}', '')))"


_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)

OP4 = rf"""
WITH worded AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS met FROM starts),
covered AS (
  SELECT doc_id, cast(count(DISTINCT p) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE met > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM worded),
solid AS (SELECT doc_id, l, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS n FROM lines),
judged AS (
  SELECT doc_id, l, n,
         ({_has("l", "|>»")} >= 3 AND 8 * {_has("l", "|>»")} >= {_has("l", " ")})
         OR 10 * {_has("l", "#*$%&|<>")} >= n
         OR (n >= 10 AND 2 * {_has("l", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")} >= n)
         OR right(rtrim(l), 1) = ',' OR right(rtrim(l), 3) = '...'
         OR ({_has("trim(l)", " ")} = 1 AND NOT contains('.!?:;)"', right(rtrim(l), 1)))
         OR (length(l) <= 200 AND ({_PHRASES})) AS fails
  FROM solid WHERE n > 0),
per_document AS (
  SELECT doc_id, cast(count(*) AS BIGINT) AS n_lines, cast(count(*) - count(DISTINCT l) AS BIGINT) AS n_dup_lines,
         cast(sum(n) AS BIGINT) AS word_chars, cast(count(*) FILTER (fails) AS BIGINT) AS n_failed_lines,
         cast(coalesce(sum(n) FILTER (NOT fails), 0) AS BIGINT) AS left_chars
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars,
         cast(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(left_chars, 0) AS left_chars
  FROM worded LEFT JOIN per_document USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * left_chars >= 60 * word_chars AS kept
FROM counted
"""

_LIMITS = [limit for limit in ("1000", "0800", "0400", "0200", "0100", "0080") for _ in range(4)]
_SUBSET_HASHES = " || '-' || ".join(
    f"coalesce(substr(md5(string_agg(term, ' ' ORDER BY term) FILTER (substr(md5('{k}:' || term), 1, 4) < '{limit}')), 1, 8), '')"
    for k, limit in enumerate(_LIMITS)
)


def _likeness(a: str, b: str) -> str:
    pairs = f"list_filter(list_zip(string_split({a}, '-'), string_split({b}, '-')), lambda p: p[1] <> '' OR p[2] <> '')"
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN starts_with({a}, 'text-') OR starts_with({b}, 'text-') THEN 0.0::DOUBLE "
        f"ELSE len(list_filter({pairs}, lambda p: p[1] = p[2]))::DOUBLE / len({pairs}) END"
    )


OP1 = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id,
         coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text
  FROM texts WINDOW o AS (ORDER BY doc_id)),
bodies AS (
  SELECT doc_id, 0 AS edited, text AS body FROM pairs
  UNION ALL SELECT doc_id, 1, left(text, n - n // 2) || left(next_text, n // 2) FROM pairs),
listed AS (
  SELECT DISTINCT doc_id, edited, unnest(regexp_extract_all(lower(body), '[^\x20\x09-\x0D]+')) AS term FROM bodies),
lexicon AS (
  SELECT term FROM listed WHERE edited = 0 GROUP BY term
  HAVING count(*) >= (SELECT count(*) FROM texts) * exp(-6) AND count(*) <= (SELECT count(*) FROM texts) * exp(-1)),
hashed AS (
  SELECT doc_id, edited, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) || '-' || {_SUBSET_HASHES} AS mark
  FROM listed SEMI JOIN lexicon USING (term) GROUP BY doc_id, edited),
marked AS (
  SELECT doc_id, edited, sha256(body) AS digest, coalesce(mark, 'text-' || left(sha256(body), 32)) AS mark
  FROM bodies LEFT JOIN hashed USING (doc_id, edited))
SELECT p.doc_id, p.n AS n_chars, e.digest AS edited_sha256, a.mark AS fingerprint, e.mark AS edited_fingerprint,
       {_likeness("a.mark", "e.mark")} AS near_edited, {_likeness("a.mark", "f.mark")} AS near_next
FROM pairs p JOIN marked a ON a.doc_id = p.doc_id AND a.edited = 0 JOIN marked e ON e.doc_id = p.doc_id AND e.edited = 1
JOIN marked f ON f.doc_id = p.next_id AND f.edited = 0
"""

# The checksum of a word runs over its bytes with a table of 256 entries, which follows from the polynomial.
OP13 = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT range AS i FROM range(256)) n) t),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
d AS (SELECT doc_id, unnest(words) AS word FROM docs),
b AS (SELECT unnest(words) AS word FROM items),
coded AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM b) w),
octets AS (
  SELECT word, list_transform(range(strlen(h) // 2), lambda k: CAST(
    (instr('0123456789ABCDEF', substr(h, CAST(2 * k + 1 AS BIGINT), 1)) - 1) * 16
    + instr('0123456789ABCDEF', substr(h, CAST(2 * k + 2 AS BIGINT), 1)) - 1 AS BIGINT)) AS bytes FROM coded),
buckets AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) % 10000
    AS bucket FROM octets, steps),
s AS (SELECT bucket, count(*) AS n FROM d JOIN buckets USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM b JOIN buckets USING (word) GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) AS DOUBLE)
                    / CAST((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weighed AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM d JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN weighed USING (doc_id)),
noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS "rank" FROM noisy LEFT JOIN ranked USING (doc_id)
"""
