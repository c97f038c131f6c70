"""Reference SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS k FROM documents),
g AS (
  SELECT doc_id, k, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g"""

# u: 52 bits of md5 over seed, id and the text's md5; ids are unique in the test tables
SOURCE_MIXING = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
k AS (
  SELECT doc_id, source, size, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS symbols, [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '{WORD}')] AS lines,
         (CAST('0x' || substr(md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), md5(text))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM d),
q AS (
  SELECT doc_id, source, size,
         -ln(u) / CASE WHEN size > 0 THEN 1e0 / (1e0 + (greatest(3e0 - chars / CAST(size AS DOUBLE), chars / CAST(size AS DOUBLE) - 10e0, 0e0)
           + 10e0 * symbols / CAST(size AS DOUBLE) + 2e0 * (len(lines) - len(list_distinct(lines))) / CAST(greatest(len(lines), 1) AS DOUBLE))) ELSE 1e0 END AS key
  FROM k),
s0 AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source),
s AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM s0),
o AS (
  SELECT *, 2e0 * source_size AS cap, sum(source_size) OVER () * 1.5e0 AS total, row_number() OVER (ORDER BY 2e0 * source_size / weight, source NULLS LAST) AS pos FROM s),
l AS (
  SELECT a.source, a.source_size, a.weight, a.cap, a.pos,
         (a.total - (SELECT coalesce(sum(b.cap), 0e0) FROM o b WHERE b.pos < a.pos)) / (SELECT sum(b.weight) FROM o b WHERE b.pos >= a.pos) AS level
  FROM o a),
f AS (
  SELECT level AS final FROM l WHERE level * weight <= cap ORDER BY pos LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT final FROM f) * weight, cap)) AS target FROM l),
e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT q.doc_id, q.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(q.size) OVER (PARTITION BY q.source ORDER BY q.key, q.doc_id ROWS UNBOUNDED PRECEDING) AS upto,
         sum(q.size) OVER (PARTITION BY q.source ORDER BY q.key, q.doc_id ROWS UNBOUNDED PRECEDING) - q.size AS before
  FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND upto - size / 2e0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""

_MEASURES = {
    "symbols": ("n_symbols", "n_words", 10_000), "dup_lines": ("n_dup_lines", "n_lines", 100_000),
    "repeats": ("n_repeat_words", "n_words", 100_000), "word_length": ("word_chars", "n_words", 250_000),
}
_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{k}' AS measure, CAST(floor({a} * 1000000e0 / greatest({b}, 1)) AS BIGINT) AS v, base_failed FROM m"
    for k, (a, b, _) in _MEASURES.items()
)
_SPREAD = "CASE measure " + " ".join(f"WHEN '{k}' THEN {spread}" for k, (_, _, spread) in _MEASURES.items()) + " END"
_DIGITS = "((v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0))"


def _fences(name: str, keys: str) -> str:
    part = f"{keys}, measure" if keys else "measure"
    return f"""
{name}0 AS (
  SELECT {part}, digits, count(*) AS n FROM b GROUP BY {part}, digits),
{name}1 AS (
  SELECT {part}, digits, sum(n) OVER (PARTITION BY {part} ORDER BY digits) AS upto, sum(n) OVER (PARTITION BY {part}) AS total FROM {name}0),
{name}2 AS (
  SELECT {part}, min(CASE WHEN upto * 4 >= total THEN digits END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN digits END) AS q3, max(total) AS docs
  FROM {name}1 GROUP BY {part}),
{name} AS (
  SELECT {part}, docs, q1 - 3 * greatest(q3 - q1, {_SPREAD}) AS low,
         q3 + (CAST(1 AS BIGINT) << greatest(length(bin(q3)) - 8, 0)) - 1 + 3 * greatest(q3 - q1, {_SPREAD}) AS high FROM {name}2)"""


ADAPTIVE_QUALITY = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d WHERE len(w) > 2),
x AS (
  SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM x WHERE c IS NOT NULL),
z AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM y, (VALUES (0), (1), (2)) AS s(k) WHERE y.n > 1 GROUP BY doc_id),
li AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM li WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m0 AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id),
m AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m0),
v AS (
  {_VALUES}),
b AS (
  SELECT coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, measure, {_DIGITS} AS digits FROM v WHERE NOT base_failed),{_fences("g", "lang, source")},{_fences("h", "lang")},{_fences("c", "")},
j AS (
  SELECT v.doc_id, bool_or(NOT v.base_failed AND (
      v.v > CASE WHEN g.docs >= 200 THEN g.high WHEN h.docs >= 200 THEN h.high ELSE c.high END
      OR v.v < CASE WHEN g.docs >= 200 THEN g.low WHEN h.docs >= 200 THEN h.low ELSE c.low END)) AS outside
  FROM v
  LEFT JOIN g ON g.lang = coalesce(v.lang, '-') AND g.source = coalesce(v.source, '-') AND g.measure = v.measure
  LEFT JOIN h ON h.lang = coalesce(v.lang, '-') AND h.measure = v.measure
  LEFT JOIN c ON c.measure = v.measure
  GROUP BY v.doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outside, false) AS kept
FROM m JOIN j ON j.doc_id = m.doc_id"""


PHRASES = f"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
q AS (
  SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (
  SELECT lang, 1 AS n, unnest(w) AS phrase FROM q
  UNION ALL SELECT lang, 2, unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, len(w))]) FROM q WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) FROM q WHERE len(w) > 2),
t AS (
  SELECT lang, count(*) AS n FROM g WHERE n = 1 GROUP BY lang),
f AS (
  SELECT lang, n, phrase, count(*) AS f FROM g GROUP BY lang, n, phrase HAVING count(*) >= 10),
c AS (
  SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1),
k AS (
  SELECT c.lang, c.n, c.phrase, a, i.k, array_to_string(w[1:i.k], ' ') AS x, array_to_string(w[i.k + 1:], ' ') AS y FROM c, (VALUES (1), (2)) AS i(k) WHERE i.k < c.n),
s AS (
  SELECT k.lang, k.n, k.phrase, a, k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM k JOIN f AS l ON l.lang = k.lang AND l.phrase = k.x JOIN f AS r ON r.lang = k.lang AND r.phrase = k.y),
b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE n = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE n = 3),
m AS (
  SELECT lang, phrase, max(a) AS most FROM i GROUP BY lang, phrase),
o AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN m ON b.n = 2 AND m.lang = b.lang AND m.phrase = b.phrase WHERE m.most IS NULL OR 100 * m.most < 50 * b.a)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000"""
