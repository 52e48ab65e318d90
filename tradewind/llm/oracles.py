"""The queries that DuckDB can express over the same tables."""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _terms(kept: str, table: str, key: str) -> str:
    """Words of a table's texts, A-Z lower-cased, one row each, by place from 1."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{kept}')"
    return f"""
  SELECT {key}, unnest(words) AS term, generate_subscripts(words, 1) AS place
  FROM (SELECT {key}, {words} AS words FROM {table})"""


# What the three operators take as words.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE_END = r"[.,;:!?\x0A-\x0D]"
_PHRASE_WORD = r"[^\x20\x09]+"

_SEARCH = f"""
WITH numbered AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
words AS ({_terms(_TERM, "numbered", "doc")}),
wanted AS (SELECT DISTINCT item_id, term FROM ({_terms(_TERM, "benchmark", "item_id")})),
lengths AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
frequencies AS (
  SELECT doc, term, count(*) AS tf FROM words
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM frequencies, corpus GROUP BY term),
impacts AS (
  SELECT doc, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact
  FROM frequencies JOIN weights USING (term) JOIN lengths USING (doc), corpus),
scores AS (
  SELECT item_id, doc, CAST(sum(impact) AS BIGINT) AS score
  FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc HAVING sum(impact) > 0),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS place
  FROM scores JOIN numbered USING (doc))
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

_CONTAMINATION = f"""
WITH numbered AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{_WORD}') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[start : start + size - 1], ' ') AS passage
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS start
        FROM (SELECT *, least(10, len(words)) AS size FROM item_words WHERE len(words) > 0))),
doc_words AS (
  SELECT doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{_WORD}') AS words
  FROM numbered),
places AS (
  SELECT doc, size, start, array_to_string(words[start : start + size - 1], ' ') AS passage
  FROM (SELECT doc, words, size, unnest(range(1, len(words) - size + 2)) AS start
        FROM doc_words, (SELECT DISTINCT size FROM windows))),
found AS (SELECT doc, item_id, size, start FROM places JOIN windows USING (size, passage)),
hits AS (
  SELECT doc, count(DISTINCT place) AS n_hit
  FROM (SELECT doc, unnest(range(start, start + size)) AS place FROM found) GROUP BY doc),
items AS (
  SELECT doc, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc) LEFT JOIN items USING (doc)
"""

_COLLOCATIONS = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words
  FROM (SELECT lang, regexp_extract_all(piece, '{_PHRASE_WORD}') AS words
        FROM (SELECT coalesce(lang, 'und') AS lang,
                     unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '{_PIECE_END}')) AS piece
              FROM documents))
  WHERE len(words) > 0),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counted AS (
  SELECT lang, size, words[start : start + size - 1] AS words, count(*) AS f
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS start
        FROM pieces, range(1, 5) AS sizes(size))
  GROUP BY ALL),
frequent AS (
  SELECT *, array_to_string(words, ' ') AS phrase FROM counted WHERE f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1 :], ' ')),
scored AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(words[start : start + part - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, words, f, part, unnest(range(1, size - part + 2)) AS start
        FROM frequent, range(2, 4) AS parts(part) WHERE part < size)
  GROUP BY 1, 2),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer USING (lang, phrase)
  WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM kept)
SELECT lang, place AS rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) WHERE place <= 2000
"""

ORACLES: dict[str, str] = {
    "op11_best_positions": _SEARCH,
    "op12_son_collocations": _COLLOCATIONS,
    "op13_wu_manber": _CONTAMINATION,
}
