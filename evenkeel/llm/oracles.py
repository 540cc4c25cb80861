"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

from evenkeel.llm.line_quality import LIMITS

WORDS = r"[^\x20\x09-\x0D]+"
A, Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_FREQUENCY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text
             FROM documents),
 w AS (SELECT r, regexp_extract_all(text, '{WORDS}') AS w FROM d),
 pos AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
 tri AS (SELECT r, i, word || chr(31) || lead(word, 1) OVER o || chr(31) || lead(word, 2) OVER o
                AS gram FROM pos WINDOW o AS (PARTITION BY r ORDER BY i)),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM tri
            WHERE gram IS NOT NULL) x WHERE n > 1),
 rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k)
          GROUP BY r),
 l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
 ll AS (SELECT r, line, len(regexp_extract_all(line, '{WORDS}')) AS n,
               md5(trim(regexp_replace(translate(line, '{A}123456789', '{Z}000000000'),
                   '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS k
          FROM l WHERE regexp_matches(line, '{WORDS}')),
 dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ll GROUP BY r),
 ls AS (SELECT r, list_sort(list(DISTINCT k)) AS line_set FROM ll GROUP BY r),
 host AS (SELECT source, count(DISTINCT line_set) AS docs FROM d JOIN ls USING (r) GROUP BY source),
 freq AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT line_set) AS n
            FROM d JOIN ll USING (r) JOIN ls USING (r) GROUP BY source, k) f
            JOIN host h USING (source)
           WHERE n > {LIMITS["min_documents"]} AND n > {LIMITS["max_share"]} * docs),
 gone AS (SELECT r, sum(n) AS gone FROM d JOIN ll USING (r) JOIN freq USING (source, k) GROUP BY r),
 a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
              CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
              CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
              CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
              coalesce(gone, 0) AS gone
         FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
         LEFT JOIN gone USING (r)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - gone >= {LIMITS["min_left"]} * n_words AS kept FROM b
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"substr('{_BASE32}', CAST((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {15 - 5 * j}) & 31 AS INT)"
    " + 1, 1)"
    for i in range(8) for j in range(4)
)
ARC_TO_WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
 k AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
  FROM p JOIN k USING (h)
"""

CHOSEN_PATH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A}', '{Z}'),
                       '{WORDS}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
              ELSE array_to_string(w[i:i + 4], ' ') END AS g
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d
                WHERE len(w) > 0) x),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g
          AND a.doc_id <> b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
           WHERE 100 * c >= 85 * (x.n + y.n - c)),
 reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION
                 SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id,
       d.doc_id = m.c AS kept
  FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m
    ON m.a = d.doc_id
"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                  translate(coalesce(text, ''), '{A}', '{Z}'), '[.,;:!?\x0A-\x0D]')) AS piece
             FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang HAVING sum(len(w)) > 0),
 g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
         FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
                 FROM w, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE len(w) >= m) x),
 f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
 inner_ AS (SELECT lang, a, array_to_string(w[i:j], ' ') AS phrase
              FROM (SELECT *, unnest(range(i + 1, len(w) + 1)) AS j
                      FROM (SELECT *, unnest(range(1, len(w))) AS i FROM c) x) y
             WHERE j - i + 1 < len(w)),
 gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ i
             ON c.lang = i.lang AND c.phrase = i.phrase AND 100 * i.a >= 100 * c.a),
 cut AS (SELECT c.lang, phrase, a, n, k, array_to_string(w[1:k], ' ') AS x,
                array_to_string(w[k + 1:], ' ') AS y
           FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c) c JOIN n USING (lang)
          WHERE NOT EXISTS (FROM gone o WHERE o.lang = c.lang AND o.phrase = c.phrase)),
 s AS (SELECT cut.*, l.f AS l, r.f AS r,
              1000::HUGEINT * a * n // (l.f::HUGEINT * r.f) AS score
         FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x
         JOIN f r ON r.lang = cut.lang AND r.phrase = y),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM b QUALIFY rank <= 2000
"""

ORACLES = {
    "op3_line_frequency": LINE_FREQUENCY,
    "op6_arc_to_warc": ARC_TO_WARC,
    "op8_chosen_path": CHOSEN_PATH,
    "op12_collocations": COLLOCATIONS,
}
