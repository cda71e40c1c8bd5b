"""SQL twins of the registered document queries, for DuckDB."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')"

#: A window's words are joined by a space, which no word holds.
OP1 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) t(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, w.source, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT avg(f / n) AS mean, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS between_hosts FROM h
), s AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN least(1000.0, greatest(2.0, mean * (1 - mean) / between_hosts - 1)) ELSE 1000.0 END AS strength FROM p
), v AS (
  SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, s
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN v USING (source)
"""

#: The sketch decides only lines far from the threshold, so exact counts agree.
OP8 = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), common AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY line HAVING count(DISTINCT source) >= 10
), r AS (
  SELECT l.doc_id, count(*) FILTER (c.line IS NOT NULL) AS gone,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (c.line IS NULL), '') AS kept
  FROM l LEFT JOIN common c ON l.line = c.line GROUP BY l.doc_id
)
SELECT doc_id, gone::BIGINT AS n_removed_lines, sha256(kept) AS kept_sha256 FROM r
"""

#: Bytes as pairs of hex digits; window i starts at byte i.
OP2 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (
  SELECT doc_id, i, md5(x[2 * i + 1:2 * i + 200]) AS gram
  FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 99)) AS i FROM h WHERE len(x) >= 200)
), late AS (
  SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1
), edges AS (
  SELECT doc_id, i, i > lag(i) OVER w + 100 OR lag(i) OVER w IS NULL AS opens FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edges) GROUP BY doc_id, r
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(x[2 * a + 1:2 * b], '' ORDER BY a) AS x FROM gaps JOIN h USING (doc_id) GROUP BY doc_id
), n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT h.doc_id, (len(h.x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: translate() lower-cases A-Z only.
OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

OP4 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)
), late AS (
  SELECT doc_id, i FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY gram)
), gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(50) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM d
"""

ORACLES = {"op3_minhash_near_dedup": OP3, "op2_suffix_dedup": OP2, "op4_substring_dedup": OP4, "op7_warc_segments": OP7, "op1_quality_rules": OP1, "op8_line_dedup": OP8}
