"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from stratiform.llm import line_rules

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM
  (SELECT item_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (win) WHERE dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

# base32 of the SHA-1: five bits at a time from two hex digits
OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((((strpos('0123456789abcdef', substr(x, 5 * i // 4 + 1, 1)) - 1) * 16
  + coalesce(nullif(strpos('0123456789abcdef', substr(x, 5 * i // 4 + 2, 1)), 0), 1) - 1) >> (3 - i % 4)) & 31)::INT, 1)
  FOR i IN range(32)], '') AS payload_digest FROM p),
m AS (SELECT payload_digest, n, max(page_id) AS top FROM d GROUP BY 1, 2)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d JOIN m USING (payload_digest, n)
"""


def symbols(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE = "100 * {0} <= {1} * length(x)"
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{SPACED}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{line_rules.HAS_WORD}')) AS l FROM d),
win AS (SELECT doc_id, i, hash(w[i:i + 4]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, unnest(list_distinct(l)) AS x FROM w),
good AS (SELECT doc_id, sum(length(x)) AS n FROM lines WHERE regexp_matches(x, '{line_rules.ENDS.replace("'", "''")}')
  AND {symbols("x", "|")} < 3 AND {LINE.format(symbols("x", line_rules.SYMBOLS), 10)} AND {LINE.format(symbols("x", "!"), 5)}
  AND 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')))
    <= 60 * (2 * length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) - length(regexp_replace(x, '[a-z]', '', 'g')))
  AND NOT regexp_matches(x, '{line_rules.BOILERPLATE}')
  AND (len(regexp_extract_all(x, '{SPACED}')) < 10
    OR 100 * len(list_distinct(regexp_extract_all(x, '{SPACED}'))) >= 30 * len(regexp_extract_all(x, '{SPACED}'))) GROUP BY 1),
r AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {SPACES}, ''))::BIGINT AS word_chars,
  {symbols("t", line_rules.SYMBOLS)}::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS total, coalesce(good.n, 0) AS kept_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN good USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (total - kept_chars) <= 50 * total AS kept FROM r
"""

OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

LETTERS = [f"l{i}.x" for i in range(5)]
OP12 = f"""
WITH lab AS (SELECT doc_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
f AS (SELECT part, coalesce(g, false) AS g, coalesce(x, false) AS x,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS failed
  FROM d LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE g) AS good, count(*) FILTER (WHERE x) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT {' || '.join(LETTERS)} AS o FROM l l0, l l1, l l2, l l3, l l4 WHERE len(list_distinct([{', '.join(LETTERS)}])) = 5),
s AS (SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM (SELECT o, unnest(range(1, 6)) AS s FROM o)),
r AS (SELECT part, o, s, x, n, good, toxic, failed = x AS only_x, contains(failed, x) AS fails, translate(failed, before, '') = failed AS here FROM c, s),
e AS (SELECT part, o, s, x, sum(CASE WHEN here AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND fails THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN NOT here AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN only_x THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN here AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN here AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, o AS filter_order, s::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM e
"""

OP13 = """
WITH known AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM known a JOIN known b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3
"""

ORACLE = {"op2_substrings": OP2, "op8_line_rules": OP8, "op3_warc": OP3, "op10_decontaminate": OP10, "op12_filter_audit": OP12, "op13_hard_negatives": OP13}
