"""Checking SQL (DuckDB) for the queries of this folder that SQL can express."""

from __future__ import annotations

from srcatlas.llm.quality import FENCE, GUARDS, LEADING_BITS, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, STEPS

_SPACE = r"[\x20\x09-\x0D]+"

ORACLES = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op5_quality": f"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM words
), keyed AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM windows
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p + d)::BIGINT AS n FROM twice, range(0, 3) AS s(d) GROUP BY doc_id
), f AS (
  SELECT words.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
), r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0) AS symbol_rate, coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) AS dup_line_rate,
         coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) AS repeat_rate, coalesce(word_chars * 10000 // nullif(n_words, 0), 0) AS word_length
  FROM f
), flat AS (
  SELECT lang, source, feature, value // (1 << greatest(length(bin(value)) - {LEADING_BITS}, 0)) * (1 << greatest(length(bin(value)) - {LEADING_BITS}, 0)) AS bucket
  FROM (UNPIVOT (SELECT * FROM r WHERE NOT base_failed) ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME feature VALUE value)
), levels AS (
  SELECT 's' AS level, lang, source, feature, bucket FROM flat
  UNION ALL SELECT 'l', lang, NULL, feature, bucket FROM flat
  UNION ALL SELECT 'a', NULL, NULL, feature, bucket FROM flat
), counted AS (
  SELECT level, lang, source, feature, bucket, count(*) AS n, 1 << greatest(length(bin(bucket)) - {LEADING_BITS}, 0) AS width FROM levels GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (g ORDER BY bucket) AS upto, sum(n) OVER g AS total, lead(bucket) OVER (g ORDER BY bucket) AS next
  FROM counted WINDOW g AS (PARTITION BY level, lang, source, feature)
), quartiles AS (
  SELECT level, lang, source, feature, max(total) AS n, min(bucket) FILTER (upto * 4 >= total) AS low, min(bucket) FILTER (upto * 4 >= total * 2) AS mid
  FROM ranked GROUP BY level, lang, source, feature
), reached AS (
  SELECT q.*, {FENCE} * greatest(mid - low, width, CASE q.feature {" ".join(f"WHEN '{k}' THEN {v}" for k, v in STEPS.items())} END) AS reach
  FROM quartiles q JOIN ranked r ON r.level = q.level AND r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source
    AND r.feature = q.feature AND r.bucket = q.mid
), bounds AS (
  SELECT q.level, q.lang, q.source, q.feature, max(q.n) AS n,
         greatest(CASE q.feature {" ".join(f"WHEN '{k}' THEN {v}" for k, v in GUARDS.items())} END,
                  min(bucket + width - 1) FILTER (bucket >= mid AND (next IS NULL OR next - (bucket + width - 1) > reach))) AS bound
  FROM reached q JOIN ranked r ON r.level = q.level AND r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source AND r.feature = q.feature
  GROUP BY q.level, q.lang, q.source, q.feature
), chosen AS (
  SELECT s.lang, s.source, s.feature, CASE WHEN s.n >= {MIN_GROUP} THEN s.bound WHEN l.n >= {MIN_GROUP} THEN l.bound ELSE a.bound END AS bound
  FROM bounds s JOIN bounds l ON l.level = 'l' AND l.lang IS NOT DISTINCT FROM s.lang AND l.feature = s.feature
  JOIN bounds a ON a.level = 'a' AND a.feature = s.feature WHERE s.level = 's'
), wide AS (
  SELECT lang, source, {", ".join(f"max(bound) FILTER (feature = '{k}') AS {k}" for k in GUARDS)} FROM chosen GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(f"r.{k} <= wide.{k}" for k in GUARDS)}, true) AS kept
FROM r LEFT JOIN wide ON r.lang IS NOT DISTINCT FROM wide.lang AND r.source IS NOT DISTINCT FROM wide.source
""",
    "op12_resampling": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), texts AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS uid, text FROM documents
  UNION ALL SELECT 'b', item_id, -row_number() OVER (), text FROM benchmark
), words AS (
  SELECT kind, id, uid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts
), places AS (
  SELECT kind, uid, w, unnest(range(1, len(w) + 1)) AS p FROM words
), grams AS (
  SELECT kind, uid, w[p] AS g FROM places
  UNION ALL SELECT kind, uid, w[p] || ' ' || w[p + 1] FROM places WHERE p + 1 <= len(w)
  UNION ALL SELECT kind, uid, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] FROM places WHERE p + 2 <= len(w)
), distinct_grams AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM grams)
), hashed AS (
  SELECT g, xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_grams, crc_table
), counted AS (
  SELECT kind, uid, bucket, count(*) AS n FROM grams JOIN hashed USING (g) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums
), weights AS (
  SELECT uid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY uid
), scored AS (
  SELECT id AS doc_id, uid, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(id::VARCHAR, ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (uid) WHERE kind = 'd'
), places_of AS (
  SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, uid) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN places_of USING (uid)
""",
    "op13_prefix_trie": r"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), turns AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, tid, bytes FROM turns
), numbers AS (
  SELECT DISTINCT conv_id, n, conv_id - conv_id % 5 AS base, hex(encode(conv_id::VARCHAR)) AS x FROM own
), families AS (
  SELECT conv_id, n, base, xor(list_reduce([4294967295] || list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM numbers, crc_table
), sized AS (
  SELECT f.conv_id, f.base, f.h, least(f.h, coalesce(b.n, 0)) AS kept, least(f.h, coalesce(b.n, 0)) + greatest(f.n - f.h, 0) AS n
  FROM families f LEFT JOIN families b ON f.base = b.conv_id
), made AS (
  SELECT s.conv_id, pos - h + kept AS pos, tid, bytes FROM sized s JOIN own o ON s.conv_id = o.conv_id WHERE pos >= h
  UNION ALL SELECT s.conv_id, pos, tid, bytes FROM sized s JOIN own o ON s.base = o.conv_id WHERE pos < h
), prefixes AS (
  SELECT conv_id, pos + 1 AS depth, md5(string_agg(tid, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS k, bytes FROM made
  UNION ALL SELECT conv_id, 0, '', 0 FROM sized
), steps AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM prefixes
), nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(bytes) AS bytes FROM steps GROUP BY depth, k
), children AS (
  SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT p.depth, p.k, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved
  FROM nodes m LEFT JOIN children c ON c.depth = m.depth AND c.k = m.k JOIN prefixes p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY ALL
), ends AS (
  SELECT p.depth, p.k, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS digest FROM prefixes p JOIN sized s ON s.conv_id = p.conv_id AND s.n = p.depth GROUP BY ALL
)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens,
       coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes m JOIN below b ON b.depth = m.depth AND b.k = m.k LEFT JOIN nodes u ON u.depth = m.depth - 1 AND u.k = m.up
LEFT JOIN children c ON c.depth = m.depth AND c.k = m.k LEFT JOIN ends e ON e.depth = m.depth AND e.k = m.k
""",
}
