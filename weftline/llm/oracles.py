"""DuckDB SQL for the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

LINE_FREQUENCY = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT doc_id, host, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines
  FROM docs
), lines AS (
  SELECT doc_id, host, text, unnest(full_lines) AS line FROM tokens
), normal AS (
  SELECT doc_id, host, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM lines
), sized AS (
  SELECT *, len(string_split(norm, ' ')) AS n FROM normal
), hosts AS (
  SELECT host, count(DISTINCT text) AS host_docs FROM docs GROUP BY host
), bad AS (
  SELECT s.host, s.norm FROM sized s JOIN hosts h ON s.host = h.host
  GROUP BY s.host, s.norm, h.host_docs HAVING count(DISTINCT s.text) > 10 AND count(DISTINCT s.text) * count(DISTINCT s.text) > h.host_docs
), removed AS (
  SELECT s.doc_id, sum(s.n) AS removed_words FROM sized s JOIN bad b ON s.host = b.host AND s.norm = b.norm GROUP BY s.doc_id
), windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) AS x
  FROM tokens WHERE len(w) >= 3
), repeated AS (
  SELECT doc_id, x.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x.g) >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id
), base AS (
  SELECT t.doc_id,
         len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(r.removed_words, 0)::BIGINT AS removed_words
  FROM tokens t LEFT JOIN covered c ON t.doc_id = c.doc_id LEFT JOIN removed r ON t.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept,
       removed_words
FROM base
"""

REPLY_TREES = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

PREFIX_TRIE = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), bytes AS (  -- the decimal digits of each identifier, and eight steps of a bit for each
  SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base,
         flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
  FROM (SELECT DISTINCT conv_id FROM own)
), hashed AS (  -- crc32, reflected polynomial; a step takes a byte in or shifts a bit out
  SELECT conv_id, base,
         xor(list_reduce(list_concat([4294967295], steps), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x::BIGINT) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h
  FROM bytes
), rebuilt AS (
  SELECT c.conv_id, o.role, o.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY o.place > c.h, o.place) AS d
  FROM hashed c JOIN own o ON (o.conv_id = c.base AND o.place <= c.h) OR (o.conv_id = c.conv_id AND o.place > c.h)
), turns AS (
  SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY d) AS digests,
         list(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) ORDER BY d) AS words
  FROM rebuilt GROUP BY conv_id
), paths AS (
  SELECT c.conv_id, coalesce(t.digests, []) AS digests, coalesce(t.words, []) AS words FROM hashed c LEFT JOIN turns t ON c.conv_id = t.conv_id
), members AS (
  SELECT conv_id, d, sha256(array_to_string(digests[1:d], '')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(digests[1:d - 1], '')) END AS parent,
         CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(digests) AS ends
  FROM (SELECT conv_id, digests, words, unnest(range(0, len(digests) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, min(d) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node
), children AS (
  SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (  -- a node is below each node that its smallest member passes
  SELECT m.node, sum(u.saved) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
  FROM nodes u JOIN members m ON m.conv_id = u.conv_id AND m.d <= u.depth LEFT JOIN children c ON c.parent = u.node
  GROUP BY m.node
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN sums s ON s.node = v.node LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN children c ON c.parent = v.node
"""

FILTER_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN words.doc_id > least OR (words.doc_id IS NULL AND least IS NOT NULL) THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS before FROM orders, range(1, 6) t(step)
), applied AS (
  SELECT *, contains(fails, f) AS hit, length(translate(fails, before, '')) < length(fails) AS gone FROM steps JOIN masks ON true
), counted AS (
  SELECT part, filter_order, step::INTEGER AS step, f,
         coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM applied GROUP BY ALL
)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
