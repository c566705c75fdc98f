"""DuckDB SQL for the queries that SQL can express, by query name."""

from .line_dedup import LONG_WORDS
from .quality_rules import NOTICES

op1_quality_rules = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1)
  GROUP BY rid
), l AS (
  SELECT rid, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS words,
         len(ls[i]) - len(replace(ls[i], '!', '')) AS bangs,
         len(ls[i]) - len(replace(ls[i], '|', '')) AS pipes,
         len(ls[i]) - len(regexp_replace(ls[i], '[#*$%&<>]', '', 'g')) AS junk
  FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d))
), f AS (
  SELECT rid, words,
         row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS dup,
         2 * junk >= words OR 2 * bangs >= words AS bad_punctuation,
         pipes >= 2 AND 5 * pipes >= words AS bad_navigation,
         {" OR ".join(f"contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{x}')" for x in NOTICES)} AS notice
  FROM l WHERE words > 0
), s AS (
  SELECT rid, count(*) AS n_lines, sum(dup::INT) AS n_dup_lines, sum(bad_punctuation::INT) AS n_bad_punctuation,
         sum(bad_navigation::INT) AS n_bad_navigation, sum((dup OR notice)::INT) AS n_bad_boilerplate,
         sum(CASE WHEN bad_punctuation OR bad_navigation OR dup OR notice THEN 0 ELSE words END) AS words_left
  FROM f GROUP BY rid
), a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad_punctuation, 0)::BIGINT AS n_bad_punctuation,
         coalesce(n_bad_navigation, 0)::BIGINT AS n_bad_navigation,
         coalesce(n_bad_boilerplate, 0)::BIGINT AS n_bad_boilerplate, coalesce(words_left, 0)::BIGINT AS words_left
  FROM d LEFT JOIN r USING (rid) LEFT JOIN s USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - words_left) <= 50 * n_words AS kept
FROM a
"""

op5_line_dedup = rf"""
WITH l AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, i, ls[i] AS line
        FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
              FROM (SELECT DISTINCT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))
), w AS (
  SELECT *, row_number() OVER o AS p, lead(line) OVER o AS l2, lead(line, 2) OVER o AS l3,
         lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3
  FROM l WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, p, [i, i2, i3] AS lines, line || chr(10) || l2 || chr(10) || l3 AS run FROM w WHERE l3 IS NOT NULL
  UNION ALL
  SELECT doc_id, p, [i] AS lines, line AS run FROM w WHERE words >= {LONG_WORDS}
), gone AS (
  SELECT DISTINCT doc_id, unnest(lines) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k FROM r) WHERE k > 1
), left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_removed,
       len(regexp_extract_all(coalesce(x.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words_left,
       md5(coalesce(x.text, '')) AS kept_md5
FROM documents d LEFT JOIN left_over x USING (doc_id) LEFT JOIN n USING (doc_id)
"""

op10_decontamination = rf"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\x20\x09-\x0D]', '', 'g'), '[^\x20\x09-\x0D]+') AS w FROM t
), s AS (
  SELECT DISTINCT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 'b' GROUP BY id),
f AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_found
  FROM s d JOIN s b ON d.kind = 'd' AND b.kind = 'b' AND d.s = b.s GROUP BY d.id, b.id
)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment
FROM f JOIN n USING (item_id) WHERE 100 * n_found >= 80 * n_item
"""

op8_near_dedup = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') AS s FROM w WHERE len(w) IN (1, 2)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a),
m AS (
  SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
  FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
), k AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS k FROM s GROUP BY doc_id)
SELECT m.doc_id, n_shingles, component_id, m.doc_id = component_id AS kept,
       CASE WHEN k IS NULL THEN m.doc_id ELSE min(m.doc_id) OVER (PARTITION BY k) END AS class_id
FROM m LEFT JOIN k USING (doc_id)
"""

op3_warc = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
         (instr('0123456789abcdef', hex[(5 * i) // 4 + 1]) - 1) * 16 + instr('0123456789abcdef', hex[(5 * i) // 4 + 2]) - 1
         >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""

op7_substring_dedup = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS first FROM x) WHERE doc_id > first
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

op2_mixing = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:8])::BIGINT AS b
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sidx FROM d GROUP BY source
), w AS (SELECT *, sidx % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), v AS (
  SELECT *, cap / weight AS ratio,
         (total - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT ratio AS r, sidx AS i, level AS l FROM v WHERE cap > weight * level ORDER BY ratio, sidx LIMIT 1
), t AS (
  SELECT v.*, CASE WHEN f.r IS NULL OR (ratio, sidx) < (f.r, f.i) THEN cap ELSE weight * f.l END::DOUBLE AS target,
         CASE WHEN source_size >= 8388608 THEN 2048 WHEN source_size < 8192 THEN 1
              ELSE list_max(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda x: x * 4096 <= source_size)) END::BIGINT AS words
  FROM v LEFT JOIN f ON true
), u AS (
  SELECT *, (source_size + words - 1) // words AS blocks, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3 * blocks, passes * blocks + floor((target - passes * source_size) / source_size * blocks + 0.5)::BIGINT) ELSE 0 END AS slots FROM u
), o AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, sum(slots) OVER ()::BIGINT AS n_all FROM n
), k AS (
  SELECT name, list(('0x' || md5(name || ':' || r)[1:8])::BIGINT ORDER BY r) AS keys
  FROM (SELECT unnest(range(1, 13)) AS r, name FROM (SELECT 'all' AS name UNION ALL SELECT sidx || ':' || p FROM o, (VALUES (0), (1), (2)) AS passes(p))) GROUP BY name
), q AS (SELECT sidx, blocks, first, n_all, unnest(range(0, slots::BIGINT)) AS q FROM o
), x AS (
  SELECT q.sidx,
         list_reduce(own.keys, lambda x, k: CASE WHEN md5(greatest(x, (k % blocks - x + blocks) % blocks) || ':' || k) >= '8' THEN (k % blocks - x + blocks) % blocks ELSE x END, q % blocks) AS block,
         list_reduce(everyone.keys, lambda x, k: CASE WHEN md5(greatest(x, (k % n_all - x + n_all) % n_all) || ':' || k) >= '8' THEN (k % n_all - x + n_all) % n_all ELSE x END, first + q) // 1024 AS shard
  FROM q JOIN k own ON own.name = q.sidx || ':' || (q // blocks) JOIN k everyone ON everyone.name = 'all'
), placed AS (
  SELECT d.*, o.sidx, words, sum(size) OVER (PARTITION BY o.sidx ORDER BY b, doc_id, size, rid ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source WHERE size > 0
), pieces AS (
  SELECT rid, sidx, block, least(start + size, (block + 1) * words) - greatest(start, block * words) AS part
  FROM (SELECT *, unnest(range((start // words)::BIGINT, ((start + size - 1) // words)::BIGINT + 1)) AS block FROM placed)
), taken AS (SELECT rid, sum(part)::BIGINT AS taken, count(DISTINCT shard) AS shards FROM pieces JOIN x USING (sidx, block) GROUP BY rid)
SELECT d.doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, 0)::BIGINT AS shards, d.source
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source LEFT JOIN taken USING (rid)
"""
