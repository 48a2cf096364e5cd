"""DuckDB SQL of the queries whose results SQL can express: each states the contract plainly, without the query's method."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components of the links (a, b), over nodes (id): the smallest id that is reachable, itself included.
REACHED = """
 both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reached AS (SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reached r JOIN both_ways l ON l.a = r.id WHERE r.root < l.b),
 component AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)"""

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM
   (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
 nodes AS (SELECT doc_id AS id FROM documents), {REACHED}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM component JOIN documents ON doc_id = id LEFT JOIN sizes USING (doc_id)"""

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 sized AS (SELECT item_id, w, least(len(w), 10) AS width FROM item WHERE len(w) > 0),
 wanted AS (SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS words FROM
   (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM sized)),
 widths AS (SELECT DISTINCT width FROM wanted),
 windows AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS words FROM
   (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc JOIN widths ON len(w) >= width)),
 found AS (SELECT doc_id, item_id, width, i FROM windows JOIN wanted USING (width, words)),
 hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS place FROM found) GROUP BY doc_id),
 of_doc AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(of_doc.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN of_doc USING (doc_id)"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
   WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
   AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.93),
 nodes AS (SELECT vec_id AS id FROM embeddings), {REACHED},
 degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept
FROM component LEFT JOIN degree USING (id)"""

CHAT = r"""
WITH own AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
 rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -1, 0, 'user', text FROM own UNION ALL SELECT -1, 1, 'assistant', text FROM own),
 said AS (SELECT conv_id, count(*) AS n_turns,
   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
   bool_or(regexp_matches(text, '<\|im_(start|end)\|>|<\\+\|')) AS escapes,
   sum(len(regexp_extract_all(text, '<\\*\|'))) AS marks,
   sum(length(role) + length(text) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))) AS chars
   FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(chars + CASE WHEN escapes THEN marks ELSE 0 END AS BIGINT) AS formatted_chars
FROM said"""

SEARCH = f"""
WITH term AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents) WHERE len(w) > 0),
 total AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS words FROM term),
 posting AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf FROM term GROUP BY doc_id, t),
 weighed AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM posting, total GROUP BY t, docs),
 asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)),
 scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
   FROM asked JOIN posting USING (t) JOIN weighed USING (t), total GROUP BY item_id, doc_id),
 placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""
