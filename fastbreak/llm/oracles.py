"""SQL for DuckDB that gives the rows of registered queries, where SQL can express them: by comparing everything with
everything, or every window with every other."""

from __future__ import annotations

#: Cosines of all pairs of vectors of one length, and what can be reached by links from each smallest vector.
EMBEDDINGS = r"""
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
u AS (SELECT vec_id, len(e) AS size, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE e IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.size = b.size WHERE list_dot_product(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.node WHERE reach.seen < links.b)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = e.vec_id LEFT JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) ON node = e.vec_id"""

#: Every string of 50 bytes (as hex) with the smallest document that has it; runs of those to remove; what is between.
SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 49, 0))) AS i FROM d),
windows AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM starts),
least AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM windows JOIN least USING (s) WHERE first < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 OR row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 THEN 1 ELSE 0 END AS fresh FROM hit),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT c.doc_id, count(*) AS n, sum(b - a) AS gone, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

#: What conversations say, and the length of it with the template's marks and escapes.
CHAT = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
escaped AS (SELECT *, replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n') AS er, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS et FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""

#: Every window of 50 words with the smallest document that has it; the words in none that is to be removed.
PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS i, w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM starts),
least AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN least USING (x) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

ORACLE_SQL = {"op2_subspace_embeddings": EMBEDDINGS, "op4_suffix_array_dedup": SUBSTRINGS, "op6_prefix_tree_chat": CHAT, "op10_suffix_automaton_dedup": PASSAGES}
