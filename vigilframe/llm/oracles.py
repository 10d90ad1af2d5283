"""SQL (DuckDB) for the queries that SQL can express on whole tables at small sizes."""

from __future__ import annotations

from .substrings import WINDOW

_A, _a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_low = f"translate(coalesce(text, ''), '{_A}', '{_a}')"
_spaced = r"'[^\x20\x09-\x0D]+'"
_alnum = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low}, {_spaced}) AS w FROM documents), s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 2), ' ') END AS g FROM d, unnest(range(1, greatest(2, len(w) - 1))) t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id), l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 85 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node), m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

DECONTAMINATION = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_low}, {_alnum}) AS w FROM benchmark), bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, j, j + 9), ' ') AS g FROM i, unnest(range(1, greatest(2, len(w) - 8))) t(j) WHERE len(w) > 0),
 d AS (SELECT doc_id, regexp_extract_all({_low}, {_alnum}) AS w FROM documents), dw AS (SELECT doc_id, j, k, array_to_string(list_slice(w, j, j + k - 1), ' ') AS g FROM d, (SELECT DISTINCT k FROM bw) z, unnest(range(1, len(w) - k + 2)) t(j)),
 h AS (SELECT doc_id, j, k, item FROM dw JOIN bw USING (k, g)), p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(j, j + k)) t(q) GROUP BY doc_id), u AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id)"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_spaced}) AS w FROM documents), x AS (SELECT doc_id, j, array_to_string(list_slice(w, j, j + {WINDOW - 1}), ' ') AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) t(j)), f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g HAVING min(doc_id) < max(doc_id)),
 gone AS (SELECT DISTINCT doc_id, q FROM x JOIN f USING (g), unnest(range(j, j + {WINDOW})) t(q) WHERE first < doc_id), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Holds for pages without links to other hosts, as in the given tables: hosts then keep what their own pages' rules say.
URLS = r"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages), rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, q, v)),
 m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id), s AS (SELECT host, count(*) FILTER (WHERE v = 'allow') AS a, count(*) FILTER (WHERE v = 'block') AS b FROM p JOIN m USING (page_id) GROUP BY host), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM s)
 SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN b / tb > 2.0 * coalesce(a / nullif(ta, 0), 0) THEN 'block' ELSE 'allow' END AS verdict FROM p LEFT JOIN m USING (page_id) LEFT JOIN s USING (host), t"""

CHAT = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) t(a, b, c, d))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 32) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
 r AS (SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.node), m AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id) SELECT m.vec_id, coalesce(n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id"""


def _rounds(n: int) -> str:
    """Assignments a0 to an and codebooks b0 to bn of n rounds; b holds (pos, k, c), c an entry's integers."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, label, pos, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM
   (SELECT vec_id, label, x.pos, p, k, list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{i} b ON b.pos = x.pos)
   GROUP BY vec_id, label, pos, p)""")
        if i < n:
            out.append(f"""m{i} AS MATERIALIZED (SELECT pos, k, list(f ORDER BY i) AS c FROM
   (SELECT pos, k, i, CAST(floor(sum(p[i]) / count(*)) AS BIGINT) AS f FROM a{i}, range(1, 17) t(i) GROUP BY pos, k, i) GROUP BY pos, k)""")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT b.pos, b.k, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.pos = b.pos AND m.k = b.k)")
    return ",\n ".join(out)


#: For vectors of 64 components with distinct vec_ids.
CODES = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
 x AS MATERIALIZED (SELECT vec_id, label, pos, w[16 * pos + 1:16 * pos + 16] AS p FROM v, range(4) t(pos)),
 b0 AS MATERIALIZED (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS k, p AS c FROM x QUALIFY k < 256),
 {_rounds(4)},
 s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, k)) AS codebooks_sha256 FROM b4),
 r AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, s"""

#: crc32 by bytes and bits: a list of a digit's code + 256 and eight zeros each is folded.
_crc = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
   lambda y: [ascii(y) + 256, 0, 0, 0, 0, 0, 0, 0, 0]))), lambda a, y: CASE WHEN y >= 256 THEN xor(a, y - 256) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""

TRIE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, octet_length(encode(coalesce(text, ''))) AS n_bytes,
   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations),
 c AS (SELECT conv_id, CAST({_crc} AS BIGINT) % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM conversations)),
 z AS (SELECT c.conv_id, 0 AS part, place, g, n_bytes FROM c JOIN t ON t.conv_id = c.base AND place <= h UNION ALL SELECT c.conv_id, 1, place, g, n_bytes FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS d, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY part, place) AS k FROM z),
 p AS MATERIALIZED (SELECT conv_id, d, k, n_bytes FROM n UNION ALL SELECT conv_id, 0, '', 0 FROM c), l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
 o AS MATERIALIZED (SELECT d, k, min(p.conv_id) AS rep, count(*) AS n, any_value(n_bytes) AS n_bytes, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE d = len) AS ends FROM p JOIN l USING (conv_id) GROUP BY d, k),
 u AS MATERIALIZED (SELECT o.*, q.rep AS parent FROM o LEFT JOIN p a ON a.conv_id = o.rep AND a.d = o.d - 1 LEFT JOIN o q ON q.d = a.d AND q.k = a.k), k AS MATERIALIZED (SELECT d - 1 AS d, parent AS rep, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
 s AS (SELECT a.d, a.k, sum((u.n - 1) * u.n_bytes) AS saved, count(*) FILTER (WHERE k.rep IS NULL) AS leaves FROM u JOIN p a ON a.conv_id = u.rep AND a.d <= u.d LEFT JOIN k ON k.rep = u.rep AND k.d = u.d GROUP BY a.d, a.k)
 SELECT u.rep AS conv_id, CAST(u.d AS BIGINT) AS depth, u.parent AS parent_conv_id, u.n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
 FROM u JOIN s ON s.d = u.d AND s.k = u.k LEFT JOIN k ON k.rep = u.rep AND k.d = u.d"""
