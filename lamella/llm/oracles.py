"""SQL (DuckDB) of the queries that it can express on whole tables."""

#: What parts words: the bytes 0x20 and 0x09-0x0D.
_WORDS = r"list_filter(string_split_regex({}, '[\x09-\x0D ]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM s),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM both_in JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_in.n >= 80 * (x.n + y.n - both_in.n)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN either e ON r.c = e.a),
least AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.c AS component_id, l.c = d.doc_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.c = l.a),
least AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, l.c AS component_id, l.c = e.vec_id AS kept
FROM embeddings e JOIN least l USING (vec_id)
"""

OP5 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {_USABLE}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i, w FROM d WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM starts),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later),
places AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
kept AS (
  SELECT p.doc_id, count(g.p) AS n, string_agg(p.word, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL) AS text
  FROM places p LEFT JOIN gone g USING (doc_id, p) GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

ORACLES = {"op1_minhash_near_dedup": OP1, "op2_embedding_near_dedup": OP2, "op5_exact_top_k": OP5, "op7_substring_dedup": OP7}
