"""SQL twins of the training-data queries."""

MANIFEST = r"""
WITH RECURSIVE step(k, i, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT k, i + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM step WHERE i = 8),
d AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS row_no,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 7 = 0,
      false) AS hit
  FROM documents, crc),
w AS (
  SELECT d.*, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM d),
leaf AS (
  SELECT doc_id, lang, row_no,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + hit::INT)::VARCHAR) || ':'
      || (n_chars + hit::INT) END || tail) AS changed FROM w),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS pos FROM leaf),
tree(h, lang, i, d, n) AS (
  SELECT 0, lang, pos, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL SELECT h + 1, lang, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tree
    WHERE n > 1 GROUP BY h, lang, i // 2),
sub AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang::BLOB NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
top(h, i, d, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM sub
  UNION ALL SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM top
    WHERE n > 1 GROUP BY h, i // 2),
steps AS (
  SELECT p.row_no, t.h, (p.pos >> t.h) % 2 AS side, s.d AS other FROM placed p
  JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.i = p.pos >> t.h AND t.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.h = t.h AND s.i = xor(t.i, 1)
  UNION ALL
  SELECT p.row_no, 100 + t.h, (b.pos >> t.h) % 2, s.d FROM placed p JOIN sub b ON b.lang IS NOT DISTINCT FROM p.lang
  JOIN top t ON t.i = b.pos >> t.h AND t.n > 1 LEFT JOIN top s ON s.h = t.h AND s.i = xor(t.i, 1)),
proof AS (
  SELECT row_no, sha256(coalesce(string_agg(other, '' ORDER BY h), '')) AS proof_sha256,
    list({'side': side, 'other': coalesce(other, '')} ORDER BY h) AS path FROM steps GROUP BY row_no),
fold(row_no, k, d, path) AS (
  SELECT p.row_no, 0, p.changed, coalesce(f.path, []) FROM placed p LEFT JOIN proof f USING (row_no)
  UNION ALL SELECT row_no, k + 1, CASE WHEN path[k + 1].side = 1 THEN sha256(path[k + 1].other || d)
    ELSE sha256(d || path[k + 1].other) END, path FROM fold WHERE k < len(path)),
root AS (SELECT d AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, b.subroot, r.root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, x.d AS folded_root,
  x.d = r.root AS verified
FROM placed p JOIN sub b ON b.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root r
JOIN fold x ON x.row_no = p.row_no AND x.k = len(x.path) LEFT JOIN proof f ON f.row_no = p.row_no
"""

# words of a text (runs without white space), rows numbered so that equal ids stay apart
_WORDS = r"""
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SIMILAR = f"""
WITH RECURSIVE d AS MATERIALIZED ({_WORDS.format(text=_LOWER)}),
s AS MATERIALIZED (
  SELECT DISTINCT row_no, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS t
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT row_no, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.row_no AS a, y.row_no AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.row_no <> y.row_no GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n p ON p.row_no = a JOIN n q ON q.row_no = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM d LEFT JOIN n USING (row_no) LEFT JOIN reach r ON r.a = d.row_no LEFT JOIN d o ON o.row_no = r.b
GROUP BY d.row_no, d.doc_id, n.n
"""

PASSAGES = f"""
WITH d AS MATERIALIZED ({_WORDS.format(text="coalesce(text, '')")}),
wins AS MATERIALIZED (
  SELECT row_no, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS t
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_id AS (SELECT t, min(doc_id) AS m FROM wins GROUP BY 1),
bad AS (SELECT row_no, i FROM wins JOIN least_id USING (t) WHERE doc_id > m),
word AS (SELECT row_no, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
marked AS (
  SELECT word.*, coalesce(i - max(bad.i) OVER (PARTITION BY row_no ORDER BY i) < 50, false) AS gone
  FROM word LEFT JOIN bad USING (row_no, i)),
kept AS (SELECT row_no, count(*) FILTER (gone) AS r, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM marked GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_no)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings),
ok AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.row_no AS a, b.row_no AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.row_no <> b.row_no
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1),
c AS (SELECT v.row_no, least(v.vec_id, min(o.vec_id)) AS c FROM v LEFT JOIN reach r ON r.a = v.row_no
      LEFT JOIN v o ON o.row_no = r.b GROUP BY v.row_no, v.vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id IS NOT DISTINCT FROM c AS kept
FROM v JOIN c USING (row_no) LEFT JOIN n ON n.a = v.row_no
"""
