"""DuckDB SQL of the same meaning, where SQL can express the operator."""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

OP11 = r"""
WITH words AS (
  SELECT doc_id, k, unnest(terms) AS term FROM (
    SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents)
), tfs AS (
  SELECT doc_id, k, term, count(*) AS tf FROM words GROUP BY ALL
), lens AS (
  SELECT k, count(*) AS n FROM words GROUP BY k
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lens
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, total GROUP BY term, docs
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, doc_id, k, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total.terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN lens USING (k), total GROUP BY item_id, doc_id, k
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 50
"""

#: The lattice row by row: the least (cost, audit) of each state after a row, from that before it by inserts and one edit.
OP13 = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(n))
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS k
  FROM conversations, crc
), e AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE k <> 0
), f AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS s,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS z
  FROM e
), g AS (
  SELECT *, CASE WHEN z = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(s) OVER (PARTITION BY conv_id ORDER BY i) || s AS pair
  FROM f
), ins(q, p, ic, ia, io) AS (VALUES
  (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), edit(p, s, letter, r, ec, role2) AS (VALUES
  (0, 's', 'K', 1, 0, NULL), (0, 'u', 'K', 2, 0, NULL), (1, 'u', 'K', 2, 0, NULL), (3, 'u', 'K', 2, 0, NULL), (2, 'a', 'K', 3, 0, NULL),
  (0, NULL, 'R', 2, 1, 'user'), (1, NULL, 'R', 2, 1, 'user'), (3, NULL, 'R', 2, 1, 'user'), (2, NULL, 'R', 3, 1, 'assistant'),
  (0, NULL, 'D', 0, 2, NULL), (1, NULL, 'D', 1, 2, NULL), (2, NULL, 'D', 2, 2, NULL), (3, NULL, 'D', 3, 2, NULL)
), walk(conv_id, i, q, c, a, o) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM g
  UNION ALL
  SELECT conv_id, i, q, c, a, o FROM (
    SELECT w.conv_id, g.i, edit.r AS q, w.c + ic + ec + CASE WHEN fault = 't' AND letter <> 'D' THEN 5 ELSE 0 END AS c, w.a || ia || letter AS a,
      list_concat(w.o, io, CASE letter WHEN 'D' THEN [] ELSE [coalesce(role2, g.role) || ':' || g.text] END) AS o
    FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1 JOIN ins USING (q)
      JOIN edit ON edit.p = ins.p AND (edit.s IS NULL OR edit.s = g.s) AND (letter = 'D' OR fault NOT IN ('b', 'd'))
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, edit.r ORDER BY w.c + ic + ec + CASE WHEN fault = 't' AND letter <> 'D' THEN 5 ELSE 0 END, w.a || ia || letter) = 1
  )
), last AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id
), best AS (
  SELECT w.conv_id, w.c + ic AS c, w.a || ia AS a, list_concat(w.o, io) AS o, last.*
  FROM walk w JOIN last ON last.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = last.n JOIN ins USING (q) WHERE ins.p IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.c + ic, w.a || ia) = 1
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(c, 0) AS BIGINT) AS cost, coalesce(a, '') AS audit,
  sha256(coalesce(array_to_string(o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE = {"op1_minhash_dedup": OP1, "op3_exact_topk": OP3, "op11_lexical_search": OP11, "op13_conversation_repair": OP13}
