"""SQL of queries whose results SQL can say."""

from __future__ import annotations

HEX_BYTES = "list_transform(regexp_extract_all(hex({0}), '..'), lambda h: CAST(concat('0x', h) AS BIGINT))"

#: The table of the byte-wise CRC-32, from its polynomial.
CRC_TABLE = (
    "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), "
    "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"
)


def crc32(text: str) -> str:
    step = "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {HEX_BYTES.format(text)}), {step}), 4294967295)"


def counted(value: str) -> str:
    return f"coalesce(concat(strlen(CAST({value} AS VARCHAR)), ':', CAST({value} AS VARCHAR)), '-')"


SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LEAF = "sha256(concat({}, {}, {}, {}, {}))".format(*[counted(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
LOW_LEAF = "sha256(concat({}, {}, {}, {}, {}))".format(*[counted(c) for c in ("doc_id", "source", "lang", "n_chars", SMALL)])

# nodes: every node of the trees of the sources (tree 's' and the source) and of the tree over them (tree 'r').
OP11 = f"""
WITH RECURSIVE {CRC_TABLE}, leaves AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(concat('s', source), 'n') AS tree, {LEAF} AS leaf,
         CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {LOW_LEAF} ELSE {LEAF} END AS shown
  FROM documents, crc_table
), below AS (
  SELECT tree, 0 AS level, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS cnt, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 16, (cnt + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)), NULL
  FROM below WHERE cnt > 1 GROUP BY tree, level, idx // 16, cnt
), subroots AS (SELECT tree, level, digest FROM below WHERE cnt = 1), above AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS cnt, digest, tree FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (cnt + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)), NULL
  FROM above WHERE cnt > 1 GROUP BY level, idx // 16, cnt
), steps AS (
  SELECT b.tree, b.level, b.idx, coalesce(string_agg(o.digest, '' ORDER BY o.idx) FILTER (o.idx < b.idx), '') AS l,
         coalesce(string_agg(o.digest, '' ORDER BY o.idx) FILTER (o.idx > b.idx), '') AS r
  FROM below b JOIN below o ON b.tree = o.tree AND b.level = o.level AND b.idx // 16 = o.idx // 16
  WHERE b.cnt > 1 GROUP BY b.tree, b.level, b.idx
  UNION ALL
  SELECT 'r', b.level, b.idx, coalesce(string_agg(o.digest, '' ORDER BY o.idx) FILTER (o.idx < b.idx), ''),
         coalesce(string_agg(o.digest, '' ORDER BY o.idx) FILTER (o.idx > b.idx), '')
  FROM above b JOIN above o ON b.level = o.level AND b.idx // 16 = o.idx // 16
  WHERE b.cnt > 1 GROUP BY b.level, b.idx
), walk AS (
  SELECT l.n, l.tree AS tree, b.level, b.idx, l.shown AS cur, '' AS proof FROM leaves l JOIN below b USING (n)
  UNION ALL
  SELECT w.n, CASE WHEN s.tree IS NULL THEN 'r' ELSE w.tree END, CASE WHEN s.tree IS NULL THEN 0 ELSE w.level + 1 END,
         CASE WHEN s.tree IS NULL THEN a.idx ELSE w.idx // 16 END,
         CASE WHEN s.tree IS NULL THEN w.cur ELSE sha256(concat(s.l, w.cur, s.r)) END, concat(w.proof, s.l, s.r)
  FROM walk w LEFT JOIN steps s ON w.tree = s.tree AND w.level = s.level AND w.idx = s.idx
  LEFT JOIN above a ON a.tree = w.tree WHERE s.tree IS NOT NULL OR w.tree <> 'r'
), ends AS (SELECT n, arg_max(cur, level) AS folded_root, arg_max(proof, level) AS proof FROM walk WHERE tree = 'r' GROUP BY n),
root AS (SELECT digest AS root FROM above WHERE cnt = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN ends USING (n) JOIN subroots s ON s.tree = l.tree, root
"""

TEXT_BITS = "CAST(concat('0x', substr(sha256({0}), 1, 15)) AS BIGINT)"

# probes: the starts of all non-empty buckets of each round; a splitter takes the first round within tolerance.
OP12 = f"""
WITH {CRC_TABLE}, docs AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size, CAST({crc32('text')} AS BIGINT) AS text_crc32,
         ({TEXT_BITS.format("coalesce(text, '')")} & -16777216) | ({TEXT_BITS.format('CAST(doc_id AS VARCHAR)')} & 16777215) AS key
  FROM documents, crc_table
), counts AS (
  SELECT s, key >> s AS b, sum(size) AS n FROM docs, (VALUES (44), (36), (28), (20), (12), (4), (0)) shifts(s) GROUP BY ALL
), probes AS (
  SELECT s, b << s AS key, sum(n) OVER (PARTITION BY s ORDER BY b) - n AS below FROM counts
  UNION ALL SELECT s, (max(b) + 1) << s, sum(n) FROM counts GROUP BY s
), goals AS (
  SELECT i, share * i AS goal, share * 0.005 AS tolerance FROM range(1, 24) r(i), (SELECT CAST(sum(size) AS DOUBLE) / 24 AS share FROM docs)
), nearest AS (
  SELECT i, s, tolerance, min({{'miss': abs(below - goal), 'below': below, 'key': key}}) AS best FROM goals, probes GROUP BY ALL
), splitters AS (
  SELECT i, arg_max(best.key, CASE WHEN best.miss <= tolerance THEN s + 1 ELSE -s END) AS cut FROM nearest GROUP BY i
), placed AS (SELECT docs.*, (SELECT count(*) FROM splitters WHERE cut <= key) AS shard FROM docs)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

NEAREST = """
near{0} AS (
  SELECT n, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (
    SELECT n, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - z[i]) * (v[i] - z[i]))) AS d FROM kept, centroids{0}
  ) GROUP BY n
)"""
ROUND = """{1}, centroids{2} AS (
  SELECT c, coalesce(list(q ORDER BY i) FILTER (q IS NOT NULL), any_value(z)) AS z FROM centroids{0} LEFT JOIN (
    SELECT c, i, (s - ((s % m) + m) % m) // m AS q FROM (
      SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS m FROM near{0} JOIN kept USING (n), range(1, 65) r(i) GROUP BY c, i
    )
  ) USING (c) GROUP BY c
)"""

OP13 = f"""
WITH kept AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), centroids0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (
    SELECT sha256(concat('1:', vec_id)) AS h, v FROM kept ORDER BY h, v LIMIT 16)
), {', '.join(ROUND.format(i, NEAREST.format(i), i + 1) for i in range(3))}, {NEAREST.format(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM near3 JOIN kept USING (n) JOIN centroids3 USING (c)
"""

# levels: caps in order of cap by weight; the first source above its part at its level sets the level of the rest.
OP9 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, source, md5(coalesce(text, '')) AS mark,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(0.1 + 0.9 * (1 - length(regexp_replace(text, '[\p{L}\p{M} ]+', '', 'g')) / greatest(length(text), 1)), 0.1) AS quality
  FROM documents
), keys AS (
  SELECT *, -ln((CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', mark, '|')), 1, 12)) AS BIGINT) + 1)
                / 281474976710658.0) / CAST(quality AS DOUBLE) AS e FROM docs
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM docs GROUP BY source
), caps AS (
  SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM sizes
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes) * 1.5 - coalesce(sum(cap) OVER before, 0))
            / ((SELECT sum(w) FROM sizes) - coalesce(sum(w) OVER before, 0)) AS level
  FROM caps WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_free AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM levels WHERE level * w <= cap), goals AS (
  SELECT l.source, l.source_size, CAST(CASE WHEN f.k IS NULL OR l.k < f.k THEN l.cap ELSE least(l.cap, f.level * l.w) END AS DOUBLE) AS target
  FROM levels l LEFT JOIN first_free f ON true
), sums AS (
  SELECT keys.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY keys.source ORDER BY e, doc_id, mark) AS upto
  FROM keys JOIN goals g ON keys.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN epochs < 2 AND upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sums
"""
