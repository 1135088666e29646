"""DuckDB statements for the training-data queries that SQL can express."""

from __future__ import annotations

#: Lower-cases A-Z only.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, grams.n FROM grams JOIN windows USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = rf"""
WITH lines AS (
  SELECT doc_id, p, parts[p] AS line, {_LOWER.format("trim(parts[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (k) GROUP BY doc_id
"""

#: CRC-32 by its definition, as DuckDB has no function for it: a table from the polynomial, then byte by byte.
OP1 = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
coded AS (
  SELECT doc_id, md5(text) AS d, CAST(strlen(text) + 8 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(text) + 1, 2),
      lambda i: CAST(concat('0x', substr(h, CAST(i AS INTEGER), 2)) AS BIGINT))),
      lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INTEGER) + 1]))) AS crc
  FROM bytes, crc_table),
placed AS (
  SELECT *, CAST(sum(size) OVER w AS BIGINT) - size AS start, row_number() OVER (ORDER BY d, doc_id NULLS FIRST) - 1 AS place,
    CAST(sum(size) OVER () AS BIGINT) AS total
  FROM coded WINDOW w AS (ORDER BY d, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
grouped AS (SELECT *, min(start) OVER (PARTITION BY d) AS g1, max(start + size) OVER (PARTITION BY d) AS g2 FROM placed),
held AS (
  SELECT k, k * total / CAST(24 AS DOUBLE) AS target, CASE WHEN small THEN g1 ELSE start END AS a,
    CASE WHEN small THEN g2 ELSE start + size END AS b
  FROM (SELECT *, least(k * total / CAST(24 AS DOUBLE) - g1, g2 - k * total / CAST(24 AS DOUBLE)) <= CAST(0.02 AS DOUBLE) * total / 24 AS small
        FROM grouped, range(1, 24) ks(k))
  WHERE start * 24 < k * total AND (start + size) * 24 >= k * total),
cuts AS (SELECT CASE WHEN target - a < b - target THEN a ELSE b END AS cut FROM held),
sharded AS (SELECT *, CAST((SELECT count(*) FROM cuts WHERE cut <= start) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""

_OP13_ROUND = """,
near{r} AS (
  SELECT rid, min(struct_pack(d := list_sum(list_transform(list_zip(kept.v, cent{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := cent{r}.c)) AS best
  FROM kept, cent{r} GROUP BY rid)"""
_OP13_MOVE = """,
sums{r} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n
  FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN near{r} USING (rid)) GROUP BY c, i),
cent{next} AS (
  SELECT c, coalesce(m, v) AS v FROM cent{r} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM sums{r} GROUP BY c) USING (c))"""
OP13 = """
WITH numbered AS (
  SELECT vec_id, embedding, row_number() OVER () AS rid FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
kept AS (SELECT vec_id, rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM numbered),
cent0 AS (
  SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS c, v FROM kept
  ORDER BY sha256(concat('1:', vec_id)), v LIMIT 16)""" + "".join(
    _OP13_ROUND.format(r=r) + _OP13_MOVE.format(r=r, next=r + 1) for r in range(3)) + _OP13_ROUND.format(r=3) + """,
sizes AS (SELECT best.c AS c, sum(best.d) AS s FROM near3 GROUP BY best.c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sizes.s AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(s) FROM sizes) AS BIGINT) AS inertia, sha256(array_to_string(cent3.v, ',')) AS centroid_sha256
FROM kept JOIN near3 USING (rid) JOIN cent3 ON best.c = cent3.c JOIN sizes USING (c)
"""

LLM_ORACLES: dict[str, str] = {"op1_shard_by_bytes": OP1, "op2_decontaminate": OP2, "op6_dedup_lines": OP6, "op13_centroids": OP13}
