"""DuckDB SQL for the queries that SQL can express.

Not here: tokenizers (1, 5, 7), hashed language and quality models (4, 9), the
notice scan (3) and the connected components of near copies (6); their tests hold
them against brute force.
"""

from __future__ import annotations

from .source_mix import MOST, SEED, WEIGHTS
from .url_filters import rules_table

WORD = r"[^\x20\x09-\x0D]+"

TOPK = """
WITH raw AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM raw q JOIN raw c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

HARD = """
WITH raw AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id AS vec_id, a.label = c.label AS alike,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM raw a JOIN raw c ON a.vec_id % 100 = 0 AND c.r <> a.r),
positives AS (
  SELECT * FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) <= 5),
hits AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.vec_id NULLS LAST) AS k
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.alike
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hits WHERE k <= 5
"""

MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS salt FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
  FROM d GROUP BY source),
c AS (SELECT *, source_size * {MOST} AS cap FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT source, source_size, least(max(level) OVER () * weight, CAST(cap AS DOUBLE)) AS target,
         CAST(('0x' || substr(md5('{SEED}/' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, t.start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY size, salt, doc_id) AS DOUBLE) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(each * place + start) - floor(each * (place - 1.0::DOUBLE) + start), {MOST}) AS BIGINT) * size AS taken
FROM p
"""


def _url_sql() -> str:
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = ", ".join("('" + "', '".join(x.replace("'", "''") for x in (rule, action, pattern)) + f"', {level}, {length})"
                       for rule, action, pattern, level, length, _ in rules_table())
    return f"""
WITH rules(rule, action, pattern, level, length) AS (VALUES {values}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
hits AS (
  SELECT n, rule, action, level, row_number() OVER (PARTITION BY n ORDER BY level DESC, length DESC, rule DESC) AS r
  FROM numbered JOIN rules ON regexp_matches(CASE WHEN level = 1 THEN host || path ELSE {lower.format("host || path")} END, pattern))
SELECT page_id, host, path, CASE WHEN level = 1 THEN rule END AS rule, coalesce(action, 'allow') AS verdict
FROM numbered LEFT JOIN hits ON numbered.n = hits.n AND hits.r = 1
"""


ORACLE_SQL: dict[str, str] = {"op2_bit_sliced_topk": TOPK, "op13_hard_negatives": HARD, "op8_source_mix": MIX, "op10_url_filters": _url_sql()}
