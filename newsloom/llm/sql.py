"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from newsloom.llm import dialogue, mixing

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# Letters A-Z alone are lower-cased.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard(table: str = "documents", percent: int = 75, width: int = 5) -> str:
    """Every pair of texts that share a shingle is counted; components by passing on least labels."""
    return f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(_LOWER)} AS w FROM {table}
),
sets AS (
  SELECT rid, doc_id, CASE
    WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2),
      lambda i: array_to_string(w[i : i + {width - 1}], ' '))) END AS s
  FROM texts
),
classes AS (
  SELECT dense_rank() OVER (ORDER BY list_sort(s)) AS class, rid, doc_id, s FROM sets WHERE len(s) > 0
),
distinct_sets AS (SELECT class, any_value(s) AS s FROM classes GROUP BY class),
tokens AS (SELECT class, len(s) AS n, unnest(s) AS t FROM distinct_sets),
pairs AS (
  SELECT a.class AS a, b.class AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.class <> b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
),
reach AS (
  SELECT class AS a, class AS b FROM distinct_sets
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
),
least AS (SELECT class, min(doc_id) AS doc_id, count(*) AS n FROM classes GROUP BY class),
named AS (SELECT reach.a AS class, min(least.doc_id) AS component_id FROM reach JOIN least ON reach.b = least.class GROUP BY reach.a)
SELECT classes.doc_id, CAST(len(classes.s) AS BIGINT) AS n_shingles, named.component_id, least.n AS n_copies
FROM classes JOIN named USING (class) JOIN least USING (class)
UNION ALL
SELECT doc_id, 0, doc_id, 1 FROM sets WHERE len(s) = 0
"""


def rotation(table: str = "conversations", part: int = dialogue.PART) -> str:
    head = f"""CASE WHEN t.speaker = p.speaker THEN 'assistant' WHEN t.speaker = '{dialogue.SYSTEM}'
      THEN '{dialogue.SYSTEM}' ELSE '{dialogue.NAMED}' || t.speaker END"""
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS text
  FROM {table}
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS place FROM turns
),
people AS (SELECT DISTINCT conv_id, speaker FROM turns WHERE speaker <> '{dialogue.SYSTEM}'),
pieces AS (
  SELECT p.conv_id, p.speaker, t.place // {part} AS part, t.place, t.speaker = p.speaker AS mine,
    '{dialogue.OPEN}' || {head} || '{dialogue.CLOSE.strip()}' || chr(10) AS head,
    t.text || '{dialogue.END.strip()}' || chr(10) AS body
  FROM people p JOIN placed t ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
spans AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY place)
    - length(body) AS start FROM pieces
)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns,
  string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(start || ':' || length(body), ' ' ORDER BY place) FILTER (WHERE mine), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS INTEGER) AS trained
FROM spans GROUP BY conv_id, speaker, part
"""


def mixture(table: str = "documents", share: float = mixing.SHARE, most: int = mixing.MOST_COPIES) -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return f"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len({_WORDS.format("text")}), 0) AS BIGINT) AS size,
    md5(concat_ws('|', '{mixing.SEED}', CAST(doc_id AS VARCHAR), text)) AS k
  FROM {table}
),
sources AS (SELECT source, sum(size) AS s FROM docs GROUP BY source),
weighed AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END AS w
  FROM sources
),
-- Sources fill up by falling weight per own word; before each, what is left is shared by weight.
levels AS (
  SELECT *, ({share} * sum(s) OVER () - {most} * (sum(s) OVER o - s)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM weighed WINDOW o AS (ORDER BY s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
final AS (
  SELECT level FROM levels WHERE level * w <= {most} * s ORDER BY s / w, source NULLS LAST LIMIT 1
),
targets AS (
  SELECT source, CAST(s AS BIGINT) AS s, least({most} * s, w * (SELECT level FROM final)) AS raw
  FROM levels
),
aims AS (
  SELECT source, s, coalesce(raw, {most} * s) AS target,
    CASE WHEN s = 0 THEN 0 ELSE CAST(least({most}, floor(coalesce(raw, {most} * s) / s + 1e-9)) AS BIGINT) END AS whole
  FROM targets
),
units AS (SELECT source, k, sum(size) AS size FROM docs WHERE size > 0 GROUP BY source, k),
placed AS (SELECT source, k, sum(size) OVER (PARTITION BY source ORDER BY k) - size / 2.0 AS middle FROM units)
SELECT d.doc_id, d.size, a.s AS source_size, round(a.target, 6) AS target,
  CAST(d.size * c.copies AS BIGINT) AS taken, c.copies
FROM docs d JOIN aims a ON a.source IS NOT DISTINCT FROM d.source
LEFT JOIN placed p ON p.source IS NOT DISTINCT FROM d.source AND p.k = d.k,
LATERAL (SELECT CAST(CASE WHEN d.size = 0 THEN 0 ELSE least({most}, a.whole
  + CASE WHEN a.target - a.whole * a.s > 0 AND p.middle <= a.target - a.whole * a.s THEN 1 ELSE 0 END) END AS INTEGER) AS copies) c
"""


def clusters(table: str = "embeddings", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """One pair of queries a round: all distances to all centroids, then exact floors of means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS (
  SELECT kept.rid, c{r}.c, CAST(list_sum(list_transform(range(1, {dims + 1}),
    lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i]))) AS BIGINT) AS d FROM kept, c{r}
),
a{r} AS (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (
    SELECT a{r}.c, i, CAST(sum(kept.v[i]) AS BIGINT) AS s, count(*) AS n
    FROM a{r} JOIN kept USING (rid), range(1, {dims + 1}) AS places(i) GROUP BY a{r}.c, i)
),
c{r + 1} AS (
  SELECT c{r}.c, coalesce(means.v, c{r}.v) AS v
  FROM c{r} LEFT JOIN (SELECT c, list(m ORDER BY i) AS v FROM m{r} GROUP BY c) means ON means.c = c{r}.c
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM {table}
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v
  FROM kept QUALIFY c < {k}
),{",".join(steps)}
SELECT kept.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} f ON f.c = a.c
"""


def hard_negatives(table: str = "embeddings") -> str:
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, r.rid, r.vec_id, r.label = a.label AS alike,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 100 = 0 AND a.rid <> r.rid AND len(a.v) = len(r.v) AND len(a.v) > 0
),
positives AS (
  SELECT anchor, rid, vec_id, score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT s.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.alike
  AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""


def near_duplicates(table: str = "documents") -> str:
    return f"""
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept, n_copies
FROM ({jaccard(table, 80, 4)})
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_jaccard": jaccard(),
        "op5_dialogue": rotation(),
        "op10_mixing": mixture(),
        "op11_centroids": clusters(),
        "op12_negatives": hard_negatives(),
        "op13_minhash": near_duplicates(),
    }
