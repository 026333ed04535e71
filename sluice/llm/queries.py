"""The registry of this subpackage's queries, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int) -> Column:
    """crc32(doc_id as text) mod `of`; 0 without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % of, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import langid

    docs = _table(spark, sf_dir, "documents")
    names, matrix = langid.train(docs.filter(remainder(4) != 2))
    return langid.predict(docs, names, matrix).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import quality

    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import topk

    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"))
    index = topk.Index(vectors)
    try:
        return index.search(vectors.filter(F.col("vec_id") % 100 == 0))
    finally:
        index.drop()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import substring

    return substring.digests(_table(spark, sf_dir, "documents"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import tiff

    return tiff.text_digests(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import hmm

    scored = hmm.score(_table(spark, sf_dir, "documents"), remainder(5) != 1)
    return scored.select("doc_id", (F.col("learnt") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import urlrules

    return urlrules.judge(_table(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import jaccard

    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import mixing

    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import whitening

    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import secrets

    return secrets.scan(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm import repair

    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")), F.col("present"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality, op3_exact_topk, op4_substring_dedup, op5_tiff, op6_best_fit_packing, op7_hmm_scores, op8_url_rules, op9_jaccard_join, op10_mixing, op11_whitening, op12_secrets, op13_conversation_repair)}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM d, unnest(range(1, len(ws) - 33)) AS t(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n >= 2
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM twice, range(0, 35) AS r(o)
), word AS (
  SELECT doc_id, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) AS t(p)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT a, y FROM reach JOIN e ON b = x
)
SELECT a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS place FROM documents
), w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
    ([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)])::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS caps,
    sum(weight) OVER (stop ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WINDOW stop AS (ORDER BY cap / weight, source IS NULL, source)
), g AS (
  SELECT *, caps + cap / weight * rest <= total AS stops, max(CASE WHEN caps + cap / weight * rest > total THEN (total - caps) / rest END) OVER () AS level FROM f
), t AS (
  SELECT source, source_size, CASE WHEN stops OR level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM g
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND upto + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


# Positions come from the lengths of what stands between the matches and of the matches before.
SECRETS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), p(kind, name, pattern, least, grp) AS (
  VALUES (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8, true),
    (1, 'access', 'AKIA[A-Z0-9]+', 16, false), (2, 'hex', '[0-9a-f]+', 32, false), (3, 'owned', '[A-Za-z0-9_-]{20,}', 20, false)
), cut AS (
  SELECT r, kind, grp, least, pattern, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gaps FROM d, p WHERE regexp_matches(t, pattern)
), each AS (
  SELECT r, kind, grp, least, pattern, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM cut
), placed AS (
  SELECT *, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS b, CASE WHEN grp THEN regexp_extract(m, pattern, 1) ELSE m END AS v FROM each WINDOW w AS (PARTITION BY r, kind ORDER BY i)
), base AS (
  SELECT r, kind, CAST(b AS BIGINT) AS b, CAST(b + length(m) AS BIGINT) AS e, v FROM placed WHERE kind < 3 AND length(v) >= least
), tokens AS (
  SELECT r, kind, CAST(b AS BIGINT) AS b, CAST(b + length(m) AS BIGINT) AS e, v FROM placed
  WHERE kind = 3 AND len(list_distinct(string_split(v, ''))) >= 12 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
), found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.r = t.r AND x.b < t.e AND t.b < x.e)
), copied AS (
  SELECT v FROM found JOIN d USING (r) GROUP BY v HAVING count(DISTINCT source) + max(CAST(source IS NULL AS INT)) > 2 AND count(DISTINCT t) > 2
), shown AS (
  SELECT r, kind, b, name || ':' || b || ':' || e AS s, v IN (SELECT v FROM copied) AS c FROM found JOIN p USING (kind)
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY b, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY b, kind) FILTER (kind < 3 OR NOT c), '') AS spans, count(*) FILTER (kind = 3 AND NOT c) AS n_owned,
  coalesce(string_agg(s, ',' ORDER BY b, kind) FILTER (kind < 3 AND c), '') AS copied
FROM d LEFT JOIN shown USING (r) GROUP BY r
"""

# One step of `way` is a turn: insertions, then the turn's own edit.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n)) AS t
), keyed AS (
  SELECT *, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k, dense_rank() OVER (ORDER BY conv_id) AS c FROM conversations
), hit AS (
  SELECT c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(k, lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM keyed, crc
), after AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS x(copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM after
), row AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM placed
), fault AS (
  SELECT *, last = '' AS blank, last <> '' AND seen AS duplicate, last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS truncated,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM row
), ins(before, mid, cost, edits, lines) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', e'user:
'), (1, 2, 3, 'I', e'user:
'), (3, 2, 3, 'I', e'user:
'),
    (2, 3, 3, 'I', e'assistant:
'), (0, 3, 6, 'II', e'user:
assistant:
'), (1, 3, 6, 'II', e'user:
assistant:
')
), own(mid, letter, initial, after, cost, role) AS (
  VALUES (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
    (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (3, 'R', NULL, 2, 3, 'user'), (2, 'R', NULL, 3, 3, 'assistant'),
    (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL)
), way AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS best FROM hit
  UNION ALL
  SELECT w.c, f.i, o.after, min({'cost': w.best.cost + n.cost + o.cost + CASE WHEN truncated AND letter <> 'D' THEN 3 ELSE 0 END, 'audit': w.best.audit || n.edits || letter,
    'lines': w.best.lines || n.lines || CASE WHEN letter = 'D' THEN '' ELSE coalesce(o.role, f.role) || ':' || text || e'
' END})
  FROM way w JOIN fault f ON f.c = w.c AND f.i = w.i + 1 JOIN ins n ON n.before = w.state JOIN own o ON o.mid = n.mid AND (letter = 'D' OR NOT blank AND NOT duplicate) AND (initial IS NULL OR initial = left(f.role, 1))
  GROUP BY w.c, f.i, o.after
), total AS (
  SELECT c, any_value(h.conv_id) AS conv_id FROM hit h GROUP BY c
), said AS (
  SELECT c, max(i) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM fault GROUP BY c
), last AS (
  SELECT w.c, min({'cost': best.cost + n.cost, 'audit': best.audit || n.edits, 'lines': best.lines || n.lines}) AS best
  FROM way w LEFT JOIN said s USING (c) JOIN ins n ON n.before = w.state AND (n.mid = 3 OR n.mid = 0) WHERE w.i = coalesce(s.n, 0) GROUP BY w.c
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(best.lines[:-2]) AS repaired_sha256
FROM total JOIN last USING (c) LEFT JOIN said USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": TOPK_SQL, "op4_substring_dedup": SUBSTRING_SQL, "op9_jaccard_join": JACCARD_SQL, "op10_mixing": MIXING_SQL, "op12_secrets": SECRETS_SQL, "op13_conversation_repair": REPAIR_SQL}
