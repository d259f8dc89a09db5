"""Registered queries of this subpackage and their DuckDB forms, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, fill_middle, html_wrapper, langid, linededup, ngram_join, packing, pii, quality, secrets, topk, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w
), f AS (SELECT doc_id, unnest(sh) AS g FROM s), hot AS (SELECT g FROM f GROUP BY g HAVING count(*) > 1),
c AS (SELECT f.doc_id, f.g FROM f JOIN hot USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * k >= 85 * (len(a.sh) + len(b.sh) - k)),
r AS (SELECT x AS doc_id, x AS to_id FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.to_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(to_id) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vid") % 100 == 0, k=10, scale=1024)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_file(), end_id=2, length=4096)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(read(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def fold(k: int, r: int) -> Column:
    """Whether a document is held out: crc32 of its id as text has remainder r by k."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % k == r, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~fold(3, 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(read(spark, sf_dir, "documents"), ~fold(4, 2))
    runs = F.array_join(F.transform("runs", lambda x: F.concat(x["lang"], F.lit(":"), x["words"].cast("string"))), ",")
    return out.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score", runs.alias("runs"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS g FROM d
), f AS (
  SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.features(read(spark, sf_dir, "documents"), ~fold(5, 0))
    out = quality.score(stats, quality.train(stats, read(spark, sf_dir, "labels")))
    return out.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings")).drop("verified")


def _op13_sql(rounds: int = 5) -> str:
    """Rounds are written out one after the other: recursion can't aggregate over the step before."""
    sql = """
WITH w AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c, e FROM w QUALIFY c < 40
)"""
    for i in range(rounds + 1):
        sql += f""", a{i} AS MATERIALIZED (
  SELECT r, vec_id, e, c, d FROM (SELECT w.r, w.vec_id, w.e, k.c, list_sum(list_transform(range(1, 65), lambda i: (w.e[i] - k.e[i]) * (w.e[i] - k.e[i]))) AS d FROM w, c{i} k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""
        if i < rounds:
            sql += f""", s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i}) GROUP BY c, j
), c{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.e, k.e) AS e FROM c{i} k LEFT JOIN (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS e FROM s{i} GROUP BY c) m ON m.c = k.c
)"""
    return sql + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_html_extraction": op6_html_extraction,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op2_exact_top_k": OP2_SQL, "op11_fill_in_middle": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
