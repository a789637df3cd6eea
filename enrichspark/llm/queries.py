"""One query per operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from enrichspark.llm import align, decontaminate, embeddings, langid, lines, near, packing, pieces, quality, repeats, search, toxicity, warc
from enrichspark.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.dedup(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding))
    AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 END),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, least(min(b), a) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT d, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN best IS NULL OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM p LEFT JOIN b USING (d)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(table(spark, sf_dir, "documents"), texts=False)


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hot.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""

def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents")).drop("same")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), texts=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH fold AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), term) AS ts FROM documents, fold),
g AS (SELECT count(*) FILTER (len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), up, low), term)) AS t FROM benchmark, fold),
q AS (SELECT item_id, t, count(*) AS qtf FROM i GROUP BY item_id, t),
u AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM u WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(g.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * g.n) // g.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


QUERIES = {"op10_toxicity": op10_toxicity, "op9_minhash": op9_minhash, "op1_decontamination": op1_decontamination, "op2_packing": op2_packing, "op3_embedding_dedup": op3_embedding_dedup, "op4_repeats": op4_repeats, "op5_language_id": op5_language_id, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_line_dedup": op8_line_dedup, "op11_sentencepiece": op11_sentencepiece, "op12_alignment": op12_alignment, "op13_lexical_search": op13_lexical_search}
ORACLES = {"op3_embedding_dedup": OP3_SQL, "op7_warc": OP7_SQL, "op8_line_dedup": OP8_SQL, "op13_lexical_search": OP13_SQL}
