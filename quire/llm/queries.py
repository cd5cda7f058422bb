"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import alignment, decontaminate, fixity, jaccard, langid, licences, mixing, neighbours, phrases, pipeline, sketches, tokens, toxicity, urls
from quire.llm.common import fold, table


def op1_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.train_rows(docs))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.predicted(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "coverage")


def op2_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.train_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(table(spark, sf_dir, "documents"))


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records against a replica of them with known damage: bits, lost, surplus and doubled records, cut payloads."""
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id")
    archive = F.floor(n / 1000).alias("archive")

    def records(rows: DataFrame, payload: Column) -> DataFrame:
        record = fixity.warc_record(F.col("url"), payload)
        return rows.select(archive, n.alias("key"), F.coalesce(F.octet_length(record), F.lit(0)).cast("long").alias("size"), fixity.leaf_hash(record).alias("hash"))

    damaged = F.when(n % 389 == 7, None).when(n % 97 == 13, F.translate("html", "<", "[")).when(n % 211 == 5, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html"))
    doubled = pages.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(n % 401 == 3, 2).otherwise(1))))
    bad = fixity.audit(records(pages.where(n % 307 != 11), F.col("html")), records(doubled, damaged))
    return bad.select(F.col("key").alias("page_id"), "archive", F.col("at").alias("seq"), "low", "high", "status")


OP7_SQL = """
WITH r AS (SELECT page_id, html, CAST(floor(page_id / 1000) AS BIGINT) AS archive, html IS NOT NULL AND page_id % 307 <> 11 AS pa, html IS NOT NULL AND page_id % 389 <> 7 AS pb,
  CASE WHEN page_id % 307 = 11 THEN 0 ELSE coalesce(48 + strlen(coalesce(url, '')) + 18 + length(CAST(strlen(html) AS VARCHAR)) + 4 + strlen(html) + 4, 0) END AS size FROM pages),
p AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY page_id) - 1 AS seq,
  sum(size) OVER (PARTITION BY archive ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS high FROM r)
SELECT page_id, archive, seq, CAST(high - size AS BIGINT) AS low, CAST(high AS BIGINT) AS high,
  CASE WHEN NOT pb THEN 'missing' WHEN NOT pa THEN 'extra' ELSE 'changed' END AS status
FROM p WHERE (pa AND NOT pb) OR (pb AND NOT pa)
  OR (pa AND pb AND ((page_id % 97 = 13 AND contains(html, '<')) OR (page_id % 97 <> 13 AND page_id % 211 = 5 AND html <> '') OR page_id % 401 = 3))
"""


def op8_nearest_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op10_jaccard_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op11_mine_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op13_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.components_of(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
u AS (SELECT id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM d),
v AS (SELECT *, row_number() OVER () AS i FROM u),
x AS (SELECT id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, row_number() OVER o AS nth FROM v WINDOW o AS (PARTITION BY id ORDER BY i)),
s AS (SELECT DISTINCT id, CASE WHEN w3 IS NOT NULL THEN w || ' ' || w2 || ' ' || w3 WHEN w2 IS NOT NULL THEN w || ' ' || w2 ELSE w END AS g FROM x WHERE w3 IS NOT NULL OR nth = 1),
n AS (SELECT d.id, d.doc_id, count(g) AS n FROM d LEFT JOIN s ON s.id = d.id GROUP BY ALL),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
e AS (SELECT a, b FROM shared JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
c AS (SELECT id, id AS at FROM d UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.at)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(o.doc_id) AS component_id, n.doc_id = min(o.doc_id) AS kept
FROM c JOIN n ON n.id = c.id JOIN n AS o ON o.id = c.at GROUP BY n.id, n.doc_id
"""


def queries() -> dict:
    return {"pipeline": pipeline.run} | {f.__name__: f for f in (op1_language_bitmasks, op2_decontaminate_cgk, op3_licence_sentences, op4_mix_sources, op5_toxic_segments, op6_token_counts, op7_merkle_audit, op8_nearest_ivf_pq, op9_url_language_models, op10_jaccard_chosen_path, op11_mine_collocations, op12_align_tokenizers, op13_sketch_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licence_sentences": licences.sql(),
        "op7_merkle_audit": OP7_SQL,
        "op9_url_language_models": urls.SQL,
        "op11_mine_collocations": phrases.SQL,
        "op13_sketch_near_duplicates": OP13_SQL,
    }
