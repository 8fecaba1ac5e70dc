"""Queries of the operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, hard_negatives, licenses, line_dedup, minhash, ngram_join, packing, pieces, quality, runs, sharding, simhash, token_files

TOKENIZER_WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER_BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER_WORDS, with_ids=False)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return shards.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL, with_ids=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score_documents(docs, classifier.fit_documents(docs, table(spark, sf_dir, "labels")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER_BYTES)
    return token_files.read_token_files(spark, path, manifest, with_ids=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), edit=True)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 50 == 0))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_sharding, op3_line_dedup, op4_quality_rules, op5_sentencepiece, op6_quality_classifier, op7_ngram_join, op8_simhash, op9_license_scans, op10_token_files, op11_periodic_runs, op12_hard_negatives, op13_minhash_dedup, pipeline]
    return {f.__name__: f for f in found}


def _license_sql() -> str:
    rows = ", ".join("('{}', '{}#{}', '{}')".format(name, name, k, text.replace("'", "''")) for name, texts in licenses.TEMPLATES.items() for k, text in enumerate(texts))
    norm = "trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')))"
    pairs = "CASE WHEN len(ws) = 1 THEN ws ELSE list_distinct([p[1] || ' ' || p[2] FOR p IN list_zip(ws[:-2], ws[2:])]) END"
    t = licenses.THRESHOLD
    return f"""
WITH templates(license, template, t_text) AS (VALUES {rows}),
t0 AS (SELECT license, template, string_split({norm.format('t_text')}, ' ') AS ws FROM templates),
t1 AS (SELECT license, template, {pairs} AS b FROM t0),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))),
u0 AS (SELECT doc_id, unit, {norm.format('t')} AS w FROM lines),
u1 AS (SELECT doc_id, unit, string_split(w, ' ') AS ws FROM u0 WHERE w <> ''),
u2 AS (SELECT doc_id, unit, {pairs} AS b FROM u1),
hits AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(u2.b, t1.b)) / (len(u2.b) + len(t1.b)) AS dice FROM u2 JOIN t1 ON len(u2.b) >= len(t1.b) * 0.5 AND len(u2.b) <= len(t1.b) * 2),
best AS (SELECT doc_id, count(DISTINCT unit) AS n_matches, min(struct_pack(d := -dice, l := license)) AS s FROM hits WHERE dice >= {t} GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, s.l AS license, round(-s.d, 6) AS dice FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN best USING (doc_id)"""


def _jaccard_sql(width: int, percent: int, kept: str = "") -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i : i + {width - 1}], ' ') FOR i IN range(1, len(ws) - {width - 2})]) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, md5(unnest(g)) AS h FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.m AS component_id{kept} FROM s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = s.doc_id"""


JACCARD_SQL = _jaccard_sql(ngram_join.SHINGLE, ngram_join.PERCENT)
MINHASH_SQL = _jaccard_sql(minhash.SHINGLE, minhash.PERCENT, ", s.doc_id = c.m AS kept")
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len([x FOR x IN embedding IF NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.e, b.e)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_join": JACCARD_SQL, "op9_license_scans": _license_sql(), "op12_hard_negatives": NEGATIVES_SQL, "op13_minhash_dedup": MINHASH_SQL}
