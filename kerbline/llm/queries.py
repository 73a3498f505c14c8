"""The corpus queries by name: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, license_scan, line_dedup, merkle, mixing, packing, pii, sentence_pieces, simhash, spelling, substring_dedup, topk
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.pmod("id", F.lit(50)) == 0), vectors, k=5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_blocks", "text")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled, mixing.TARGETS)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.vectors(table(spark, sf_dir, "embeddings"))
    return ann.nearest(rows, F.pmod("id", F.lit(20)) == 0, k=20)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(7)) == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=odd)
    verified = F.col("folded_root") == F.col("root")
    return found.select("doc_id", "leaf", "subroot", "root", merkle.digest(F.col("proof")).alias("proof_sha256"), "folded_root", verified.alias("verified"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_pieces.round_trip(table(spark, sf_dir, "documents"))
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


ORACLE: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op3_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op11_spelling_variants": spelling.oracle(),
    "op12_merkle_manifest": merkle.oracle(),
}


def registry() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
