"""The queries opN_<name> and `pipeline` over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, cuckoo, language, mixing, pseudonyms, repeats, sharding, simhash, toxicity
from .common import table

KEY = b"demonstration key"
WEIGHTS = [5.0, 2.0, 1.0]
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    cells = [sharding.log2_cell(F.col("n_chars"), 5), sharding.hash_cell(F.col("lang"), 5), sharding.hash_cell(F.col("source"), 5)]
    out = sharding.hilbert_shards(rows, cells, bits=5, order=["doc_id", "text_crc32", "size"], n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4, lanes=1)


def _share(id_col: str, modulus: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_share("doc_id", 4) == 2, F.lit(False))
    model = language.fit_language(docs, ~held)
    return language.identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In production the key comes from a secret store; it is a parameter of the operator."""
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, most=3.0, landing="words")
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_share("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.toxicity(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_hilbert_shards, op2_nearest, op3_repeats, op4_simhash, op5_language, op6_pseudonyms, op7_mix, op8_bpe, op9_toxicity, op10_exact_dedup, pipeline)
}
