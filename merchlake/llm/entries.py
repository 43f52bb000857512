"""Queries of the training-data operators, by name, with their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.llm import alignment, embeddings, fingerprints, jaccard, licences, mixing, pieces, quality, search, sharding, substrings, suffixes, toxicity
from merchlake.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents"), n_best=2, verify=True, keep=["doc_id"])
    return coded.select("doc_id", "n_pieces", "score", F.get("next_scores", 0).alias("next_score"), "ids", F.get("next_ids", 0).alias("next_ids"), "decodes")


def op4_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: texts are encoded, and the digest is that of what the ids alone decode to."""
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "ids")
    return pieces.decode_pieces(coded).select("doc_id", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_suffixes(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("__row", "__first")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the repository's top, beside the package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_mixing": op1_mixing, "op2_toxicity": op2_toxicity, "op3_substrings": op3_substrings, "op4_pieces": op4_pieces, "op4_decoded": op4_decoded, "op5_suffixes": op5_suffixes, "op6_jaccard": op6_jaccard, "op7_sharding": op7_sharding, "op8_quality": op8_quality, "op9_embeddings": op9_embeddings, "op10_licences": op10_licences, "op11_alignment": op11_alignment, "op12_search": op12_search, "op13_fingerprints": op13_fingerprints, "pipeline": pipeline}
ORACLES = {"op1_mixing": mixing.MIX_SQL, "op3_substrings": substrings.SUBSTRINGS_SQL, "op4_decoded": pieces.DECODED_SQL, "op5_suffixes": suffixes.SUFFIXES_SQL, "op6_jaccard": jaccard.JACCARD_SQL, "op9_embeddings": embeddings.EMBEDDINGS_SQL, "op12_search": search.SEARCH_SQL, "op13_fingerprints": fingerprints.FINGERPRINTS_SQL}
