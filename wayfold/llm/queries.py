"""One registered query per operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, prepare
from . import cover_tree, hard_negatives, huffman, jaccard, merkle, packing, pii, piece_bpe, resample, segments, toxicity, warc, winnow
from .common import table


def tokenizer_file(name: str) -> str:
    """A public vocabulary file; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, share = resample.target_rows(table(spark, sf_dir, "labels"))
    scored = cut_lineage(resample.weighted(table(spark, sf_dir, "documents").select("doc_id", "text"), target).select("doc_id", "log_weight", "key"))
    return scored.withColumn("selected", F.col("key") >= F.lit(resample.threshold(scored, share)))


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")), ("page_id",))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), null_ids=True)


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    both = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = segments.whole_vectors(table(spark, sf_dir, "embeddings"))
    return segments.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined_embeddings(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(prepare(spark), sf_dir)

        return run

    every = (op1_packing, op2_importance_resampling, op3_huffman_ids, op4_toxicity, op5_warc_derivatives, op6_ngram_jaccard, op7_piece_bpe, op8_cover_tree, op9_segment_search, op10_pii, op11_winnowing, op12_merkle_manifest, op13_hard_negatives, pipeline)
    return {q.__name__: ready(q) for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_derivatives": warc.ORACLE_SQL, "op8_cover_tree": cover_tree.ORACLE_SQL, "op9_segment_search": segments.ORACLE_SQL, "op10_pii": pii.ORACLE_SQL, "op11_winnowing": winnow.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
