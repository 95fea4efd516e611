"""A training corpus from documents: five stages, each written and read by the next.

Toxic texts go, texts that the importance sample leaves out go, one text of each
near-duplicate group stays, personal data is marked, and what is left is packed into token
sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import jaccard, packing, pii, resample, toxicity
from wayfold.llm.common import new_folder, table
from wayfold.llm.queries import tokenizer_file
from wayfold.session import cut_lineage, prepare


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below one half."""
    model = toxicity.train(docs, table(prepare(spark), sf_dir, "labels"))
    return docs.filter(toxicity.score(F.col("text"), model) < 0.5)


def importance_sample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The Gumbel top-k of the documents, k by the good share among those that are labelled."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    target, share = resample.target_rows(table(prepare(spark), sf_dir, "labels").join(ids, "doc_id", "left_semi"))
    ratio = resample.log_ratio(*resample.ngram_counts(docs, target))
    key = resample.log_weight(F.col("text"), ratio) + resample.gumbel(F.col("doc_id"))
    least = resample.threshold(cut_lineage(docs.select(key.alias("key"))), share)
    return docs.filter(key >= F.lit(least))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group, once; of texts without a group, or of one id, none is lost."""
    prepare(spark)
    return jaccard.one_of_each(docs)


def private_data_marked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data written as its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    prepare(spark)
    return packing.packed_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality classifier", importance_sample),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", private_data_marked),
    ("packing", packed),
]

#: Stages 1 to 3 and 5 are models, hashes and tokenizers that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        folder = new_folder(spark, f"stage-{k}")
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
    return docs
