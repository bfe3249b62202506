"""A training-data pipeline over ``documents``: five stages, each one operator of ``kestrel.llm``.

Every stage takes all that the one before kept, written as Parquet and read
again.  Documents keep their columns and order of columns until the last stage,
which returns the token digests.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.blocks import materialize
from kestrel.llm.bpe import encode_decode
from kestrel.llm.decontaminate import decontaminate
from kestrel.llm.langid import fit, held_out, identify
from kestrel.llm.near_dedup import deduplicate
from kestrel.llm.queries import vocabulary
from kestrel.llm.substring_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go (no letter, or far from every language)."""
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)).select("text", "lang"))
    return identify(docs, model).where("NOT rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Word 5-shingles, similarity 0.8 or more.  Of rows that share that id, or of
    a group without any id, one stays.
    """
    return deduplicate(docs, shingle=5, percent=80, single=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that start in an earlier document go.

    A document from which nothing is removed keeps its text as it is; the
    others have their kept words joined by one space, which leaves an empty text
    where every word goes.  ``n_chars`` follows the text.
    """
    marked = remove_repeats(docs, keep_untouched=True)
    return marked.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(
        F.char_length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % of their words or more in benchmark windows go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left: their number, digest, and the decoded text's digest."""
    out = encode_decode(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The language model and the tokenizer have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
