"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate join, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravalor.llm import jaccard_join, line_dedup, mixing, packing, quality
from terravalor.session import landing_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def _whole(docs: DataFrame, but: str = "") -> Column:
    """The document as one column, so that what an operator adds can't displace a column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != but]).alias("whole")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are frequent in their source; a text with nothing left goes.

    Copies of a text weigh as one, so that a page with many is left to the near-duplicate stage.
    """
    cleaned = line_dedup.drop_boilerplate(docs.select(_whole(docs, "text"), "text", "source"), copies=False)
    cut = F.col("n_dropped") > 0
    cleaned = cleaned.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("whole.n_chars"))
    return cleaned.select(*[(changed[c] if c in changed else F.col("whole").getField(c)).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    taken = mixing.mix(docs.select(_whole(docs), "doc_id", "text", "source")).where(F.col("copies") > 0)
    return taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("whole.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row a piece, with its ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram jaccard join", one_of_each),
    ("mixing", mixed),
    ("packing", packed_sequences),
]

#: Chosen paths and retrieval packing cannot be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = landing_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
