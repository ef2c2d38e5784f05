"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and its result, kept as Parquet, is the next one's docs.

Defined cases, of every stage: a null or empty text is clean, holds nothing and is packed as its end mark alone; a row
without doc_id is handled by its text and never stands for, or yields to, another one; repeated rows are treated alike,
but of those that share a doc_id near dedup keeps one; an empty table gives an empty one; other columns of docs, whatever
their names, come through unchanged up to packing, whose result has columns of its own.

Each stage sets the session to small batches of rows for Python, for memory; a limit that the session has already stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from weirlight.llm.common import small_batches, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is fitted on the labelled ones among docs."""
    small_batches(spark)
    return toxicity.not_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over many sites. What is nothing but such lines stays whole, so that the next stage keeps one of its copies. n_chars follows the text."""
    small_batches(spark)
    out = line_dedup.cut_texts(docs, spare_whole=True)
    own = {c: F.col("_cut" if c == "text" else f"_row.`{c}`") for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_gone") > 0, F.length("_cut")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in own.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of token sequences."""
    small_batches(spark)
    from public_tokenizers import path

    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None  # a learnt score is no SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
