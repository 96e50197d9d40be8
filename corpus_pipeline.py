"""A corpus from raw documents to packed training sequences: five stages, each written to Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import hamming, lines, packing, pii, toxicity
from voxelframe.llm.catalog import BYTE_MODEL
from voxelframe.llm.common import clear_scratch, drop_saved, saved, scratch_so_far, table


def _rewrite(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], new: str) -> DataFrame:
    """The columns of ``docs`` with the text (unless null) replaced by what the operator makes, and its length brought up to date.

    The operator sees the other columns only as one struct, so that none of their names can clash with its own.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    out = operator(docs.select(row.alias("__row"), "text", "source"))
    text = F.when(F.col("text").isNotNull(), F.col(new))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*((made[c] if c in made else F.col("__row").getField(c)).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the nearest labelled examples call toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return toxicity.drop_toxic(docs if model.counted is None else model.counted, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines that too many documents of a source share go from its texts."""
    return _rewrite(docs, lambda d: lines.drop_boilerplate(d, F.col("text"), F.col("source")), "clean_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near-duplicates stays."""
    return hamming.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every span of personal data is replaced by its kind."""
    return _rewrite(docs, lambda d: pii.masked(pii.detect(d)), "masked")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of the documents and their places in sequences."""
    return packing.pack(docs, BYTE_MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack),
]

#: Tokens, fingerprints and trained models are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = scratch_so_far()
        out = saved(stage(spark, docs, sf_dir), name)
        clear_scratch(spark, before, keep=out)  # what the stage saved on its way
        drop_saved(docs)  # its input, unless that is the table itself
        docs = out
    return docs
