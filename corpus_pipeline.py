"""From raw documents to shards of training data, stage by stage.

Every stage takes the session, the documents that its predecessor kept and the folder of the
other tables. All but the last return the documents' own columns, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import decontaminate, language, mixing, packing, simhash
from caseloom.llm.tables import keep, read, release

#: Probability of its language from which a document stays.
MIN_SCORE = 0.5
SHARDS = 16


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Those without a letter, or without a language of probability ``MIN_SCORE``, go. The model
    learns from all documents at hand that have a language, for nothing is held out here. If no document
    has a language to learn from, none can be told and all go.
    """
    model = language.train(docs.filter("lang IS NOT NULL").select("text", "lang"))
    told = language.predict(docs.select(F.struct("*").alias("doc"), "text"), model)
    kept = told.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.select("doc.*")


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """(row, doc): every row as a struct, with a number of its own.

    The table is written, so that all later scans see the same numbers. Columns keep to the
    struct: none clashes with ``row``, and maps or other types that cannot be hashed do no harm.
    """
    return keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), label)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the row of the smallest doc_id.

    Rows are decided on by themselves, also those that share a doc_id or have none, which come
    last. Of rows with the same doc_id the one with the smallest digest of its columns stays, so a
    rerun keeps the same; equal rows are one.
    """
    rows = numbered(docs, "pipeline-rows")
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "doc.text"))
    found = keep(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "pipeline-components")
    ids = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.md5(F.to_json("doc")).alias("digest"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "row")
    first = found.join(keep(ids, "pipeline-ids"), "row").groupBy("component").agg(F.min(place).alias("first"))
    first = keep(first.select("first.row"), "pipeline-first")
    # By shuffle at every size: a broadcast would grow with the documents.
    return rows.join(first.hint("merge"), "row", "left_semi").select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an overlap with the benchmark, whether or not they have a doc_id or share it."""
    rows = numbered(docs, "pipeline-rows")
    found = decontaminate.contaminated(rows.select(F.col("row").alias("doc_id"), "doc.text"), read(spark, sf_dir, "benchmark"))
    leaked = keep(found.select(F.col("doc_id").alias("row")).distinct(), "pipeline-leaked")
    return rows.join(leaked, "row", "left_anti").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.repeat(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return packing.pack(docs, shards=SHARDS)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# Fingerprints and packing cannot be said in SQL; the tests hold the rows against a plain rerun.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(docs, "_scratch"):
            # What the stage before wrote has been read for the last time.
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
