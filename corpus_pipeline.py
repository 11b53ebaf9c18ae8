"""From raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from packloom.llm import langid, linededup, packing, toxicity
from packloom.llm.minhash import near_duplicates
from packloom.llm.staging import drop_staged, stage

#: Rows of an Arrow batch at most, so that executors hold little memory beside their heap.
ARROW_ROWS = 1_000
#: A table of at most so many ids is broadcast; it is counted first.
BROADCAST_IDS = 1_000_000


def _bounded(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return step(spark, docs, sf_dir)

    return run_step


def _of(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows whose id has no verdict of false; of a null id, all."""
    refused = stage(verdicts.where(~F.col("keep") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "pipeline-refused")
    return docs.join(_of(refused), "doc_id", "left_anti").select(docs.columns)


def _free(name: str, df: DataFrame) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained classifier calls toxic go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(docs, toxicity.score(docs, model).select("doc_id", (F.col("predicted") == 0).alias("keep")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without one n-gram of any learned language, go."""
    found = langid.learn_and_identify(docs)
    return _keep(docs, found.select("doc_id", ((F.col("lang_pred") != langid.UNKNOWN) & (F.col("distance") < 1)).alias("keep")))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages go; so do documents that consisted of nothing else."""
    lines, removed = _free("n_lines", docs), _free("n_removed", docs)
    out = linededup.remove_repeats(docs, within_lines=True, counts=(lines, removed))
    out = out.where((F.col(removed) == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Documents link by their texts as they are now or as they were read: what line
    dedup left of a near copy, its few own sentences, resembles nothing any more.
    """
    read = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = lambda df: df.select("doc_id", F.xxhash64("text").alias("digest"))
    changed = digest(read).join(digest(docs), ["doc_id", "digest"], "left_anti").join(docs.select("doc_id"), "doc_id", "left_semi")
    changed = stage(changed.select("doc_id").distinct(), "pipeline-changed")
    texts = docs.select("doc_id", "text").union(read.join(_of(changed), "doc_id", "left_semi"))
    out = _keep(docs, near_duplicates(texts).select("doc_id", F.col("kept").alias("keep")))
    drop_staged(changed)
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, every one with the sources' share of tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", _bounded(drop_toxic)),
    ("language", _bounded(drop_unknown_language)),
    ("line_dedup", _bounded(remove_repeated_passages)),
    ("near_duplicates", _bounded(drop_near_duplicates)),
    ("packing", _bounded(pack_sequences)),
]

#: The classifiers and the tokenizer have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
