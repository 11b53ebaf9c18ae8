"""Thin ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, gridorder, htmltext, linededup, minhash, toxicity
from .bpe import encode_and_decode
from .gridorder import near_duplicate_vectors
from .jpeg import media_columns
from .langid import learn_and_identify
from .minhash import near_duplicates
from .packing import pack
from .staging import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(_table(spark, sf_dir, "documents"))


def op7_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def vector_links_at_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7 at a cosine that links many of the driver's vectors."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.4)


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def op9_boosted_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"), htmltext.train())


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mil_toxicity": op1_mil_toxicity,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_perspective_chat": op3_perspective_chat,
    "op4_prefix_bpe": op4_prefix_bpe,
    "op5_line_windows": op5_line_windows,
    "op6_rank_order_language": op6_rank_order_language,
    "op7_grid_order_join": op7_grid_order_join,
    "op8_jpeg_media": op8_jpeg_media,
    "op9_boosted_main_text": op9_boosted_main_text,
    "op10_mixture_packing": op10_mixture_packing,
    "vector_links_at_04": vector_links_at_04,
}

#: DuckDB counterparts, where SQL can state the result.
ORACLES: dict[str, str] = {
    "op2_minhash_dedup": minhash.SQL,
    "op3_perspective_chat": chat.SQL,
    "op5_line_windows": linededup.SQL,
    "op7_grid_order_join": gridorder.SQL.format(cosine=0.9),
    "vector_links_at_04": gridorder.SQL.format(cosine=0.4),
}
