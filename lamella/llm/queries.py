"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), words=2, percent=80)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"), at_least=0.9)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import public_path
    from .wordpiece import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_repeats

    return line_repeats(_read(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdtree import top_k

    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import public_path

    return pack(_read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), capacity=4096)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), window=20)


def op8_segmentation_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import segmentations
    from .tokens import public_path

    return segmentations(_read(spark, sf_dir, "conversations"), public_path("piece_bpe_32k.model"), keys=("conv_id", "turn"), k=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_read(spark, sf_dir, "documents"), shards=16)


_ALL = (op1_minhash_near_dedup, op2_embedding_near_dedup, op3_token_counts, op4_line_dedup, op5_exact_top_k, op6_best_fit_packing, op7_substring_dedup, op8_segmentation_sampling, op9_toxicity, op10_sharding)
QUERIES = {f.__name__: f for f in _ALL}
