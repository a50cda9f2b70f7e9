"""All registered queries on the document operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the DuckDB SQL of its rows if there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by a key: what is dear to work on in Python may come as one small file, which is one task."""
    spark = df.sparkSession
    # not more tasks than cores need: each reads programs that repeat anew
    return df.repartition(max(min(48, int(spark.conf.get("spark.sql.shuffle.partitions"))), 4 * spark.sparkContext.defaultParallelism), key)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bench_summary"](spark, sf_dir)


from . import byte_queries, check_queries, color_queries, document_queries, file_queries, generic_queries, lifecycle_queries, object_queries, order_queries, stateful_queries  # noqa: E402, F401
