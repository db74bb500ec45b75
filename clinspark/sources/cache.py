"""Read-through cache of a set of tables as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from clinspark.sources.extract import EXTRACT_GROUPS, ExtractBundle


def table_written(spark: SparkSession, path: str) -> bool:
    """Whether a complete table is stored at ``path``, on any file system Spark can reach."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker))


def read_or_build(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    build: Callable[[], dict[str, DataFrame]],
    refresh: bool = False,
) -> dict[str, DataFrame]:
    """Read the named tables under ``path`` if all of them are complete, else build and write all of them.

    The cache knows nothing of cohorts or options: it holds the tables as built, and ``refresh`` rebuilds them.
    """
    if refresh or not all(table_written(spark, f"{path}/{n}") for n in names):
        built = build()
        for name in names:
            built[name].write.mode("overwrite").parquet(f"{path}/{name}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def cached_extract(
    spark: SparkSession, path: str, build: Callable[[], ExtractBundle], refresh: bool = False
) -> ExtractBundle:
    tables = read_or_build(spark, path, EXTRACT_GROUPS, lambda: build().tables(), refresh)
    return ExtractBundle(*[tables[g] for g in EXTRACT_GROUPS])
