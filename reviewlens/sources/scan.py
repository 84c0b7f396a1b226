"""Table scans with a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """The named columns of a stored table; the projection reaches the files."""
    df = spark.read.format(fmt).load(path)
    return df if columns is None else df.select(*columns)


def scan_database(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str],
    key: str,
    bounds: tuple[int, int],
    partitions: int,
    **options: str,
) -> DataFrame:
    """A database table read in key ranges, one connection per range."""
    low, high = bounds
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
            numPartitions=str(partitions), **options,
        )
        .load()
        .select(*columns)
    )
