"""Access to the Parquet tables of one data directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory `sf_dir`, read lazily so that pruning reaches the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
