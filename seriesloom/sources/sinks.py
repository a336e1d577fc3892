"""Result tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Names of the tables dropped before a new run.
RESULT_TABLES = ("casesDF", "granger_result_table", "Cases_and_SD", "Cases_and_Climate")


def save_result(df: DataFrame, name: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Save as a managed parquet table."""
    writer = df.write.format("parquet").mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def save_panel(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 200,
               mode: str = "error") -> None:
    """Save as a managed table bucketed by ``keys`` and sorted by ``keys`` and ``order`` inside each bucket.

    The rows are dealt out as the buckets are, so each bucket is one file. Windows, joins and groups on the keys (or
    more columns) of such a table need no shuffle, as often as it is read. Choose ``buckets`` so that one fits
    a task; tables to be joined with each other need the same number.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.format("parquet").mode(mode).bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(name)


def saved_panel(spark: SparkSession, name: str) -> DataFrame:
    """A table of ``save_panel``, read bucket by bucket and known to be sorted.

    Spark trusts the order of a bucket only if told to (it checks that each is one file); the setting
    stays on for the session, as plans are made when results are asked for.
    """
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(name)


def save_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Save as parquet files."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def drop_results(spark: SparkSession, names: Iterable[str] = RESULT_TABLES) -> None:
    """Drop result tables that exist."""
    for name in names:
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def schema_report(datasets: dict[str, DataFrame]) -> DataFrame:
    """``dataset, position, column, type, nullable`` from the schemas alone; reads no data."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable)
            for name, df in datasets.items() for i, f in enumerate(df.schema.fields)]
    spark = next(iter(datasets.values())).sparkSession
    return spark.createDataFrame(
        rows, "dataset string, position int, column string, type string, nullable boolean")
