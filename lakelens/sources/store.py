"""Tables as folders of versions and batches: a write is whole or not there, and can be repeated.

``<store>/<table>/table_version=<n>/table_batch=<name>`` holds the rows of one write. Writing a batch again replaces it. A new version
counts from when its first batch, BASE, is whole (Spark marks that last), so a crash in a rewrite loses nothing; version 0
has no BASE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.sources.files import exists

BASE = "base"


def newest(spark: SparkSession, store: str, table: str) -> int:
    """The newest whole version."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{store}/{table}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    versions = sorted((int(n.removeprefix("table_version=")) for n in names if n.startswith("table_version=")), reverse=True)
    return next((v for v in versions if v and exists(spark, f"{store}/{table}/table_version={v}/table_batch={BASE}/_SUCCESS")), 0)


def has(spark: SparkSession, store: str, table: str) -> bool:
    return exists(spark, f"{store}/{table}/table_version={newest(spark, store, table)}")


def read(spark: SparkSession, store: str, table: str, without: str | None = None) -> DataFrame:
    """The table's rows; those of the batch ``without`` are left out, and its files are not touched."""
    folder = f"{store}/{table}"
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/table_version={newest(spark, store, table)}")
    rows = rows if without is None else rows.filter(F.col("table_batch").cast("string") != without)
    return rows.drop("table_version", "table_batch")


def append(rows: DataFrame, store: str, table: str, batch: str) -> None:
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{store}/{table}/table_version={newest(spark, store, table)}/table_batch={batch}")


def replace(rows: DataFrame, store: str, table: str) -> None:
    """A new version; ``rows`` may come from the old one, which stays as it is."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{store}/{table}/table_version={newest(spark, store, table) + 1}/table_batch={BASE}")
