"""Reading transactions, labels and offline tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import LABEL, TABLES, TRANSACTION, FeatureView


def read_transactions(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Transaction events with a fixed schema, so nothing is inferred; ``timestamp`` becomes ``event_timestamp``."""
    return _event_time(spark.read.schema(TRANSACTION).options(**options).format(fmt).load(path))


def read_labels(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    return spark.read.schema(LABEL).options(**options).format(fmt).load(path)


def _event_time(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("timestamp", "event_timestamp")


def read_table(spark: SparkSession, name: str, root: str) -> DataFrame:
    """An offline table stored as Parquet below ``root``."""
    if name not in TABLES:
        raise ValueError(f"Unknown table {name}; available tables: {', '.join(sorted(TABLES))}")
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def read_table_jdbc(spark: SparkSession, name: str, url: str, **options: str) -> DataFrame:
    """The same table over JDBC; pass ``partitionColumn``, bounds and ``numPartitions`` to read in parallel."""
    if name not in TABLES:
        raise ValueError(f"Unknown table {name}; available tables: {', '.join(sorted(TABLES))}")
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def bootstrap_features(spark: SparkSession, view: FeatureView, now: datetime) -> DataFrame:
    """One default row per view, so that an empty store already has its schema."""
    row = {**view.bootstrap, view.timestamp: now, view.created: now}
    columns = {view.entity: "string", view.timestamp: "timestamp", view.created: "timestamp", **view.features}
    return spark.createDataFrame([tuple(row[c] for c in columns)], ", ".join(f"{c} {t}" for c, t in columns.items()))
