"""Writing tables, log lines and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The published line formats.
DECISION_EVENT = "fraud_decision_event transaction_id=%s customer_id=%s model=%s decision=%s score=%s"
LABEL_EVENT = "fraud_label_ingested transaction_id=%s is_fraud=%s label_source=%s confidence=%s"


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_history(df: DataFrame, path: str, run: str | None = None) -> None:
    """Append label annotations to the immutable history.

    A job that may be repeated names its ``run``: its rows go to a folder of that name, which a repetition replaces, so nothing is written twice. All
    jobs of a history name their runs, or none does.
    """
    if run is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def decision_events(decisions: DataFrame) -> DataFrame:
    """One published line per decision."""
    return decisions.selectExpr(
        "transaction_id",
        f"format_string('{DECISION_EVENT}', transaction_id, customer_id, model, decision, cast(fraud_score AS string)) AS line",
    )


def label_events(labels: DataFrame) -> DataFrame:
    """One published line per ingested label."""
    return labels.selectExpr(
        "transaction_id",
        f"format_string('{LABEL_EVENT}', transaction_id, if(is_fraud = 1, 'true', 'false'), label_source, "
        "cast(label_confidence AS string)) AS line",
    )


def report_json(report: DataFrame) -> DataFrame:
    """Every report row as a JSON document in the column ``report``."""
    return report.selectExpr("to_json(struct(*)) AS report")
