"""Evaluation of a deployed model from its prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.joins import labeled
from tidemark.operators.metrics import evaluation_metrics
from tidemark.schemas import DECLINE_AT
from tidemark.session import cut_lineage


def evaluate_deployed(
    predictions: DataFrame, labels: DataFrame, model: str, version: str, threshold: float = DECLINE_AT
) -> DataFrame:
    """One row of metrics for one model version; an error when no prediction has a label.

    The join runs once; the metrics read its two columns from files.
    """
    rows = cut_lineage(labeled(predictions, labels, model, version).select("fraud_score", "is_fraud"))
    if rows.isEmpty():
        raise ValueError(f"{model} {version} has no prediction with a label")
    return evaluation_metrics(rows, threshold).selectExpr(
        "rows",
        f"'{model}' AS model",
        f"'{version}' AS model_version",
        f"{threshold}D AS threshold",
        "precision",
        "recall",
        "f1",
        "tn",
        "fp",
        "fn",
        "tp",
        "pr_auc",
        "roc_auc",
    )
