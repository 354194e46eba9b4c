"""Normalising and validating transactions and labels.

Validation never drops a row: it is either valid or comes back with the first broken rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.scalars import text_or_null
from tidemark.schemas import DEFAULT_MODEL

# Rules and messages, in the order they are applied.
TRANSACTION_RULES = [
    ("transaction_id", "transactionId is required"),
    ("customer_id", "customerId is required"),
    ("card_id", "cardId is required"),
    ("merchant_id", "merchantId is required"),
    ("merchant_category", "merchantCategory is required"),
    ("amount", "amount is required"),
    ("amount > 0", "amount must be positive"),
    ("currency", "currency is required"),
    ("country", "country is required"),
    ("event_timestamp", "timestamp is required"),
]
LABEL_RULES = [
    ("transaction_id", "transactionId is required"),
    ("is_fraud", "isFraud is required"),
    ("is_fraud IN (0, 1)", "isFraud must be 0 or 1"),
    ("label_source", "labelSource is required"),
    ("label_confidence BETWEEN 0 AND 1", "labelConfidence must be between 0 and 1"),
]

_PLAIN = ["transaction_id", "customer_id", "card_id", "merchant_id"]


def _replace(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    present = [f"{columns[c]} AS {c}" if c in columns else c for c in df.columns]
    added = [f"{value} AS {name}" for name, value in columns.items() if name not in df.columns]
    return df.selectExpr(*present, *added)


def normalize_transactions(transactions: DataFrame) -> DataFrame:
    """Trim texts (blank becomes null), fix letter case, fill in the default model."""
    columns = {c: text_or_null(c) for c in _PLAIN}
    columns["merchant_category"] = f"lower({text_or_null('merchant_category')})"
    columns["currency"] = f"upper({text_or_null('currency')})"
    columns["country"] = f"upper({text_or_null('country')})"
    model = f"upper({text_or_null('requested_model')})" if "requested_model" in transactions.columns else "null"
    columns["requested_model"] = f"coalesce({model}, '{DEFAULT_MODEL}')"
    return _replace(transactions, columns)


def _first_broken(rules: list[tuple[str, str]]) -> str:
    tests = [
        f"WHEN {rule} IS NULL THEN '{message}'" if " " not in rule else f"WHEN NOT ({rule}) THEN '{message}'"
        for rule, message in rules
    ]
    return f"CASE {' '.join(tests)} END"


def check_transactions(transactions: DataFrame) -> DataFrame:
    """Normalised rows with ``reject_reason``, null when the row is valid."""
    return normalize_transactions(transactions).selectExpr("*", f"{_first_broken(TRANSACTION_RULES)} AS reject_reason")


def validate_transactions(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) normalised transactions."""
    return split_rejected(check_transactions(transactions))


def normalize_labels(labels: DataFrame, now: str) -> DataFrame:
    """Lower-case the source, fill in time and confidence, blank optional texts become null.

    ``now`` is SQL text for the ingestion time, e.g. ``TIMESTAMP '2024-01-31 00:00:00'``.
    """
    is_fraud = dict(labels.dtypes)["is_fraud"]
    columns = {
        "transaction_id": text_or_null("transaction_id"),
        "is_fraud": "cast(is_fraud AS int)" if is_fraud != "int" else "is_fraud",
        "label_timestamp": f"coalesce(label_timestamp, {now})",
        "label_source": f"lower({text_or_null('label_source')})",
        "label_confidence": "coalesce(cast(label_confidence AS double), 1.0D)",
    }
    for name in ("annotator_id", "reason_code"):
        columns[name] = text_or_null(name) if name in labels.columns else "cast(null AS string)"
    return _replace(labels, columns)


def check_labels(labels: DataFrame, now: str) -> DataFrame:
    return normalize_labels(labels, now).selectExpr("*", f"{_first_broken(LABEL_RULES)} AS reject_reason")


def validate_labels(labels: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) normalised labels."""
    return split_rejected(check_labels(labels, now))


def split_rejected(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("reject_reason IS NULL").drop("reject_reason"), checked.where("reject_reason IS NOT NULL")


def rejected_by_reason(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reject_reason").count().withColumnRenamed("count", "rows")


def feature_window(df: DataFrame, as_of: str, start_days: int, end_days: int) -> DataFrame:
    """Rows with an event time in ``[as_of - start_days, as_of - end_days)``; the bounds reach the scan."""
    return df.where(
        f"event_timestamp >= {as_of} - INTERVAL '{start_days}' DAY AND event_timestamp < {as_of} - INTERVAL '{end_days}' DAY"
    )


def mature_labels(labels: DataFrame, as_of: str, min_age_days: int) -> DataFrame:
    """Labels at least ``min_age_days`` old; zero keeps all."""
    if min_age_days <= 0:
        return labels
    return labels.where(f"label_timestamp <= {as_of} - INTERVAL '{min_age_days}' DAY")


