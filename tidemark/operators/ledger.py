"""Processing ledger and label ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import truncate_error
from tidemark.operators.tables import upsert_latest


def ledger_states(events: DataFrame) -> DataFrame:
    """Every processing event as the state it leaves by itself; ``merge_ledger`` adds them up.

    A success clears the error; an error text is cut to 1000 characters. ``seq`` orders the events.
    """
    error = f"if(status = 'FAILED', {truncate_error('error_message')}, null)"
    return events.selectExpr("transaction_id", "model", "status", f"{error} AS error_message", "seq AS started_seq", "seq AS updated_seq")


def merge_ledger(states: DataFrame) -> DataFrame:
    """One state per transaction: the latest of the states, the first start. Snapshots and states of later events merge in any order."""
    return (
        states.selectExpr("transaction_id", "started_seq", "updated_seq", "struct(model, status, error_message) AS state")
        .groupBy("transaction_id")
        .agg(
            F.expr("max_by(state, updated_seq) AS state"),
            F.expr("min(started_seq) AS started_seq"),
            F.expr("max(updated_seq) AS updated_seq"),
        )
        .selectExpr("transaction_id", "state.*", "started_seq", "updated_seq")
    )


def fold_ledger(events: DataFrame) -> DataFrame:
    """Current state per transaction from its processing events."""
    return merge_ledger(ledger_states(events))


def stale_started(ledger: DataFrame) -> DataFrame:
    """Transactions that were started and never came to an end; they block a retry."""
    return ledger.where("status = 'STARTED'")


def admission(transactions: DataFrame, ledger: DataFrame) -> DataFrame:
    """``admitted`` is true for new transactions and for a retry after a failure."""
    known = ledger.selectExpr("transaction_id", "status AS ledger_status")
    return transactions.join(known, "transaction_id", "left").selectExpr(
        *transactions.columns, "ledger_status", "ledger_status IS NULL OR ledger_status = 'FAILED' AS admitted"
    )


def admit(transactions: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, already processed)."""
    gate = admission(transactions, ledger)
    return gate.where("admitted").drop("admitted"), gate.where("NOT admitted").drop("admitted")


def labels_current(history: DataFrame, order_by: str = "arrival_seq") -> DataFrame:
    """Current label per transaction: the last one ingested, whatever its label time."""
    return upsert_latest(history, ["transaction_id"], order_by)


def known_labels(labels: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels of recorded transactions, labels of unknown ones)."""
    ids = transactions.select("transaction_id")
    return labels.join(ids, "transaction_id", "left_semi"), labels.join(ids, "transaction_id", "left_anti")
