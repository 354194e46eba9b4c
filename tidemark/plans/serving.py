"""Scoring a batch of transactions from raw events to decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import truncate_error
from tidemark.operators.clean import validate_transactions
from tidemark.operators.feature_rows import REPLAY_COLUMNS, merchant_feature_rows, transaction_features
from tidemark.operators.ledger import admit
from tidemark.operators.scoring import decide_per_model, resolve_model
from tidemark.operators.tables import dedupe_transactions, upsert_latest
from tidemark.schemas import CATALOG, CUSTOMER_FEATURES, HOME_COUNTRY, MERCHANT_RISK, VISIT_WINDOW_DAYS
from tidemark.session import cut_lineage, new_folder

#: Days that the rolling windows reach back.
ROLLING_DAYS = 7

REPEATED = "transaction is repeated in the batch"
PROCESSED = "transaction is already processed"


@dataclass
class ScoredBatch:
    """``decisions`` and ``rejected`` together hold every input row once."""

    accepted: DataFrame
    rejected: DataFrame
    features: DataFrame
    customer_rows: DataFrame
    merchant_rows: DataFrame
    decisions: DataFrame
    ledger_events: DataFrame


def score_batch(
    raw: DataFrame,
    scorer,
    ledger: DataFrame | None = None,
    history: DataFrame | None = None,
    home=HOME_COUNTRY,
    window_days: int = VISIT_WINDOW_DAYS,
    catalog: dict | None = None,
    order_by: str = "arrival_seq",
    buckets: DataFrame | None = None,
) -> ScoredBatch:
    """Validate, deduplicate, admit, compute features, enrich per model, score and decide.

    Every transaction is scored with its own feature row: windows end at the transaction and reach
    back over ``history``, the stored transactions, and over all valid rows of the batch, those
    already processed included. ``scorer(model, inputs)`` adds ``fraud_score`` to the model input rows of one
    model. ``rejected`` has transaction_id and reject_reason; ``ledger_events`` the states that admitted rows go through.

    With ``buckets``, stored merchant day buckets, ``history`` needs whole days only as far as the rolling windows reach; ``buckets`` are those of
    the days that ``history`` leaves out.
    """
    catalog = CATALOG if catalog is None else catalog
    valid, invalid = validate_transactions(raw)
    # Valid rows are numbered once and stored, so that exact copies and rows without an arrival stay apart.
    valid = _stored(valid.withColumn("_row", F.monotonically_increasing_id()), "valid-transactions")
    accepted = dedupe_transactions(valid, f"{order_by}, _row")
    repeated = valid.join(accepted.select("_row"), "_row", "left_anti")
    accepted = accepted.drop("_row")
    admitted, processed = (accepted, accepted.limit(0)) if ledger is None else admit(accepted, ledger)
    # The admitted transactions and their feature rows are tables of their own; later steps read what was written.
    admitted = cut_lineage(resolve_model(admitted, catalog))

    replay = _with_history(accepted, admitted, history, None if buckets is not None else max(window_days, ROLLING_DAYS) + 1)
    if buckets is not None:
        buckets = buckets.join(admitted.select("customer_id").distinct(), "customer_id", "left_semi")
    features = transaction_features(_stored(replay, "replay"), home, window_days, stored=buckets)
    features = features.drop("merchant_id", "customer_id", "event_timestamp")
    rows = admitted.join(features, "transaction_id")
    rows = _stored(rows, "scored-features")
    decided, failed = decide_per_model(with_views(rows), scorer, catalog)
    # Both outcomes are written in one job.
    outcome = _stored(decided.unionByName(failed.withColumn("failed", F.lit(True)), allowMissingColumns=True), "outcomes")
    failed = outcome.where("failed").select(*failed.columns)
    decided = outcome.where("failed IS NULL").select(*decided.columns)

    rejected = invalid.select("transaction_id", "reject_reason")
    for part, reason in ((repeated, REPEATED), (processed, PROCESSED)):
        rejected = rejected.unionByName(part.select("transaction_id", F.lit(reason).alias("reject_reason")))
    customers = upsert_latest(rows, ["customer_id", "event_timestamp"], "transaction_id")
    return ScoredBatch(
        admitted,
        rejected.unionByName(failed.select("transaction_id", "reject_reason")),
        rows.select("transaction_id", *CUSTOMER_FEATURES),
        customers.select("customer_id", "event_timestamp", *CUSTOMER_FEATURES),
        merchant_feature_rows(admitted),
        decided,
        ledger_events(admitted, decided, failed),
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet, so that later reads take only the columns they need."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_history(accepted: DataFrame, admitted: DataFrame, history: DataFrame | None, reach: int | None) -> DataFrame:
    """What the windows of the admitted transactions can see: the batch, and history of the same customers, ``reach`` days of it or all."""
    touched = admitted.groupBy("customer_id").agg(F.min("event_timestamp").alias("_oldest"))
    batch = accepted.select(*REPLAY_COLUMNS)
    if history is None:
        return batch.join(touched.select("customer_id"), "customer_id", "left_semi")
    older = history.select(*REPLAY_COLUMNS).join(
        accepted.select("transaction_id"), "transaction_id", "left_anti"
    )
    near = batch.unionByName(older).join(touched, "customer_id")
    if reach is not None:
        near = near.where(f"event_timestamp >= _oldest - INTERVAL '{reach}' DAY")
    return near.select(*REPLAY_COLUMNS)


def with_views(rows: DataFrame) -> DataFrame:
    """Feature rows under the names models use, with one struct column per feature view."""
    return rows.selectExpr(
        "transaction_id", "customer_id", "merchant_id", "merchant_category", "requested_model", "event_timestamp",
        *(["feature_service"] if "feature_service" in rows.columns else []),
        "amount AS transaction_amount", "country AS transaction_country",
        f"struct({', '.join(CUSTOMER_FEATURES)}) AS customer_transaction_stats_view",
        f"struct(cast({MERCHANT_RISK} AS float) AS merchant_risk_score, merchant_category) AS merchant_risk_view",
    )


def ledger_events(admitted: DataFrame, decided: DataFrame, failed: DataFrame) -> DataFrame:
    """States of admitted transactions in order of ``seq``: started, then recorded and published, or failed."""

    def state(df: DataFrame, model: str, status: str, seq: int, error: str = "cast(null AS string)") -> DataFrame:
        return df.selectExpr("transaction_id", f"{model} AS model", f"'{status}' AS status", f"{error} AS error_message", f"{seq}L AS seq")

    return (
        state(admitted, "requested_model", "STARTED", 0)
        .unionByName(state(decided, "model", "PREDICTION_RECORDED", 1))
        .unionByName(state(decided, "model", "DECISION_PUBLISHED", 2))
        .unionByName(state(failed, "model", "FAILED", 1, truncate_error("reject_reason")))
    )
