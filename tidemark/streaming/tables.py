"""Keyed tables fed by streams.

Every writer has a name of its own, given by the caller and kept over restarts. A micro-batch is written to the folder of
its writer and number, replacing what a failed attempt left there, so a repeated batch changes nothing and
writers never touch each other's rows. Readers take the row per key that arrived last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.scalars import epoch_ms, utc_day
from tidemark.operators.clean import validate_labels, validate_transactions
from tidemark.operators.ledger import known_labels, ledger_states, merge_ledger
from tidemark.operators.scoring import decide_per_model
from tidemark.operators.tables import dedupe_transactions, upsert_latest
from tidemark.operators.visits import merchant_day_buckets, merge_buckets
from tidemark.plans.serving import ROLLING_DAYS, score_batch, with_views
from tidemark.schemas import CATALOG, CUSTOMER_FEATURES, MERCHANT_RISK, VISIT_WINDOW_DAYS
from tidemark.sources.sinks import decision_events, label_events
from tidemark.streaming.keyed import BUCKETS, FAN, Folder, KeyedTable


_COMPACTED = "compacted-"


def write_batch(df: DataFrame, path: str, writer: str, batch_id: int) -> None:
    """Write one batch of a writer with the time of its arrival."""
    stamped = df if "arrived_at" in df.columns else df.withColumn("arrived_at", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(f"{path.rstrip('/')}/writer={writer}/batch_id={batch_id}")


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """Newest row per key over all writers and batches.

    ``order_by`` names the arrival order in the rows; without it the time of the write decides, then the batch.
    """
    order = f"struct({order_by}, arrived_at, batch_id)" if order_by else "struct(arrived_at, batch_id)"
    return upsert_latest(spark.read.parquet(path), keys, order).drop("writer", "batch_id", "arrived_at")


def stream_upsert(stream: DataFrame, path: str, keys: Sequence[str], order_by: str, *, writer: str) -> DataStreamWriter:
    """Write the last row per key of every micro-batch."""

    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(upsert_latest(batch, keys, order_by), path, writer, batch_id)

    return stream.writeStream.foreachBatch(save)


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], order_by: str | None = None) -> str:
    """Write the current rows of a table below ``target`` and return the name of the generation written.

    Each compaction is a generation of its own, which no stream writes. Rows keep their time of arrival, so
    streams may go on writing to ``target``. Where it is ``path`` itself, the generations and micro-batches that were folded are deleted then, but for the
    newest micro-batch of every writer, which its stream may repeat; until they are gone their rows are there twice, which readers by key
    do not notice. Jobs that were planned before and still read them fail and have to be run again.
    """
    order = f"struct({order_by}, arrived_at, batch_id)" if order_by else "struct(arrived_at, batch_id)"
    generation = f"{_COMPACTED}{uuid.uuid4().hex}"
    folder = Folder(spark, path)
    there = {w.removeprefix("writer="): folder.names(w) for w in folder.names("") if w.startswith("writer=")}
    current = upsert_latest(spark.read.parquet(path), keys, order).drop("writer", "batch_id")
    write_batch(current, target, generation, 0)
    if target.rstrip("/") == path.rstrip("/"):
        for writer, batches in there.items():
            numbers = sorted((int(b.removeprefix("batch_id=")) for b in batches if b.startswith("batch_id=")))
            for number in numbers if writer.startswith(_COMPACTED) else numbers[:-1]:
                folder.delete(f"writer={writer}/batch_id={number}")
    return generation


def stream_score(
    features: DataFrame,
    root: str,
    scorer: Callable[[str, DataFrame], DataFrame],
    catalog: dict | None = None,
    *,
    writer: str,
) -> DataStreamWriter:
    """Feature rows to feature tables, model inputs, scores, decisions, prediction log and events, in this order.

    ``features`` comes from ``stream_features``. Rejected inputs and unknown models go to ``rejected``.
    """
    catalog = CATALOG if catalog is None else catalog
    root = root.rstrip("/")

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_batch(
                upsert_latest(batch, ["customer_id", "event_timestamp"], "transaction_id").select(
                    "customer_id", "event_timestamp", *CUSTOMER_FEATURES
                ),
                f"{root}/customer_transaction_stats",
                writer,
                batch_id,
            )
            write_batch(
                upsert_latest(batch, ["merchant_id", "event_timestamp"], "transaction_id").selectExpr(
                    "merchant_id", "event_timestamp", f"cast({MERCHANT_RISK} AS float) AS merchant_risk_score", "merchant_category"
                ),
                f"{root}/merchant_risk_features",
                writer,
                batch_id,
            )
            decided, rejected = decide_per_model(with_views(batch), scorer, catalog)
            write_batch(decided.drop("customer_id"), f"{root}/fraud_prediction_logs", writer, batch_id)
            write_batch(rejected, f"{root}/rejected", writer, batch_id)
            write_batch(decision_events(decided), f"{root}/decision_events", writer, batch_id)
        finally:
            batch.unpersist()

    return features.writeStream.foreachBatch(work)


def decision_tables(root: str, buckets: int = BUCKETS) -> dict[str, KeyedTable]:
    """The tables that ``stream_decisions`` reads back, by name: transactions, merchant_day_buckets, processing_ledger.

    ``buckets`` is fixed for the life of the tables: a day of a bucket should fill a file.
    """
    root, day = root.rstrip("/"), utc_day(epoch_ms("event_timestamp"))

    def first_arrivals(rows: DataFrame) -> DataFrame:
        return dedupe_transactions(rows, "event_timestamp")

    return {
        "transactions": KeyedTable(f"{root}/transactions", "customer_id", first_arrivals, buckets, day),
        "merchant_day_buckets": KeyedTable(f"{root}/merchant_day_buckets", "customer_id", merge_buckets, buckets, "day"),
        "processing_ledger": KeyedTable(f"{root}/processing_ledger", "transaction_id", merge_ledger, buckets),
    }


def stream_decisions(
    stream: DataFrame,
    root: str,
    scorer: Callable[[str, DataFrame], DataFrame],
    *,
    writer: str,
    order_by: str = "arrival_seq",
    window_days: int = VISIT_WINDOW_DAYS,
    fan: int = FAN,
    buckets: int = BUCKETS,
    **options,
) -> DataStreamWriter:
    """Raw transactions to decisions: every micro-batch is a scored batch over what was stored before it.

    Validation, the ledger's gate, features, models and rejects are those of ``score_batch``, whose ``options`` it takes. Of the stored transactions a micro-batch
    reads those of its customers' buckets on the days that the rolling windows of its own days reach, of the days before only the merchant
    day buckets, and of the ledger the buckets of its transaction ids; so its reads are bounded by the windows, however long the stream has run.
    A late transaction sees what happened before it. Tables below ``root``: those of ``decision_tables``, customer_transaction_stats,
    merchant_risk_features, fraud_prediction_logs, decision_events, rejected; the ledger is written last.
    """
    root = root.rstrip("/")
    tables = decision_tables(root, buckets)

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            decide(batch, batch_id)
        finally:
            batch.unpersist()

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, (writer, batch_id)
        valid = validate_transactions(batch)[0].selectExpr("transaction_id", "customer_id", f"{utc_day(epoch_ms('event_timestamp'))} AS day")
        # One row per day of the micro-batch, and one per bucket.
        days = {r["day"] for r in valid.select("day").distinct().collect()}
        near = {d - k for d in days for k in range(ROLLING_DAYS + 2)}
        far = {d - k for d in days for k in range(window_days)} - near
        customers = tables["transactions"].bucket_numbers(valid)
        history = tables["transactions"].read(spark, customers, near, own)
        older = tables["merchant_day_buckets"].read(spark, customers, far, own)
        ledger = tables["processing_ledger"].read(spark, tables["processing_ledger"].bucket_numbers(valid), without=own)
        scored = score_batch(batch, scorer, ledger, history, order_by=order_by, window_days=window_days, buckets=older, **options)
        parts = {
            "customer_transaction_stats": scored.customer_rows,
            "merchant_risk_features": scored.merchant_rows,
            "fraud_prediction_logs": scored.decisions,
            "decision_events": decision_events(scored.decisions),
            "rejected": scored.rejected,
        }
        for name, rows in parts.items():
            write_batch(rows, f"{root}/{name}", writer, batch_id)
        events = scored.ledger_events.withColumn("seq", F.expr("unix_micros(current_timestamp()) * 4 + seq"))
        for name, rows in {
            "transactions": scored.accepted.drop("model_version", "feature_service", "reject_reason"),
            "merchant_day_buckets": merchant_day_buckets(scored.accepted),
            "processing_ledger": ledger_states(events),
        }.items():
            tables[name].append(rows, writer, batch_id)
            tables[name].compact(spark, fan)

    return stream.writeStream.foreachBatch(work)


def stream_labels(
    labels: DataFrame, root: str, transactions: Callable[[], DataFrame], now: str = "current_timestamp()", order_by: str = "arrival_seq",
    *, writer: str,
) -> DataStreamWriter:
    """Label annotations to history, current labels and events; unknown transactions are rejected.

    ``transactions`` returns the transaction table as it is when a batch arrives.
    """
    root = root.rstrip("/")

    def work(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            valid, invalid = validate_labels(batch, now)
            known, unknown = known_labels(valid, transactions())
            write_batch(known, f"{root}/fraud_label_events", writer, batch_id)
            current = upsert_latest(known, ["transaction_id"], order_by)
            write_batch(current, f"{root}/fraud_labels", writer, batch_id)
            missing = unknown.selectExpr("transaction_id", "'transaction is unknown' AS reject_reason")
            write_batch(
                invalid.select("transaction_id", "reject_reason").unionByName(missing), f"{root}/rejected_labels", writer, batch_id
            )
            write_batch(label_events(known), f"{root}/label_events", writer, batch_id)
        finally:
            batch.unpersist()

    return labels.writeStream.foreachBatch(work)
