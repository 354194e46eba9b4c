"""Label, point-in-time and prediction joins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame

from tidemark.operators.running import SLICE_ROWS, Heat, apply_by_heat, key_heat, running
from tidemark.schemas import FeatureView


def training_examples(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions with their current label, if it was given at or after the event.

    Both sides are unique per transaction id, so the join can not fan out.
    """
    return (
        transactions.join(labels, "transaction_id")
        .where("label_timestamp >= event_timestamp")
        .selectExpr(
            "transaction_id",
            "customer_id",
            "merchant_id",
            "event_timestamp",
            "cast(amount AS double) AS transaction_amount",
            "country AS transaction_country",
            "merchant_category",
            "is_fraud",
            "label_timestamp",
            "label_source",
            "label_confidence",
            *[c for c in ("annotator_id", "reason_code") if c in labels.columns],
        )
    )


def point_in_time_join(
    entities: DataFrame,
    features: DataFrame,
    key: str,
    ttl: timedelta,
    columns: list[str] | None = None,
    *,
    slice_rows: int = SLICE_ROWS,
    heat: Heat | None = None,
) -> DataFrame:
    """Every entity row with the newest feature row of its key, not newer than itself and not older than ``ttl``.

    Features and entities are merged into one stream per key and the last feature row is carried
    along: one shuffle, no row growth, whatever the number of feature rows. A row past its time to
    live, or no row at all, leaves nulls. ``heat`` tells how the rows spread over the keys where that is known (``join_heat``).
    """
    if columns is None:
        columns = [c for c in features.columns if c not in (key, "event_timestamp", "created_timestamp")]
    created = "created_timestamp" if "created_timestamp" in features.columns else "event_timestamp"
    feature_rows = features.where(f"{key} IS NOT NULL").selectExpr(
        key,
        "event_timestamp AS _at",
        "0 AS _kind",
        f"{created} AS _created",
        "cast(null AS string) AS _id",
        f"struct(event_timestamp AS _valid_from, {', '.join(columns)}) AS _feature",
    )
    entity_rows = entities.selectExpr(
        key,
        "event_timestamp AS _at",
        "1 AS _kind",
        "transaction_id AS _id",
        f"struct({', '.join(entities.columns)}) AS _entity",
    )
    heat = key_heat([feature_rows, entity_rows], key, slice_rows) if heat is None else heat

    def build(left: DataFrame, right: DataFrame, sliced: bool) -> DataFrame:
        merged = right.unionByName(left, allowMissingColumns=True)
        return running(
            merged, [key], ["_at", "_kind", "_created", "_id"], {"_found": ("last", "_feature")}, sliced=sliced
        ).where("_kind = 1")

    alive = f"_found._valid_from >= _at - INTERVAL '{int(ttl.total_seconds())}' SECOND"
    return apply_by_heat(build, [entity_rows, feature_rows], key, heat).selectExpr(
        *[f"_entity.{c} AS {c}" for c in entities.columns],
        *[f"if({alive}, _found.{c}, null) AS {c}" for c in columns],
    )


def join_heat(entities: DataFrame, features: DataFrame, view: FeatureView, slice_rows: int = SLICE_ROWS) -> Heat:
    """How entities and features spread over the keys of a view."""
    return key_heat([features.where(f"{view.entity} IS NOT NULL").select(view.entity), entities.select(view.entity)], view.entity, slice_rows)


def join_view(
    entities: DataFrame, features: DataFrame, view: FeatureView, columns: list[str], slice_rows: int = SLICE_ROWS, heat: Heat | None = None
) -> DataFrame:
    return point_in_time_join(entities, features, view.entity, view.ttl, columns, slice_rows=slice_rows, heat=heat)


def labeled(predictions: DataFrame, labels: DataFrame, model: str, version: str) -> DataFrame:
    """Predictions of one model version with the current labels."""
    mine = predictions.where(predictions.model == model).where(predictions.model_version == version)
    return mine.join(labels.select("transaction_id", "is_fraud"), "transaction_id").select(
        "transaction_id", "fraud_score", "is_fraud", "inference_timestamp"
    )


def labeled_predictions(predictions: DataFrame, labels: DataFrame, model: str, version: str) -> DataFrame:
    """The same in order of inference."""
    return labeled(predictions, labels, model, version).orderBy("inference_timestamp", "transaction_id")


def drift_features(customer_rows: DataFrame, merchant_rows: DataFrame) -> DataFrame:
    """Customer rows with the risk of every merchant row of the same moment.

    The key is the event time alone, so rows multiply when moments coincide. Drift itself is
    computed from weighted rows (``plans.drift``) and never builds this table.
    """
    risk = merchant_rows.select("event_timestamp", "merchant_risk_score")
    return customer_rows.join(risk, "event_timestamp", "left")


def recent(df: DataFrame, rows: int = 10, tie: str = "transaction_id") -> DataFrame:
    """The newest ``rows`` rows: top-k per task, then of those."""
    return df.orderBy(df.event_timestamp.desc(), df[tie]).limit(rows)
