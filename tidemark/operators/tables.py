"""Keyed tables on plain files: append, then read the newest row per key.

``row_number() = 1`` is turned by Spark into a group limit ahead of the shuffle, so many copies of
one key shrink to one row per task before they travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import VISIT_DEFAULTS, FeatureView


def _first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rank = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order}) AS _rank"
    return df.selectExpr("*", rank).where("_rank = 1").drop("_rank")


def upsert_latest(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """Last arrival per key wins."""
    return _first_per_key(df, keys, f"{order_by} DESC")


def merge_upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """The table after the changes: compaction of old and new rows."""
    return upsert_latest(table.unionByName(changes, allowMissingColumns=True), keys, order_by)


def insert_if_absent(df: DataFrame, table: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """New rows whose key is not in the table yet; of several new rows the first arrival stays."""
    return _first_per_key(df, keys, order_by).join(table.select(*keys), list(keys), "left_anti")


def dedupe_transactions(transactions: DataFrame, order_by: str = "arrival_seq") -> DataFrame:
    """First arrival per transaction id."""
    return _first_per_key(transactions, ["transaction_id"], order_by)


def append_if_absent(new: DataFrame, history: DataFrame, order_by: str = "arrival_seq") -> DataFrame:
    """History rows not recorded yet under the same transaction, time and source; of several new ones the first arrival."""
    keys = ["transaction_id", "label_timestamp", "label_source"]
    return insert_if_absent(new, history, keys, order_by).select(*new.columns)


def latest_features(
    df: DataFrame, entity: str, order_by: Sequence[str] = ("event_timestamp", "created_timestamp"), as_of: str | None = None
) -> DataFrame:
    """Last feature row per entity, optionally as of a moment; newest event time wins.

    Each task keeps one row per entity ahead of the shuffle, so an entity with most of the rows is no burden.
    """
    if as_of is not None:
        df = df.where(f"event_timestamp <= {as_of}")
    order = ", ".join(f"{c} DESC" for c in order_by if c in df.columns)
    return _first_per_key(df, [entity], order).select(entity, *[c for c in df.columns if c != entity])


def online_values(df: DataFrame, view: FeatureView) -> DataFrame:
    """What the online store holds for a view: decimals as floats, times read as UTC."""
    typed = [f"cast({name} AS {kind}) AS {name}" for name, kind in view.features.items()]
    times = [f"cast({c} AS timestamp) AS {c}" for c in (view.timestamp, view.created) if c in df.columns]
    return latest_features(df.selectExpr(view.entity, *times, *typed), view.entity)


def evolve_schema(df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Add columns an older file does not have and fill their gaps with typed defaults."""
    defaults = VISIT_DEFAULTS if defaults is None else defaults
    filled = {
        name: F.coalesce(F.col(name), _literal(value)) if name in df.columns else _literal(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def _literal(value: object):
    return F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value)
