"""Feature rows: the 16 customer features and the merchant risk row of every transaction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.rolling import FRAME_ROWS, NEAR_PLACES, add_rolling, dates_near
from tidemark.operators.running import SLICE_ROWS, apply_by_heat, key_heat
from tidemark.operators.scan import MERCHANTS, scan_features
from tidemark.operators.visits import add_visits, check_window, ids_repeat
from tidemark.schemas import CUSTOMER_FEATURES, HOME_COUNTRY, MERCHANT_RISK, VISIT_WINDOW_DAYS
from tidemark.session import cut_lineage

REPLAY_COLUMNS = ["transaction_id", "customer_id", "merchant_id", "amount", "country", "event_timestamp"]


def transaction_features(
    transactions: DataFrame,
    home: str | Iterable[str] = HOME_COUNTRY,
    window_days: int = VISIT_WINDOW_DAYS,
    *,
    slice_rows: int = SLICE_ROWS,
    frame_rows: int = FRAME_ROWS,
    stored: DataFrame | None = None,
    merchants: int = MERCHANTS,
) -> DataFrame:
    """One row per transaction with all 16 customer features.

    ``stored`` are merchant day buckets of older transactions, which then need not be among ``transactions``.

    Customers with more than ``slice_rows`` transactions are sorted and scanned in slices, unless they have more than ``merchants`` merchants; those take
    the sliced way of every single window.

    All features of cool customers are computed behind one partitioning by customer: the transactions
    are shuffled once, and once more with three columns for the day buckets. ``transactions`` is read
    for both and for counting keys, so it should be a stored table.
    """
    check_window(window_days)
    tx = transactions.select(*REPLAY_COLUMNS)
    heat = key_heat([tx], "customer_id", slice_rows)

    shown = ["transaction_id", "customer_id", "merchant_id", "event_timestamp", *CUSTOMER_FEATURES]

    def windows(part: DataFrame, older: DataFrame | None, sliced: bool) -> DataFrame:
        frames_fit = not sliced and heat.largest_cool <= frame_rows
        lists_fit = frames_fit and (stored is None or key_heat([stored], "customer_id", slice_rows).largest <= frame_rows)
        lists_fit = lists_fit and not ids_repeat(tx)
        near = frames_fit and 2 * heat.largest_cool <= NEAR_PLACES and dates_near(tx)
        rolled = add_rolling(part, home, sliced=sliced, frames=frames_fit, near=near)
        return add_visits(rolled, window_days, sliced=sliced, stored=older, lists=lists_fit).select(*shown)

    def build(part: DataFrame, *buckets: DataFrame, sliced: bool) -> DataFrame:
        older = buckets[0] if buckets else None
        if not sliced:
            return windows(part, older, False)
        if heat.largest <= merchants:  # nobody has more merchants than transactions
            return scan_features(part, home, window_days, older).select(*shown)
        wide = part.select("customer_id", "merchant_id").distinct().groupBy(F.col("customer_id").alias("_wide")).count()
        wide = wide.where(F.col("count") > merchants).select("_wide")
        if wide.isEmpty():
            return scan_features(part, home, window_days, older).select(*shown)
        wide, same = cut_lineage(wide), F.expr("customer_id <=> _wide")

        def split(how: str) -> list[DataFrame | None]:
            return [df if df is None else df.join(wide, same, how) for df in (part, older)]

        narrow_part, narrow_older = split("left_anti")
        wide_part, wide_older = split("left_semi")
        scanned = scan_features(narrow_part, home, window_days, narrow_older).select(*shown)
        return scanned.unionByName(windows(wide_part, wide_older, True))

    return apply_by_heat(build, [tx] if stored is None else [tx, stored], "customer_id", heat).select(*shown)


def customer_feature_rows(
    transactions: DataFrame,
    home: str | Iterable[str] = HOME_COUNTRY,
    window_days: int = VISIT_WINDOW_DAYS,
    **limits: int,
) -> DataFrame:
    """Customer feature table keyed by (customer, event time); of equal times the last transaction stays."""
    per_transaction = transaction_features(transactions, home, window_days, **limits)
    last = Window.partitionBy("customer_id", "event_timestamp").orderBy(F.col("transaction_id").desc())
    return (
        per_transaction.withColumn("_rank", F.row_number().over(last))
        .where("_rank = 1")
        .select("customer_id", "event_timestamp", *CUSTOMER_FEATURES)
    )


def merchant_feature_rows(transactions: DataFrame, risk: float | Column = MERCHANT_RISK) -> DataFrame:
    """Merchant feature table keyed by (merchant, event time) with a constant risk score."""
    score = F.lit(risk) if isinstance(risk, (int, float)) else risk
    last = Window.partitionBy("merchant_id", "event_timestamp").orderBy(F.col("transaction_id").desc())
    return (
        transactions.select(
            "merchant_id",
            "event_timestamp",
            score.cast("float").alias("merchant_risk_score"),
            "merchant_category",
            F.row_number().over(last).alias("_rank"),
        )
        .where("_rank = 1")
        .drop("_rank")
    )
