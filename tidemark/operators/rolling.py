"""Rolling customer statistics over 1 hour, 24 hours and 7 days of event time.

Every window is ``[t - W, t]`` in milliseconds, both ends included, per customer, and holds the
current transaction. Transactions inside one millisecond count in order of transaction id.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidemark.functions.scalars import DAY_MS, HOUR_MS, epoch_ms, half_up_ratio, is_cross_border, to_cents
from tidemark.operators.running import SLICE_ROWS, apply_by_heat, by_key, key_heat, running
from tidemark.schemas import HOME_COUNTRY

WINDOW_1H = HOUR_MS
WINDOW_24H = DAY_MS
WINDOW_7D = 7 * DAY_MS

# Places of one millisecond in the order of a customer, and those that fit a bigint beside dates up to the year 37 000.
_PLACES = 10**12
NEAR_PLACES, NEAR_MS = 2**12, 2**50

# A range frame is re-read for every row. Beyond this many rows per customer running sums,
# whose cost does not depend on the window, are cheaper.
FRAME_ROWS = 2_000


def rolling_customer_stats(
    transactions: DataFrame,
    home: str | Iterable[str] = HOME_COUNTRY,
    *,
    slice_rows: int = SLICE_ROWS,
    frame_rows: int = FRAME_ROWS,
) -> DataFrame:
    """``transactions`` plus the seven rolling features.

    Expects validated, deduplicated rows with ``transaction_id``, ``customer_id``, ``merchant_id``,
    ``amount``, ``country`` and ``event_timestamp``.
    """
    heat = key_heat([transactions], "customer_id", slice_rows)

    def build(tx: DataFrame, sliced: bool) -> DataFrame:
        frames_fit = not sliced and heat.largest_cool <= frame_rows
        near = frames_fit and 2 * heat.largest_cool <= NEAR_PLACES and dates_near(transactions)
        return add_rolling(tx, home, sliced=sliced, frames=frames_fit, near=near)

    return apply_by_heat(build, [transactions], "customer_id", heat)


def dates_near(transactions: DataFrame) -> bool:
    """Whether a bigint holds every moment with ``NEAR_PLACES`` places behind it."""
    furthest = transactions.selectExpr(f"max(abs({epoch_ms('event_timestamp')})) AS ms").first()["ms"]
    return furthest is None or furthest < NEAR_MS


def add_rolling(
    tx: DataFrame, home: str | Iterable[str] = HOME_COUNTRY, *, sliced: bool, frames: bool, near: bool = False
) -> DataFrame:
    """``frames`` suits customers with few rows; with ``near`` half of ``NEAR_PLACES`` at most and ``dates_near`` holds."""
    rows = tx.selectExpr(
        "*",
        f"{epoch_ms('event_timestamp')} AS _ms",
        f"{to_cents('amount')} AS _cents",
        f"cast({is_cross_border('country', home)} AS bigint) AS _abroad",
    )
    sums = _by_frames(rows, near) if frames else _by_running_sums(rows, sliced)
    return sums.selectExpr(
        *tx.columns,
        "_n1h AS customer_transaction_count_1h",
        "_n24h AS customer_transaction_count_24h",
        "_sum24h / 100.0D AS customer_total_amount_24h",
        f"{half_up_ratio('_sum7d', 'greatest(1L, _n7d)', 0)} / 100.0D AS customer_avg_amount_7d",
        "_max7d / 100.0D AS customer_max_amount_7d",
        "_merchants24h AS customer_distinct_merchants_24h",
        "_abroad7d AS customer_cross_border_count_7d",
    )


def _by_frames(rows: DataFrame, near: bool) -> DataFrame:
    """One range frame per window, all on the same sort.

    The order key is the millisecond with the position inside it, so that a frame ends at the
    current transaction and not at its last neighbour of the same millisecond. As a decimal it holds any
    timestamp, and more rows of one millisecond than a task can hold; as a bigint, with ``near``, it is compared much faster.
    """
    peers = "row_number() OVER (PARTITION BY customer_id, _ms ORDER BY transaction_id)"
    places, kind = (NEAR_PLACES, "L") if near else (_PLACES, "BD")
    moment = "_ms" if near else "cast(_ms AS decimal(19, 0))"
    rows = by_key(rows, "customer_id").selectExpr("*", f"{moment} * {places}{kind} + {peers} AS _at")

    def over(width_ms: int) -> str:
        # Rows of a millisecond take half of its places at most, so half of them reach its first one and no earlier millisecond.
        reach = width_ms * places + places // 2
        return f"OVER (PARTITION BY customer_id ORDER BY _at RANGE BETWEEN {reach}{kind} PRECEDING AND CURRENT ROW)"

    hour, day, week = over(WINDOW_1H), over(WINDOW_24H), over(WINDOW_7D)
    return rows.selectExpr(
        "*",
        f"count(1) {hour} AS _n1h",
        f"count(1) {day} AS _n24h",
        f"sum(_cents) {day} AS _sum24h",
        f"cast(size(collect_set(merchant_id) {day}) AS bigint) AS _merchants24h",
        f"count(1) {week} AS _n7d",
        f"sum(_cents) {week} AS _sum7d",
        f"max(_cents) {week} AS _max7d",
        f"sum(_abroad) {week} AS _abroad7d",
    )


# Running totals and what a transaction adds when it enters.
_TOTALS = {
    "_n1h": "1",
    "_n24h": "1",
    "_sum24h": "_cents",
    "_merchants24h": "1",
    "_n7d": "1",
    "_sum7d": "_cents",
    "_abroad7d": "_abroad",
}


def _change(at: str, by: str, enters: int, phase: int, **deltas: str) -> str:
    amounts = ", ".join(f"'d{name}', cast({deltas.get(name, '0')} AS bigint)" for name in _TOTALS)
    return f"named_struct('at', {at}, 'by', {by}, 'enters', {enters}, 'phase', {phase}, {amounts})"


def _by_running_sums(rows: DataFrame, sliced: bool) -> DataFrame:
    """Windows as running sums: a transaction adds itself when it happens and takes itself out when it leaves.

    A merchant leaves the 24 hour set when its transaction expires; if the same merchant comes again
    before that, the newer transaction takes over the place at its own turn. The 7 day maximum is
    not a difference of sums, so time is cut into blocks as long as the window: a window covers the
    end of one block and the start of the next, a running maximum backwards and one forwards.
    """
    if not sliced:
        rows = by_key(rows, "customer_id")
    columns = rows.columns
    rows = running(
        rows,
        ["customer_id", "merchant_id"],
        ["_ms DESC", "transaction_id DESC"],
        {"_again": ("last", "struct(_ms, transaction_id)")},
        before=True,
        sliced=sliced,
    )

    # Phase 0: leaving ahead of everything that happens at that moment; phase 1: at its turn.
    replaced = f"coalesce(_again._ms <= _ms + {WINDOW_24H}, false)"
    changes = [
        _change("_ms", "transaction_id", 1, 1, **_TOTALS),
        _change(f"_ms + {WINDOW_1H + 1}", "transaction_id", 0, 0, _n1h="-1"),
        _change(
            f"_ms + {WINDOW_24H + 1}", "transaction_id", 0, 0, _n24h="-1", _sum24h="-_cents",
            _merchants24h=f"if({replaced}, 0, -1)",
        ),
        _change(f"_ms + {WINDOW_7D + 1}", "transaction_id", 0, 0, _n7d="-1", _sum7d="-_cents", _abroad7d="-_abroad"),
    ]
    handover = _change("_again._ms", "_again.transaction_id", 0, 1, _merchants24h="-1")
    listed = ", ".join(changes)
    # Only the entering row carries the transaction; the leaving rows stay narrow.
    moves = rows.selectExpr(
        "customer_id",
        f"struct({', '.join(columns)}) AS _tx",
        f"explode(if({replaced}, array({listed}, {handover}), array({listed}))) AS _move",
    ).selectExpr(
        "customer_id",
        "if(_move.enters = 1, _tx, null) AS _tx",
        "if(_move.enters = 1, _tx._cents, null) AS _cents",
        f"_move.at DIV {WINDOW_7D + 1}L AS _block",
        *[f"_move.{name} AS _{name}" for name in ("at", "by", "enters", "phase")],
        *[f"_move.d{name} AS _d{name}" for name in _TOTALS],
    )
    turn = ["_at", "_phase", "_by", "_enters"]
    moves = running(
        moves,
        ["customer_id"],
        ["_block", *turn],
        {name: ("sum", f"_d{name}") for name in _TOTALS},
        sliced=sliced,
    )
    moves = running(
        moves, ["customer_id", "_block"], turn, {"_max_here": ("max", "_cents")}, sliced=sliced
    ).where("_enters = 1")

    sides = moves.selectExpr(
        "customer_id",
        "_by",
        "_cents",
        *_TOTALS,
        "_max_here",
        "_tx",
        "explode(array("
        "named_struct('block', _block, 'at', _at, 'asks', 0), "
        f"named_struct('block', _block - 1, 'at', _at - {WINDOW_7D}L, 'asks', 1))) AS _side",
    ).selectExpr("*", "_side.block AS _look", "_side.at AS _from", "_side.asks AS _asks")
    return (
        running(
            sides,
            ["customer_id", "_look"],
            ["_from DESC", "_asks", "_by"],
            {"_max_before": ("max", "if(_asks = 0, _cents, null)")},
            sliced=sliced,
        )
        .where("_asks = 1")
        .selectExpr(
            "customer_id",
            *[f"_tx.{c} AS {c}" for c in columns if c != "customer_id"],
            *_TOTALS,
            "greatest(_max_here, _max_before) AS _max7d",
        )
    )
