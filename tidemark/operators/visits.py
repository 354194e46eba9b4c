"""Merchant-visit features: how a customer has used the current merchant before.

The window is calendar days in UTC: the ``N - 1`` days before the transaction's day plus that day
up to, but not including, the transaction itself.

What happened on earlier days is the same for every transaction of a day, so it is prepared once
per (customer, day, merchant) from day buckets. What happened on the day itself is counted while
the day's transactions pass by. No (transaction, merchant) pairs are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import days_between, epoch_ms, half_up_ratio, utc_day
from tidemark.operators.running import SLICE_ROWS, apply_by_heat, by_key, key_heat, running
from tidemark.schemas import VISIT_WINDOW_DAYS


# Up to this many rows per customer the merchants of a day's window are a list beside each of its transactions.
LIST_ROWS = 2_000


def check_window(window_days: int) -> int:
    if window_days < 1:
        raise ValueError("the merchant visit window must be at least 1 day")
    return window_days


def merchant_day_buckets(transactions: DataFrame) -> DataFrame:
    """Visits per (customer, UTC day, merchant) with the first and last moment."""
    return (
        transactions.selectExpr("customer_id", "merchant_id", f"{epoch_ms('event_timestamp')} AS ms")
        .selectExpr("customer_id", f"{utc_day('ms')} AS day", "merchant_id", "ms")
        .groupBy("customer_id", "day", "merchant_id")
        .agg(F.expr("count(1) AS visits"), F.expr("min(ms) AS first_ms"), F.expr("max(ms) AS last_ms"))
    )


def merge_buckets(buckets: DataFrame) -> DataFrame:
    """One bucket per (customer, day, merchant) from buckets of any parts of the transactions."""
    return buckets.groupBy("customer_id", "day", "merchant_id").agg(
        F.expr("sum(visits) AS visits"), F.expr("min(first_ms) AS first_ms"), F.expr("max(last_ms) AS last_ms")
    )


def merchant_window(
    buckets: DataFrame, window_days: int = VISIT_WINDOW_DAYS, *, together: bool = False
) -> DataFrame:
    """Per customer, active day and merchant: the buckets of the window's earlier days merged.

    A bucket is handed forward to the days of its customer that lie within the window, at most
    ``window_days - 1`` of them, whatever the number of transactions. The days ahead are found among
    the customer's distinct days; with ``together``, for buckets already partitioned by customer,
    they are found in place, which saves the join.
    """
    if check_window(window_days) > 1:
        ahead = (
            "collect_set(day) OVER (PARTITION BY customer_id ORDER BY day "
            f"RANGE BETWEEN 1 FOLLOWING AND {window_days - 1} FOLLOWING) AS ahead"
        )
    else:
        ahead = "cast(array() AS array<int>) AS ahead"
    if together:
        rows = buckets.selectExpr("*", ahead)
    else:
        days = buckets.select("customer_id", "day").distinct().selectExpr("customer_id", "day", ahead)
        rows = buckets.join(days, ["customer_id", "day"])
    return (
        rows.selectExpr("customer_id", "merchant_id", "visits", "first_ms", "last_ms", "explode(ahead) AS day")
        .groupBy("customer_id", "day", "merchant_id")
        .agg(F.expr("sum(visits) AS visits"), F.expr("min(first_ms) AS first_ms"), F.expr("max(last_ms) AS last_ms"))
    )


def merchant_visit_features(
    transactions: DataFrame, window_days: int = VISIT_WINDOW_DAYS, *, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``transactions`` plus the nine merchant-visit features."""
    check_window(window_days)
    heat = key_heat([transactions], "customer_id", slice_rows)

    def build(tx: DataFrame, sliced: bool) -> DataFrame:
        lists = not sliced and heat.largest_cool <= LIST_ROWS and not ids_repeat(transactions)
        return add_visits(tx, window_days, sliced=sliced, lists=lists)

    return apply_by_heat(build, [transactions], "customer_id", heat)


def ids_repeat(transactions: DataFrame) -> bool:
    """Whether a customer has rows of the same transaction; such rows stay with the way that makes one row of them."""
    largest = transactions.groupBy("customer_id", "transaction_id").agg(F.count(F.lit(1)).alias("n")).selectExpr("max(n) AS n").first()["n"]
    return (largest or 0) > 1


def add_visits(
    tx: DataFrame, window_days: int = VISIT_WINDOW_DAYS, *, sliced: bool, stored: DataFrame | None = None, lists: bool = False
) -> DataFrame:
    """``stored`` are day buckets of transactions that are not among ``tx``; with ``lists`` every customer has few rows in both, of different ids."""
    source = tx if sliced else by_key(tx, "customer_id")
    buckets = merchant_day_buckets(source)
    if stored is not None:
        buckets = merge_buckets(buckets.unionByName(stored if sliced else by_key(stored, "customer_id")))
    day_key = ["customer_id", "day"]

    others = [c for c in tx.columns if c not in ("customer_id", "merchant_id", "transaction_id")]
    if lists:
        return _finish(_by_lists(source, merchant_window(buckets, window_days, together=not sliced), others), tx.columns)
    visits = source.selectExpr(
        "customer_id",
        "merchant_id",
        "transaction_id",
        f"{epoch_ms('event_timestamp')} AS ms",
        f"struct({', '.join(others)}) AS tx",
    ).selectExpr(
        "customer_id",
        f"{utc_day('ms')} AS day",
        "merchant_id",
        "1 AS today",
        "ms",
        "transaction_id",
        "1L AS visits",
        "ms AS first_ms",
        "ms AS last_ms",
        "tx",
    )
    # Earlier days enter as if they had been visited at the very start of the day.
    earlier = merchant_window(buckets, window_days, together=not sliced).selectExpr(
        "customer_id",
        "day",
        "merchant_id",
        "0 AS today",
        "cast(null AS bigint) AS ms",
        "cast(null AS string) AS transaction_id",
        "visits",
        "first_ms",
        "last_ms",
    )
    rows = earlier.unionByName(visits, allowMissingColumns=True)

    # Visits to the current merchant so far.
    rows = running(
        rows,
        [*day_key, "merchant_id"],
        ["today", "ms", "transaction_id"],
        {
            "known": ("sum", "visits"),
            "first_seen": ("min", "first_ms"),
            "last_seen": ("max", "last_ms"),
            "came_today": ("max", "today"),
        },
        before=True,
        sliced=sliced,
    ).selectExpr("*", "coalesce(known, 0L) AS so_far")

    # All merchants of the customer so far. A count only grows within a day, so the leader is the
    # best count ever reached, on equal counts the smallest merchant id.
    rows = running(
        rows,
        day_key,
        ["today", "ms", "transaction_id", "merchant_id"],
        {
            "all_visits": ("sum", "visits"),
            "merchants": ("sum", "if(so_far = 0, 1L, 0L)"),
            "leader": ("min", "named_struct('negated', -(so_far + visits), 'merchant_id', merchant_id)"),
        },
        before=True,
        sliced=sliced,
    ).selectExpr("*", "if(today = 1, so_far, visits) AS level")

    # Merchants that were ahead of the current one when the day began, at its present count.
    rows = running(
        rows,
        day_key,
        ["level DESC", "merchant_id", "today DESC", "ms", "transaction_id"],
        {"ahead_at_dawn": ("sum", "1L - today")},
        before=True,
        sliced=sliced,
    ).where("today = 1")

    return _finish(_add_overtakes(rows, sliced), tx.columns)


def _smaller(a: str, b: str) -> str:
    """Order of merchant ids, the empty one first."""
    return f"coalesce({a} < {b}, {a} IS NULL AND {b} IS NOT NULL)"


def _by_lists(tx: DataFrame, earlier: DataFrame, others: list[str]) -> DataFrame:
    """What ``_finish`` needs, for customers with few rows: a day's earlier merchants are one list, which passes along its transactions.

    So only transactions and one row per day are sorted, not one row per day and merchant. A transaction looks through the list and through the
    day's transactions ahead of it, both bounded by the rows of its customer.
    """
    dawn = earlier.groupBy("customer_id", "day").agg(
        F.expr("collect_list(struct(merchant_id, visits, first_ms, last_ms)) AS dawn"),
        F.expr("sum(visits) AS dawn_visits"),
        F.expr("min(struct(-visits AS negated, merchant_id)) AS dawn_leader"),
    )
    own = "OVER (PARTITION BY customer_id, day, merchant_id ORDER BY ms, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    visits = tx.selectExpr(
        "customer_id", "merchant_id", "transaction_id", f"{epoch_ms('event_timestamp')} AS ms", f"struct({', '.join(others)}) AS tx"
    ).selectExpr("*", f"{utc_day('ms')} AS day", "1 AS today").selectExpr(
        "*", f"count(1) {own} AS came", f"min(ms) {own} AS first_today", f"max(ms) {own} AS last_today"
    )
    so = (
        "OVER (PARTITION BY customer_id, day ORDER BY today, ms, transaction_id, merchant_id, came "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    rows = dawn.selectExpr("*", "0 AS today").unionByName(visits, allowMissingColumns=True).selectExpr(
        "* EXCEPT (dawn, dawn_visits, dawn_leader)",
        f"first(dawn, true) {so} AS dawn", f"first(dawn_visits, true) {so} AS dawn_visits", f"first(dawn_leader, true) {so} AS dawn_leader",
    ).where("today = 1").selectExpr("*", "try_element_at(filter(dawn, d -> d.merchant_id <=> merchant_id), 1) AS known")
    rows = rows.selectExpr(
        "* EXCEPT (known, first_today, last_today)",
        "coalesce(known.visits, 0L) + came AS so_far",
        "least(known.first_ms, first_today) AS first_seen",
        "greatest(known.last_ms, last_today) AS last_seen",
    ).selectExpr(
        "*",
        f"coalesce(dawn_visits, 0L) + count(1) {so} AS all_visits",
        f"coalesce(size(dawn), 0) + coalesce(sum(if(so_far = 0, 1L, 0L)) {so}, 0L) AS merchants",
        f"least(dawn_leader, min(struct(-(so_far + 1) AS negated, merchant_id)) {so}) AS leader",
        f"collect_list(struct(so_far AS level, merchant_id)) {so} AS ahead",
    )
    at_dawn = f"filter(dawn, d -> d.visits > so_far OR (d.visits = so_far AND {_smaller('d.merchant_id', 'merchant_id')}))"
    passed = (
        f"filter(ahead, a -> (a.level = so_far AND {_smaller('merchant_id', 'a.merchant_id')}) "
        f"OR (a.level = so_far - 1 AND {_smaller('a.merchant_id', 'merchant_id')}))"
    )
    return rows.selectExpr(
        "* EXCEPT (dawn, ahead)", f"if(dawn IS NULL, 0L, cast(size({at_dawn}) AS bigint)) AS ahead_at_dawn", f"cast(size({passed}) AS bigint) AS overtakes"
    )


def _add_overtakes(rows: DataFrame, sliced: bool) -> DataFrame:
    """Count the merchants that moved ahead of the current one earlier on the same day.

    A visit lifts its merchant from level ``a`` to ``a + 1``. Seen from a merchant at level ``c``
    that is an overtake if ``a = c`` and its id is larger (it was behind on the tie), or if
    ``a = c - 1`` and its id is smaller (now ahead on the tie). Each merchant does that at most
    once a day, so overtakes can simply be counted.

    "Earlier and with a smaller id" is counted on blocks of ids: the merchants of a day get a
    number, a number ``q`` covers all smaller ones by one block per 1-bit, and each visit is
    present in the blocks around its own number. That is a logarithmic number of rows per visit
    instead of pairs of visits.
    """
    day_key = ["customer_id", "day"]
    rows = running(
        rows,
        day_key,
        ["merchant_id", "ms", "transaction_id"],
        {"ordinal": ("sum", "if(coalesce(came_today, 0) = 0, 1L, 0L)")},
        sliced=sliced,
    ).selectExpr("*", "ordinal - 1 AS number")
    rows = running(
        rows,
        day_key,
        ["merchant_id DESC", "ms DESC", "transaction_id DESC"],
        {"highest": ("max", "number")},
        sliced=sliced,
    )

    def entry(level: str, bit: str, block: str, sign: int, presents: int) -> str:
        return (
            f"named_struct('at_level', {level}, 'bit', {bit}, 'block', {block}, "
            f"'sign', {sign}L, 'presents', {presents}L)"
        )

    rows = rows.selectExpr("*", "filter(sequence(0, 62), b -> shiftright(highest, b) > 0) AS bits").selectExpr(
        "*",
        "filter(bits, b -> shiftright(number, b) & 1L = 1L) AS ones",
        "filter(bits, b -> shiftright(number, b) & 1L = 0L) AS zeros",
    )
    present = (
        f"array({entry('level', '-1', '0L', 0, 1)}), "
        f"transform(zeros, b -> {entry('level', 'b', 'shiftright(number, b)', 0, 1)})"
    )
    asks = (
        f"array({entry('level', '-1', '0L', 1, 0)}), "
        f"transform(ones, b -> {entry('level', 'b', 'shiftright(number, b) - 1', -1, 0)}), "
        f"transform(ones, b -> {entry('level - 1', 'b', 'shiftright(number, b) - 1', 1, 0)})"
    )
    kept = "tx, merchant_id, so_far, first_seen, last_seen, all_visits, merchants, leader, ahead_at_dawn"
    spread = rows.selectExpr(
        *day_key,
        "ms",
        "transaction_id",
        f"struct({kept}) AS row",
        f"posexplode(if(level > 0, concat({present}, {asks}), concat({present}))) AS (place, entry)",
    ).selectExpr(*day_key, "ms", "transaction_id", "if(place = 0, row, null) AS row", "entry.*")
    # A merchant passes a level once a day, so these groups are bounded by the number of
    # merchants, however many rows the customer has; that number has no bound either.
    counted = running(
        spread,
        [*day_key, "at_level", "bit", "block"],
        ["ms", "transaction_id", "presents", "sign"],
        {"present_before": ("sum", "presents")},
        before=True,
        sliced=sliced,
    )
    return (
        counted.groupBy("customer_id", "transaction_id", "ms")
        .agg(F.expr("sum(sign * coalesce(present_before, 0L)) AS overtakes"), F.expr("first(row, true) AS row"))
        .selectExpr("customer_id", "transaction_id", "ms", "row.*", "overtakes")
    )


def _finish(rows: DataFrame, columns: list[str]) -> DataFrame:
    keys = ("customer_id", "merchant_id", "transaction_id")
    rows = rows.selectExpr(
        "*",
        "coalesce(all_visits, 0L) AS total",
        "if(so_far = 0, 0L, 1L + coalesce(ahead_at_dawn, 0L) + overtakes) AS rank",
    )
    # The key columns stay as they are, which keeps the partitioning by customer known.
    return rows.selectExpr(
        *[c if c in keys else f"tx.{c} AS {c}" for c in columns],
        "so_far AS current_merchant_visit_count_30d",
        f"if(total = 0, 0.0D, {half_up_ratio('so_far', 'greatest(total, 1L)', 6)}) AS current_merchant_visit_share_30d",
        "rank AS current_merchant_rank_30d",
        "if(rank = 1, 1L, 0L) AS is_current_merchant_top_visited_30d",
        f"if(so_far = 0, -1.0D, {days_between('first_seen', 'ms')}) AS days_since_first_seen_current_merchant",
        f"if(so_far = 0, -1.0D, {days_between('last_seen', 'ms')}) AS days_since_last_seen_current_merchant",
        "coalesce(merchants, 0L) AS customer_distinct_merchants_30d",
        "if(so_far = 0, 1L, 0L) AS is_new_merchant_for_customer",
        "coalesce(leader.merchant_id, '') AS top_visited_merchant_id_30d",
    )
