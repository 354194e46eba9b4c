"""All customer features of hot customers in one sort and one scan.

Every transaction becomes four moves: it enters, and leaves the hour, the day and the week. The moves are sorted by range of (customer, moment), so a
customer, even one moment of it, spreads over as many slices as its rows need. A slice is scanned by one task, which starts from what the
slices ahead left behind for its first customer, the *carry*:

* sums of the windows: running totals over the slices,
* how often each merchant is in the day's window,
* the visits per day and merchant in the visit window, and
* the amounts of the week that no later one exceeds, from which the maximum of a moving window is read.

All of it is computed per slice first and handed on between slices, so no task sees more than a slice of moves and the merchants of one
customer in its window. Customers with more merchants than a task should hold stay with ``running(..., sliced=True)``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_MS, HOUR_MS, epoch_ms, is_cross_border, to_cents, utc_day
from tidemark.schemas import CUSTOMER_FEATURES, HOME_COUNTRY
from tidemark.session import cut_lineage
from tidemark.streaming.memory import WEEK_MS, Standing, half_up

#: Merchants of one customer that a task holds.
MERCHANTS = 500_000

# What a move does; by sum, the move that takes out again what entered, and how much that is.
_ENTER, _HOUR, _DAY, _WEEK = range(4)
_SUMS = {
    "n1h": (_HOUR, "1L"), "n24h": (_DAY, "1L"), "sum24h": (_DAY, "cents"), "n7d": (_WEEK, "1L"), "sum7d": (_WEEK, "cents"), "abroad7d": (_WEEK, "abroad")
}
_ORDER = ["ckey", "at", "phase", "transaction_id", "what"]

# Kinds of rows of a slice: carries come ahead of the moves.
_CARRY, _PRESENT, _BUCKET, _STAIR, _MOVE = range(5)
_ROW = (
    "slice int, ckey string, kind int, place bigint, customer_id string, transaction_id string, merchant_id string, micros bigint, "
    "at bigint, what int, cents bigint, abroad bigint, n1h bigint, n24h bigint, sum24h bigint, n7d bigint, sum7d bigint, abroad7d bigint"
)
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]
_FEATURES = "customer_id string, transaction_id string, merchant_id string, micros bigint, " + ", ".join(
    f"{name} {kind}" for name, kind in CUSTOMER_FEATURES.items()
)


def _moves(tx: DataFrame, home: str | Iterable[str]) -> DataFrame:
    leaves = ", ".join(
        f"named_struct('at', ms + {width + 1}L, 'phase', 0, 'what', {what})" for what, width in ((_HOUR, HOUR_MS), (_DAY, DAY_MS), (_WEEK, WEEK_MS))
    )
    return tx.selectExpr(
        "customer_id", "coalesce(concat('c', customer_id), '') AS ckey", "transaction_id", "merchant_id",
        "unix_micros(cast(event_timestamp AS timestamp)) AS micros",
        f"{epoch_ms('event_timestamp')} AS ms",
        f"{to_cents('amount')} AS cents",
        f"cast({is_cross_border('country', home)} AS bigint) AS abroad",
    ).selectExpr("*", f"inline(array(named_struct('at', ms, 'phase', 1, 'what', {_ENTER}), {leaves}))").drop("ms")


def _delta(name: str) -> str:
    """What a move adds to a window."""
    leave, of = _SUMS[name]
    return f"CASE what WHEN {_ENTER} THEN {of} WHEN {leave} THEN -({of}) ELSE 0L END"


def scan_features(
    tx: DataFrame, home: str | Iterable[str] = HOME_COUNTRY, window_days: int = 30, stored: DataFrame | None = None
) -> DataFrame:
    """One row per transaction: transaction_id, customer_id, merchant_id, event_timestamp and the 16 customer features."""
    kind = dict(tx.dtypes)["event_timestamp"]
    by_range = [F.col(c) for c in _ORDER]
    moves = _moves(tx, home).repartitionByRange(*by_range).sortWithinPartitions(*by_range)
    # Slice bounds come from a sample, so the slices are stored before they are used more than once.
    moves = cut_lineage(moves.selectExpr("*", "spark_partition_id() AS slice", "monotonically_increasing_id() AS place"))

    segments = moves.groupBy("ckey", "slice").agg(F.expr("min(at) AS at0"), *[F.expr(f"sum({_delta(n)}) AS {n}") for n in _SUMS])
    # One row per slice and customer: these windows hold a customer's slices, not its rows.
    ahead = "OVER (PARTITION BY ckey ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = segments.selectExpr("ckey", "slice", *[f"sum({n}) {ahead} AS {n}" for n in _SUMS]).where("n7d IS NOT NULL")
    span = segments.groupBy("ckey").agg(F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice"))
    # A bound of two slices lies in one customer, so there are fewer customers in several slices than slices.
    crossing = F.broadcast(span.where("first_slice < last_slice"))
    handing = moves.join(crossing, "ckey")

    present = (
        handing.where(f"what IN ({_ENTER}, {_DAY})").groupBy("ckey", "merchant_id", "slice").agg(F.expr(f"sum({_delta('n24h')}) AS n24h"))
        .selectExpr(
            "ckey", "merchant_id", "slice", "sum(n24h) OVER (PARTITION BY ckey, merchant_id ORDER BY slice) AS n24h",
            "lead(slice) OVER (PARTITION BY ckey, merchant_id ORDER BY slice) AS again",
        )
        .where("n24h > 0").join(crossing, "ckey").where("slice < last_slice")
        .selectExpr("ckey", "merchant_id", "n24h", "explode(sequence(slice + 1, coalesce(again, last_slice))) AS slice")
    )

    rows = [
        _rows(sums, _CARRY), _rows(present, _PRESENT), _rows(_bucket_carry(handing, segments, span, window_days, stored), _BUCKET),
        _rows(_stair_carry(handing, segments.join(crossing, "ckey")), _STAIR), _rows(moves, _MOVE),
    ]
    together = rows[0]
    for more in rows[1:]:
        together = together.unionByName(more)
    partitions = int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = together.repartition(partitions, "slice").sortWithinPartitions("slice", "ckey", "kind", "place").mapInPandas(
        _scanner(window_days), _FEATURES
    )
    return found.selectExpr(
        "transaction_id", "customer_id", "merchant_id", f"cast(timestamp_micros(micros) AS {kind}) AS event_timestamp", *CUSTOMER_FEATURES
    )


def _rows(df: DataFrame, kind: int) -> DataFrame:
    """``df`` in the columns of a slice's rows; numbers it does not have are 0, so that pandas keeps whole numbers."""
    types = dict(c.split() for c in _ROW.split(", "))
    absent = {c: "null" if t == "string" else "0" for c, t in types.items()} | {"kind": str(kind)}
    return df.selectExpr(*[f"cast({c if c in df.columns else absent[c]} AS {types[c]}) AS {c}" for c in _COLUMNS])


def _bucket_carry(moves: DataFrame, segments: DataFrame, span: DataFrame, window_days: int, stored: DataFrame | None) -> DataFrame:
    """Visits per day and merchant ahead of each slice, as far as its window reaches; n1h, n24h, sum24h hold visits, first and last moment, at the day."""
    buckets = (
        moves.where(f"what = {_ENTER}")
        .selectExpr("ckey", f"{utc_day('at')} AS day", "merchant_id", "slice", "at")
        .groupBy("ckey", "day", "merchant_id", "slice")
        .agg(F.expr("count(1) AS n1h"), F.expr("min(at) AS n24h"), F.expr("max(at) AS sum24h"))
    )
    if stored is not None:
        older = stored.selectExpr(
            "coalesce(concat('c', customer_id), '') AS ckey", "day", "merchant_id", "visits AS n1h", "first_ms AS n24h", "last_ms AS sum24h"
        ).join(span.selectExpr("ckey", "first_slice - 1 AS slice"), "ckey")
        buckets = buckets.unionByName(older)
    over = "OVER (PARTITION BY ckey, day, merchant_id ORDER BY slice)"
    buckets = buckets.selectExpr(
        "ckey", "day", "merchant_id", "slice", f"sum(n1h) {over} AS n1h", f"min(n24h) {over} AS n24h", f"max(sum24h) {over} AS sum24h",
        f"lead(slice) {over} AS again",
    )
    # The last slice whose first move lies on a day that still sees the bucket's day; one row per slice and per day of a customer.
    starts = segments.selectExpr("ckey", f"{utc_day('at0')} AS day", "slice", "0 AS asks")
    asked = buckets.selectExpr("ckey", f"day + {window_days - 1} AS day", "cast(null AS int) AS slice", "1 AS asks").distinct()
    until = starts.unionByName(asked).selectExpr(
        "ckey", f"day - {window_days - 1} AS day", "asks", "max(slice) OVER (PARTITION BY ckey ORDER BY day, asks) AS until"
    ).where("asks = 1 AND until IS NOT NULL").drop("asks")
    return buckets.join(until, ["ckey", "day"]).where("slice < until").selectExpr(
        "ckey", "merchant_id", "cast(day AS bigint) AS at", "n1h", "n24h", "sum24h", "explode(sequence(slice + 1, least(coalesce(again, until), until))) AS slice"
    )


def _stairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each slice and customer the amounts that no later one reaches, in order of time."""
    held: tuple | None = None
    stair: list[tuple[int, int]] = []

    def out() -> pd.DataFrame:
        return pd.DataFrame([(*held, at, cents) for at, cents in stair], columns=["slice", "ckey", "at", "cents"])

    for batch in batches:
        for number, ckey, at, cents in batch[["slice", "ckey", "at", "cents"]].itertuples(index=False):
            if (number, ckey) != held:
                if held:
                    yield out()
                held, stair = (number, ckey), []
            while stair and stair[-1][1] <= cents:
                stair.pop()
            stair.append((at, cents))
    if held:
        yield out()


def _handed_on(slices: pd.DataFrame) -> pd.DataFrame:
    """The amounts of a customer's last week ahead of each of its slices; a row without an amount stands for a slice."""
    out, stair = [], deque()
    for (number,), part in slices.sort_values(["slice", "at"], kind="stable").groupby(["slice"]):
        start = int(part["at0"].iloc[0])
        while stair and stair[0][0] < start - WEEK_MS:
            stair.popleft()
        out += [(slices["ckey"].iloc[0], number, at, cents) for at, cents in stair]
        for at, cents in part.loc[part["cents"].notna(), ["at", "cents"]].astype("int64").itertuples(index=False):
            while stair and stair[-1][1] <= cents:
                stair.pop()
            stair.append((at, cents))
    return pd.DataFrame(out, columns=["ckey", "slice", "at", "cents"])


def _stair_carry(moves: DataFrame, segments: DataFrame) -> DataFrame:
    own = moves.where(f"what = {_ENTER}").select("slice", "ckey", "at", "cents").mapInPandas(_stairs, "slice int, ckey string, at bigint, cents bigint")
    # A customer's slices and their few standing amounts meet in one task, not its rows.
    return segments.select("ckey", "slice", "at0").join(own, ["ckey", "slice"], "left").groupBy("ckey").applyInPandas(
        _handed_on, "ckey string, slice int, at bigint, cents bigint"
    ).selectExpr("ckey", "slice", "at", "cents", "at AS place")


def _scanner(window_days: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: list[pd.DataFrame] = []
        key = None
        for batch in batches:
            if not len(batch):
                continue
            numbers, names = batch["slice"].to_numpy(), batch["ckey"].to_numpy()
            cuts = (np.flatnonzero((numbers[1:] != numbers[:-1]) | (names[1:] != names[:-1])) + 1).tolist()
            if open_rows and (numbers[0], names[0]) != key:
                cuts = [0, *cuts]
            key = numbers[-1], names[-1]
            if cuts:
                # All customers but the last of the batch are complete.
                yield _scan(pd.concat([*open_rows, batch.iloc[: cuts[-1]]], ignore_index=True), window_days)
                open_rows = []
            open_rows.append(batch.iloc[cuts[-1] if cuts else 0 :])
        if open_rows:
            yield _scan(pd.concat(open_rows, ignore_index=True), window_days)

    return run


def _scan(rows: pd.DataFrame, window_days: int) -> pd.DataFrame:
    """Features of all transactions in complete stretches of (slice, customer)."""
    numbers, names = rows["slice"].to_numpy(), rows["ckey"].to_numpy()
    cuts = (np.flatnonzero((numbers[1:] != numbers[:-1]) | (names[1:] != names[:-1])) + 1).tolist()
    columns = {c: rows[c].to_numpy() for c in ("kind", "merchant_id", "at", "what", "cents", "abroad", *_SUMS)}
    out: list[list] = []
    for low, high in zip([0, *cuts], [*cuts, len(rows)]):
        out += _segment({c: v[low:high] for c, v in columns.items()}, window_days)
    entering = (columns["kind"] == _MOVE) & (columns["what"] == _ENTER)
    shown = rows.loc[entering, ["customer_id", "transaction_id", "merchant_id", "micros"]].reset_index(drop=True)
    return pd.concat([shown, pd.DataFrame(out, columns=list(CUSTOMER_FEATURES))], axis=1)


def _segment(rows: dict[str, np.ndarray], window_days: int) -> list[list]:
    """Features of one customer's transactions in one slice, in their order."""
    first = int(np.searchsorted(rows["kind"], _MOVE))
    bounds = np.searchsorted(rows["kind"][:first], [_CARRY, _PRESENT, _BUCKET, _STAIR, _MOVE]).tolist()

    def carried(kind: int, *columns: str) -> list[list]:
        return [rows[c][bounds[kind] : bounds[kind + 1]].tolist() for c in columns]

    what, cents = rows["what"][first:], rows["cents"][first:]
    enters = np.flatnonzero(what == _ENTER)
    start = {n: sum(carried(_CARRY, n)[0]) for n in _SUMS}

    def window(name: str, of: np.ndarray | int) -> list[int]:
        moved = np.where(what == _ENTER, of, 0) - np.where(what == _SUMS[name][0], of, 0)
        return (start[name] + np.cumsum(moved))[enters].tolist()

    n1, n24, sum24, n7 = window("n1h", 1), window("n24h", 1), window("sum24h", cents), window("n7d", 1)
    sum7, far7 = window("sum7d", cents), window("abroad7d", rows["abroad"][first:])
    present = dict(zip(*carried(_PRESENT, "merchant_id", "n24h")))
    stair = deque(zip(*carried(_STAIR, "at", "cents")))
    days, merchants, *visited = carried(_BUCKET, "at", "merchant_id", "n1h", "n24h", "sum24h")
    standing = Standing({(d, m): v for d, m, *v in zip(days, merchants, *visited)}, window_days)
    out: list[list] = []
    for moment, move, merchant, amount in zip(rows["at"][first:].tolist(), what.tolist(), rows["merchant_id"][first:].tolist(), cents.tolist()):
        if move == _ENTER:
            present[merchant] = present.get(merchant, 0) + 1
            while stair and stair[-1][1] <= amount:
                stair.pop()
            stair.append((moment, amount))
            while stair[0][0] < moment - WEEK_MS:
                stair.popleft()
            day, k = moment // DAY_MS, len(out)
            standing.move_to(day)
            rolled = [
                n1[k], n24[k], sum24[k] / 100.0, half_up(sum7[k], max(1, n7[k]), 0) / 100.0, stair[0][1] / 100.0, len(present), far7[k]
            ]
            out.append(rolled + standing.features(merchant, moment))
            standing.count(merchant, moment, day)
        elif move == _DAY:
            if present[merchant] == 1:
                del present[merchant]
            else:
                present[merchant] -= 1
    return out
