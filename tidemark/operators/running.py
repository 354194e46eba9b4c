"""Running aggregates that survive hot keys.

``Window.partitionBy(key)`` puts every row of a key into one task. That is the right plan
while keys are small. When one key may hold a large share of all rows, ``running`` sorts by
range instead, so that a key spreads over as many slices as its rows need, aggregates inside
each slice and adds what the earlier slices of the same key contribute.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

_COMBINE = {
    "sum": "coalesce({carried} + {here}, {carried}, {here})",
    "max": "greatest({carried}, {here})",
    "min": "least({carried}, {here})",
    "last": "coalesce({here}, {carried})",
}


def _aggregate(how: str, value: str) -> str:
    return f"last({value}, true)" if how == "last" else f"{how}({value})"


def _over(keys: Sequence[str], order: Sequence[str], before: bool) -> str:
    partition = f"PARTITION BY {', '.join(keys)} " if keys else ""
    end = "1 PRECEDING" if before else "CURRENT ROW"
    return f"OVER ({partition}ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"


def _sort_column(term: str) -> Column:
    expression, _, direction = term.rpartition(" ")
    return F.expr(expression).desc() if direction == "DESC" else F.expr(term)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, str]],
    *,
    before: bool = False,
    sliced: bool = False,
) -> DataFrame:
    """Add one running aggregate per entry of ``values`` (name -> (sum | max | min | last, SQL text)).

    The frame runs from the first row of the key to the current row, or to the row ahead of
    it with ``before``. ``order`` holds SQL terms (``x`` or ``x DESC``) and must be total inside a
    key. Without ``sliced`` this is a plain window; with it no task ever holds more than one range
    slice of a key.
    """
    if not sliced:
        over = _over(keys, order, before)
        return df.selectExpr("*", *[f"{_aggregate(how, value)} {over} AS {name}" for name, (how, value) in values.items()])

    by_range = [F.col(k) for k in keys] + [_sort_column(term) for term in order]
    ordered = (
        df.selectExpr("*", *[f"{value} AS _in_{name}" for name, (_, value) in values.items()])
        .repartitionByRange(*by_range)
        .sortWithinPartitions(*by_range)
        .selectExpr("*", "spark_partition_id() AS _slice", "monotonically_increasing_id() AS _position")
    )
    # The slice bounds come from a sample, so they are pinned before they are used twice.
    ordered = cut_lineage(ordered)

    in_slice = _over(["_slice", *keys], ["_position"], before)
    local = ordered.selectExpr(
        "*", *[f"{_aggregate(how, f'_in_{name}')} {in_slice} AS _here_{name}" for name, (how, _) in values.items()]
    )
    totals = ordered.groupBy("_slice", *keys).agg(
        *[F.expr(f"{_slice_total(how, f'_in_{name}')} AS _in_{name}") for name, (how, _) in values.items()]
    )
    earlier = _over(keys, ["_slice"], before=True)
    # A handful of rows with an empty key: one per slice, so one task can order them.
    carried = totals.selectExpr(
        "_slice AS _to_slice",
        *[f"{k} AS _to_{k}" for k in keys],
        f"count(1) {earlier} AS _slices_before",
        *[f"{_aggregate(how, f'_in_{name}')} {earlier} AS _carry_{name}" for name, (how, _) in values.items()],
    ).where("_slices_before > 0")
    # Rows are sorted by key, so only the first key of a slice can have started earlier:
    # the table holds at most one row per slice and may be broadcast.
    match = " AND ".join(["_slice = _to_slice", *[f"{k} <=> _to_{k}" for k in keys]])
    return local.join(F.broadcast(carried), F.expr(match), "left").selectExpr(
        *df.columns,
        *[
            _COMBINE[how].format(carried=f"_carry_{name}", here=f"_here_{name}") + f" AS {name}"
            for name, (how, _) in values.items()
        ],
    )


def _slice_total(how: str, column: str) -> str:
    if how == "last":
        return f"max_by({column}, CASE WHEN {column} IS NOT NULL THEN _position END)"
    return f"{how}({column})"


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into exactly ``spark.sql.shuffle.partitions`` partitions.

    The stages behind it multiply their rows, so the size of the shuffled input says little about
    the work of a task; a fixed number keeps adaptive execution from merging partitions by it.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


@dataclass(frozen=True)
class Heat:
    """How rows spread over the values of a key."""

    hot: DataFrame | None = None
    hot_keys: int = 0
    largest_cool: int = 0
    largest: int = 0


# A key with more rows is spread over several tasks.
SLICE_ROWS = 1_000_000
# There is at most one hot key for every SLICE_ROWS rows. Up to this number they are broadcast, beyond it joined by shuffling.
BROADCAST_KEYS = 100_000


def key_heat(frames: Sequence[DataFrame], key: str, slice_rows: int = SLICE_ROWS) -> Heat:
    """Count rows per key (combined on the map side); hot keys, the empty one too, become a stored table.

    Only the counters reach the driver.
    """
    counts = None
    for frame in frames:
        part = frame.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("rows"))
        counts = part if counts is None else counts.unionByName(part)
    if len(frames) > 1:
        counts = counts.groupBy("_hot_key").agg(F.sum("rows").alias("rows"))
    is_hot = F.col("rows") > F.lit(slice_rows)
    summary = counts.agg(
        F.count_if(is_hot).alias("hot"), F.max(F.when(~is_hot, F.col("rows"))).alias("largest_cool"), F.max("rows").alias("largest")
    ).first()
    cool, largest = summary["largest_cool"] or 0, summary["largest"] or 0
    if summary["hot"] == 0:
        return Heat(largest_cool=cool, largest=largest)
    return Heat(cut_lineage(counts.where(is_hot).select("_hot_key")), summary["hot"], cool, largest)


def apply_by_heat(
    build: Callable[..., DataFrame], frames: Sequence[DataFrame], key: str, heat: Heat
) -> DataFrame:
    """Run ``build(*frames, sliced=...)`` plainly on cool keys and sliced on hot ones; the union is exact."""
    if heat.hot is None:
        return build(*frames, sliced=False)
    hot = F.broadcast(heat.hot) if heat.hot_keys <= BROADCAST_KEYS else heat.hot

    def part(how: str) -> list[DataFrame]:
        return [frame.join(hot, F.expr(f"{key} <=> _hot_key"), how) for frame in frames]

    return build(*part("left_anti"), sliced=False).unionByName(build(*part("left_semi"), sliced=True))
