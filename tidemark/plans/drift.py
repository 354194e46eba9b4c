"""Population stability of features between two time ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clean import feature_window
from tidemark.operators.running import SLICE_ROWS, apply_by_heat, key_heat, running
from tidemark.schemas import DRIFT_FEATURES, PSI_THRESHOLD
from tidemark.session import cut_lineage

# Fixed value: the smallest share a bin is given.
_FLOOR = 0.0001


def count_values(values: DataFrame) -> DataFrame:
    """Weighted counts per (feature, side, value), written once because every later step reads them."""
    return cut_lineage(
        values.where("value IS NOT NULL AND NOT isnan(value)")
        .groupBy("feature", "side", "value")
        .agg(F.expr("sum(weight) AS n"))
    )


def psi(counts: DataFrame, features: list[str], buckets: int = 10, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """PSI per feature from ``count_values`` with the sides ``baseline`` and ``current``.

    Bin edges are the distinct linear quantiles of the baseline. They are exact: the counts are
    summed up in value order and the rows at the quantile positions are picked. Bins are ``[a, b)``,
    the last one ``[a, b]``; values outside and nulls are left out.
    """
    edges = _quantile_edges(counts.where("side = 'baseline'").drop("side"), buckets, slice_rows)
    # At most one row per requested feature with at most ``buckets`` + 1 edges.
    binned = (
        counts.join(F.broadcast(edges), "feature")
        .where("size(edges) >= 3 AND value >= edges[0] AND value <= try_element_at(edges, -1)")
        .selectExpr("feature", "side", "n", "least(size(filter(edges, e -> e <= value)), size(edges) - 1) AS bin")
        .groupBy("feature", "bin")
        .agg(
            F.expr("coalesce(sum(if(side = 'baseline', n, 0L)), 0L) AS expected"),
            F.expr("coalesce(sum(if(side = 'current', n, 0L)), 0L) AS actual"),
        )
    )
    sides = counts.groupBy("feature").agg(F.expr("count_if(side = 'current') > 0 AS has_current"))
    shares = binned.selectExpr(
        "feature",
        f"greatest(expected / greatest(sum(expected) OVER (PARTITION BY feature), 1L), {_FLOOR}D) AS e",
        f"greatest(actual / greatest(sum(actual) OVER (PARTITION BY feature), 1L), {_FLOOR}D) AS a",
    )
    per_feature = shares.groupBy("feature").agg(F.expr("sum((a - e) * ln(a / e)) AS psi"))
    listed = ", ".join(f"'{name}'" for name in features)
    names = counts.sparkSession.range(1).selectExpr(f"explode(array({listed})) AS feature")
    return (
        names.join(per_feature, "feature", "left")
        .join(sides, "feature", "left")
        .selectExpr("feature", "if(coalesce(has_current, false), coalesce(psi, 0.0D), 0.0D) AS psi")
    )


def _quantile_edges(counts: DataFrame, buckets: int, slice_rows: int) -> DataFrame:
    """(feature, edges) from (feature, value, n)."""
    heat = key_heat([counts], "feature", slice_rows)

    def build(rows: DataFrame, sliced: bool) -> DataFrame:
        return running(rows, ["feature"], ["value"], {"upto": ("sum", "n")}, sliced=sliced)

    ordered = apply_by_heat(build, [counts], "feature", heat)
    totals = counts.groupBy("feature").agg(F.expr("sum(n) AS total"))
    share = f"if(q = {buckets}, 1.0D, q * {1.0 / buckets!r}D)"
    at = f"((total - 1) * {share})"
    low = f"cast(floor({at}) AS bigint)"
    high = f"least(cast(floor({at}) AS bigint) + 1, total - 1)"

    def holds(index: str) -> str:
        return f"({index} >= upto - n AND {index} < upto)"

    picked = (
        ordered.join(F.broadcast(totals), "feature")
        .selectExpr(
            "feature",
            "value",
            "total",
            "upto",
            "n",
            f"explode(filter(sequence(0, {buckets}), q -> {holds(low)} OR {holds(high)})) AS q",
        )
        .groupBy("feature", "q", "total")
        .agg(F.expr(f"max(if({holds(low)}, value, null)) AS a"), F.expr(f"max(if({holds(high)}, value, null)) AS b"))
        .selectExpr("feature", "a", "b", f"{at} - floor({at}) AS t")
    )
    edge = "if(t >= 0.5D, b - (b - a) * (1 - t), a + (b - a) * t)"
    return picked.groupBy("feature").agg(F.expr(f"array_sort(array_distinct(collect_list({edge}))) AS edges"))


# Pseudo feature that counts the joined rows of a side.
_ROWS = "_rows"


def drift_counts(
    customer_rows: DataFrame,
    merchant_rows: DataFrame,
    as_of: str,
    baseline: tuple[int, int] = (60, 14),
    current: tuple[int, int] = (14, 0),
) -> DataFrame:
    """Value counts per feature and side of the joined feature rows, without building the join.

    The join of customer and merchant rows by moment multiplies rows. A customer row stands for as
    many joined rows as there are merchant rows of its moment (at least one), a merchant row for as
    many as there are customer rows.
    """
    reach = max(baseline[0], current[0]), min(baseline[1], current[1])
    c = feature_window(customer_rows, as_of, *reach)
    m = feature_window(merchant_rows, as_of, *reach).select("event_timestamp", "merchant_risk_score")
    merchants_at = m.groupBy("event_timestamp").agg(F.expr("count(1) AS merchants"))
    customers_at = c.groupBy("event_timestamp").agg(F.expr("count(1) AS customers"))

    def inside(days: tuple[int, int]) -> str:
        start, end = days
        return (
            f"event_timestamp >= {as_of} - INTERVAL '{start}' DAY AND event_timestamp < {as_of} - INTERVAL '{end}' DAY"
        )

    sides = (
        f"explode(array_compact(array(if({inside(baseline)}, 'baseline', null), if({inside(current)}, 'current', null)))) AS side"
    )
    stacked = ", ".join(f"'{name}', cast({name} AS double)" for name in DRIFT_FEATURES[:-1])
    features = (
        c.join(merchants_at, "event_timestamp", "left")
        .selectExpr(*DRIFT_FEATURES[:-1], "coalesce(merchants, 1L) AS weight", sides)
        .selectExpr("side", "weight", f"stack({len(DRIFT_FEATURES)}, '{_ROWS}', 0.0D, {stacked}) AS (feature, value)")
    )
    risk = m.join(customers_at, "event_timestamp").selectExpr(
        "customers AS weight",
        "'merchant_risk_score' AS feature",
        "cast(merchant_risk_score AS double) AS value",
        sides,
    )
    return count_values(features.unionByName(risk))


def feature_psi(customer_rows: DataFrame, merchant_rows: DataFrame, as_of: str, **ranges) -> DataFrame:
    return psi(drift_counts(customer_rows, merchant_rows, as_of, **ranges).where(f"feature <> '{_ROWS}'"), DRIFT_FEATURES)


def drift_report(
    customer_rows: DataFrame,
    merchant_rows: DataFrame,
    as_of: str,
    threshold: float = PSI_THRESHOLD,
    **ranges,
) -> DataFrame:
    """One row: row counts, PSI per feature, the drifted features and whether to retrain."""
    counts = drift_counts(customer_rows, merchant_rows, as_of, **ranges)
    # One count per side.
    found = {row["side"]: row["n"] for row in counts.where(f"feature = '{_ROWS}'").collect()}
    if set(found) != {"baseline", "current"}:
        raise ValueError("drift compares two ranges; one of them has no feature rows")
    per_feature = psi(counts.where(f"feature <> '{_ROWS}'"), DRIFT_FEATURES)
    return per_feature.agg(
        F.expr(f"{found['baseline']}L AS baseline_rows"),
        F.expr(f"{found['current']}L AS current_rows"),
        F.expr(f"{threshold}D AS psi_threshold"),
        F.expr("map_from_entries(array_sort(collect_list(struct(feature, psi)))) AS feature_psi"),
        F.expr(
            f"map_from_entries(array_sort(collect_list(struct(feature, psi)) FILTER (WHERE psi >= {threshold}D))) "
            "AS drifted_features"
        ),
        F.expr(f"count_if(psi >= {threshold}D) > 0 AS retrain_recommended"),
    )


def daily_counts(customer_rows: DataFrame, merchant_rows: DataFrame, anchor: str) -> DataFrame:
    """Value counts per feature and day, to be stored and extended day by day: (feature, day, value, n).

    Days are stretches of 24 hours counted from ``anchor``; day 0 starts there. Joined rows are weighed as in ``drift_counts``; rows
    join by moment, so a day needs the rows of that day only.
    """
    day = f"floor((unix_micros(cast(event_timestamp AS timestamp)) - unix_micros(cast({anchor} AS timestamp))) / {_DAY_MICROS})"
    merchants_at = merchant_rows.groupBy("event_timestamp").agg(F.expr("count(1) AS merchants"))
    customers_at = customer_rows.groupBy("event_timestamp").agg(F.expr("count(1) AS customers"))
    stacked = ", ".join(f"'{name}', cast({name} AS double)" for name in DRIFT_FEATURES[:-1])
    features = (
        customer_rows.join(merchants_at, "event_timestamp", "left")
        .selectExpr(*DRIFT_FEATURES[:-1], "coalesce(merchants, 1L) AS weight", f"cast({day} AS int) AS day")
        .selectExpr("day", "weight", f"stack({len(DRIFT_FEATURES)}, '{_ROWS}', 0.0D, {stacked}) AS (feature, value)")
    )
    risk = merchant_rows.join(customers_at, "event_timestamp").selectExpr(
        f"cast({day} AS int) AS day", "customers AS weight", "'merchant_risk_score' AS feature", "cast(merchant_risk_score AS double) AS value"
    )
    return (
        features.unionByName(risk)
        .where("value IS NOT NULL AND NOT isnan(value)")
        .groupBy("feature", "day", "value")
        .agg(F.expr("sum(weight) AS n"))
    )


_DAY_MICROS = 86_400_000_000


def rolled_counts(
    daily: DataFrame, dates: Sequence[int], baseline: tuple[int, int] = (60, 14), current: tuple[int, int] = (14, 0)
) -> DataFrame:
    """Counts of the windows of several dates from stored daily counts: (as_of, feature, side, value, n).

    ``dates`` are days after the anchor. Every daily count is read once: it is added where its day enters a window and taken away where it
    leaves, and the running sum between both is the count of each date. A value has as many rows as there are changes to it.
    """
    dates = sorted(set(dates))
    listed = f"array({', '.join(map(str, dates))})"
    moves = []
    for side, (start, end) in (("baseline", baseline), ("current", current)):
        moves += [f"struct('{side}' AS side, day + {end + 1} AS at, n AS n)", f"struct('{side}' AS side, day + {start + 1} AS at, -n AS n)"]
    changes = (
        daily.where(f"day >= {dates[0] - max(baseline[0], current[0])} AND day < {dates[-1] - min(baseline[1], current[1])}")
        .selectExpr("feature", "value", f"inline(array({', '.join(moves)}))")
        # The first date that sees the change.
        .selectExpr("feature", "value", "side", f"size(filter({listed}, d -> d < at)) AS place", "n")
        .where(f"place < {len(dates)}")
        .groupBy("feature", "value", "side", "place").agg(F.expr("sum(n) AS change"))
    )
    over = "OVER (PARTITION BY feature, side, value ORDER BY place)"
    return (
        changes.selectExpr("feature", "side", "value", "place", f"sum(change) {over} AS n", f"lead(place) {over} AS next")
        .where("n > 0")
        .selectExpr("feature", "side", "value", "n", f"explode(slice({listed}, place + 1, coalesce(next, {len(dates)}) - place)) AS as_of")
    )


def rolled_reports(daily: DataFrame, dates: Sequence[int], threshold: float = PSI_THRESHOLD, **ranges) -> DataFrame:
    """One drift report per date, all from one pass over the stored daily counts: as_of (days after the anchor) and the columns of ``drift_report``."""
    counts = cut_lineage(rolled_counts(daily, dates, **ranges))
    # One row per date and side.
    sizes = counts.where(f"feature = '{_ROWS}'").groupBy("as_of").agg(
        F.expr("coalesce(sum(if(side = 'baseline', n, 0L)), 0L) AS baseline_rows"), F.expr("coalesce(sum(if(side = 'current', n, 0L)), 0L) AS current_rows")
    )
    found = {r["as_of"] for r in sizes.where("baseline_rows > 0 AND current_rows > 0").select("as_of").collect()}
    if found != set(dates):
        raise ValueError(f"drift compares two ranges; one of them has no feature rows on {sorted(set(dates) - found)}")
    named = counts.where(f"feature <> '{_ROWS}'").selectExpr("concat(as_of, '/', feature) AS feature", "side", "value", "n")
    per_feature = psi(named, [f"{d}/{name}" for d in sorted(set(dates)) for name in DRIFT_FEATURES]).selectExpr(
        "cast(substring_index(feature, '/', 1) AS int) AS as_of", "substring_index(feature, '/', -1) AS feature", "psi"
    )
    reports = per_feature.groupBy("as_of").agg(
        F.expr(f"{threshold}D AS psi_threshold"),
        F.expr("map_from_entries(array_sort(collect_list(struct(feature, psi)))) AS feature_psi"),
        F.expr(f"map_from_entries(array_sort(collect_list(struct(feature, psi)) FILTER (WHERE psi >= {threshold}D))) AS drifted_features"),
        F.expr(f"count_if(psi >= {threshold}D) > 0 AS retrain_recommended"),
    )
    return reports.join(sizes, "as_of").select(
        "as_of", "baseline_rows", "current_rows", "psi_threshold", "feature_psi", "drifted_features", "retrain_recommended"
    )
