"""Scalar expressions as SQL text: text, money, time and decisions.

Every helper takes column names or SQL text and returns SQL text for ``selectExpr``, ``where`` or
``F.expr``. They only use built-in functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable

from tidemark.schemas import DECLINE_AT, HOME_COUNTRY, REVIEW_AT

DAY_MS = 86_400_000
HOUR_MS = 3_600_000

# Fixed value: everything up to and including the space counts as blank.
_BLANK = "'" + "".join(f"\\u{code:04x}" for code in range(33)) + "'"


def strip(text: str) -> str:
    """Trim blanks and control characters from both ends; plain ``trim`` only strips spaces."""
    return f"trim(BOTH {_BLANK} FROM {text})"


def text_or_null(text: str) -> str:
    """Stripped text; null when nothing is left."""
    return f"nullif({strip(text)}, '')"


def epoch_ms(ts: str) -> str:
    return f"unix_millis(cast({ts} AS timestamp))"


def utc_day(ms: str) -> str:
    """Days since 1970-01-01 UTC."""
    return f"cast(floor({ms} / {DAY_MS}) AS int)"


def to_cents(amount: str) -> str:
    """Whole cents, half up."""
    return f"cast(round(cast({amount} AS decimal(28,8)), 2) * 100 AS bigint)"


def half_up_ratio(numerator: str, denominator: str, digits: int) -> str:
    """``numerator / denominator`` of non-negative integers, rounded half up to ``digits`` decimals.

    Integer arithmetic keeps the rounding exact; only the last step is a double.
    """
    scale = 10**digits
    units = f"(({numerator}) * {2 * scale}L + ({denominator})) DIV (({denominator}) * 2L)"
    return f"(cast({units} AS double) / {scale}.0D)"


def days_between(earlier_ms: str, later_ms: str) -> str:
    """Days with six decimals, never negative."""
    return half_up_ratio(f"greatest(0L, ({later_ms}) - ({earlier_ms}))", f"{DAY_MS}L", 6)


def is_cross_border(country: str, home: str | Iterable[str] = HOME_COUNTRY) -> str:
    homes = [home] if isinstance(home, str) else list(home)
    listed = ", ".join(f"'{h.upper()}'" for h in homes)
    return f"(upper({country}) NOT IN ({listed}))"


def decision_from_score(score: str, decline_at: float = DECLINE_AT, review_at: float = REVIEW_AT) -> str:
    return (
        f"CASE WHEN {score} >= {decline_at}D THEN 'DECLINE' WHEN {score} >= {review_at}D THEN 'REVIEW' "
        f"ELSE 'APPROVE' END"
    )


def classify(score: str, threshold: float = DECLINE_AT) -> str:
    return f"cast({score} >= {threshold}D AS int)"


def truncate_error(message: str, length: int = 1000) -> str:
    return f"substring({message}, 1, {length})"


def register_sql_functions(spark) -> None:
    """Make the named helpers callable from SQL; Spark inlines them, no Python runs per row."""
    functions = {
        "decision_from_score(score DOUBLE) RETURNS STRING": decision_from_score("score"),
        "days_between_ms(earlier_ms BIGINT, later_ms BIGINT) RETURNS DOUBLE": days_between("earlier_ms", "later_ms"),
        "is_cross_border(country STRING, home STRING) RETURNS BOOLEAN": "upper(country) <> upper(home)",
    }
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
