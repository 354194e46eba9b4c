"""Classification and ranking metrics as one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import classify
from tidemark.operators.running import SLICE_ROWS, running
from tidemark.schemas import DECLINE_AT


def _ratio(numerator: str, denominator: str) -> str:
    return f"coalesce(try_divide(cast({numerator} AS double), cast({denominator} AS double)), 0.0D)"


def confusion(df: DataFrame, label: str = "is_fraud", predicted: str = "expected_is_fraud") -> DataFrame:
    """Counts of the two by two confusion matrix, always all four."""
    return df.agg(
        F.expr(f"count_if({label} = 0 AND {predicted} = 0) AS tn"),
        F.expr(f"count_if({label} = 0 AND {predicted} = 1) AS fp"),
        F.expr(f"count_if({label} = 1 AND {predicted} = 0) AS fn"),
        F.expr(f"count_if({label} = 1 AND {predicted} = 1) AS tp"),
    )


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """From ``confusion``; zero where a denominator is zero."""
    return counts.selectExpr(
        f"{_ratio('tp', 'tp + fp')} AS precision",
        f"{_ratio('tp', 'tp + fn')} AS recall",
        f"{_ratio('2 * tp', '2 * tp + fp + fn')} AS f1",
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per class and averaged precision, recall, f1 and support, from ``confusion``."""
    total = "(tn + fp + fn + tp)"
    per_class = counts.selectExpr(
        "explode(array("
        f"named_struct('label', '0', 'precision', {_ratio('tn', 'tn + fn')}, 'recall', {_ratio('tn', 'tn + fp')}, "
        f"'f1', {_ratio('2 * tn', '2 * tn + fn + fp')}, 'support', tn + fp), "
        f"named_struct('label', '1', 'precision', {_ratio('tp', 'tp + fp')}, 'recall', {_ratio('tp', 'tp + fn')}, "
        f"'f1', {_ratio('2 * tp', '2 * tp + fp + fn')}, 'support', fn + tp))) AS c"
    ).selectExpr("c.*")
    accuracy = counts.selectExpr(
        "'accuracy' AS label",
        "cast(null AS double) AS precision",
        "cast(null AS double) AS recall",
        f"{_ratio('tn + tp', total)} AS f1",
        f"{total} AS support",
    )
    measures = ("precision", "recall", "f1")
    averages = per_class.agg(
        *[F.expr(f"avg({m}) AS macro_{m}") for m in measures],
        *[F.expr(f"{_ratio(f'sum({m} * support)', 'sum(support)')} AS weighted_{m}") for m in measures],
        F.expr("sum(support) AS support"),
    )
    macro = averages.selectExpr("'macro avg' AS label", *[f"macro_{m} AS {m}" for m in measures], "support")
    weighted = averages.selectExpr("'weighted avg' AS label", *[f"weighted_{m} AS {m}" for m in measures], "support")
    return per_class.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def _score_steps(df: DataFrame, label: str, score: str, slice_rows: int) -> DataFrame:
    """Per distinct score, from the highest: its positives and negatives and the totals up to it."""
    by_score = (
        df.selectExpr(f"{score} AS score", f"{label} AS label")
        .groupBy("score")
        .agg(F.expr("count_if(label = 1) AS pos"), F.expr("count_if(label = 0) AS neg"))
    )
    # Grouped scores fit one ordered task up to this measured size; more are sliced by range.
    sliced = by_score.count() > slice_rows
    return running(by_score, [], ["score DESC"], {"pos_upto": ("sum", "pos"), "neg_upto": ("sum", "neg")}, sliced=sliced)


_RANKING_SUMS = [
    "sum(pos) AS positives",
    "sum(neg) AS negatives",
    "sum(cast(pos AS double) * pos_upto / (pos_upto + neg_upto)) AS step_sum",
    "sum(cast(neg AS double) * (pos_upto + pos_upto - pos) / 2) AS area",
]
_BOTH = "positives > 0 AND negatives > 0"
_PR_AUC = f"if({_BOTH}, step_sum / nullif(positives, 0), null)"
_ROC_AUC = f"if({_BOTH}, area / nullif(cast(positives AS double) * negatives, 0.0D), null)"


def ranking_metrics(
    df: DataFrame, label: str = "is_fraud", score: str = "fraud_score", *, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``pr_auc`` (average precision) and ``roc_auc``; null unless both classes occur.

    Average precision is the sum of recall steps times precision over distinct scores, not the
    trapezoidal area. Equal scores get half credit in the ROC area.
    """
    sums = _score_steps(df, label, score, slice_rows).agg(*[F.expr(e) for e in _RANKING_SUMS])
    return sums.selectExpr(f"{_PR_AUC} AS pr_auc", f"{_ROC_AUC} AS roc_auc")


def average_precision(df: DataFrame, label: str = "is_fraud", score: str = "fraud_score", **limits: int) -> DataFrame:
    return ranking_metrics(df, label, score, **limits).select("pr_auc")


def roc_auc(df: DataFrame, label: str = "is_fraud", score: str = "fraud_score", **limits: int) -> DataFrame:
    return ranking_metrics(df, label, score, **limits).select("roc_auc")


def evaluation_metrics(
    scored: DataFrame, threshold: float = DECLINE_AT, *, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One row: row count, precision, recall, f1, confusion counts and ranking metrics.

    Everything follows from the label counts per distinct score, so the rows are grouped once.
    """
    hit = classify("score", threshold)
    sums = _score_steps(scored, "is_fraud", "fraud_score", slice_rows).agg(
        F.expr(f"coalesce(sum(neg * (1 - {hit})), 0L) AS tn"),
        F.expr(f"coalesce(sum(neg * {hit}), 0L) AS fp"),
        F.expr(f"coalesce(sum(pos * (1 - {hit})), 0L) AS fn"),
        F.expr(f"coalesce(sum(pos * {hit}), 0L) AS tp"),
        *[F.expr(e) for e in _RANKING_SUMS],
    )
    return sums.selectExpr(
        "tn + fp + fn + tp AS rows",
        f"{_ratio('tp', 'tp + fp')} AS precision",
        f"{_ratio('tp', 'tp + fn')} AS recall",
        f"{_ratio('2 * tp', '2 * tp + fp + fn')} AS f1",
        "tn",
        "fp",
        "fn",
        "tp",
        f"{_PR_AUC} AS pr_auc",
        f"{_ROC_AUC} AS roc_auc",
    )
