"""Training sets, time split, model fitting and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import classify
from tidemark.operators.clean import mature_labels
from tidemark.operators.joins import join_heat, join_view, training_examples
from tidemark.operators.metrics import evaluation_metrics
from tidemark.operators.running import BROADCAST_KEYS, SLICE_ROWS, running
from tidemark.schemas import DECLINE_AT, VIEWS, model_config, refs_by_view
from tidemark.session import cut_lineage

ENTITY_COLUMNS = [
    "transaction_id",
    "customer_id",
    "merchant_id",
    "event_timestamp",
    "transaction_amount",
    "transaction_country",
    "merchant_category",
    "is_fraud",
    "label_timestamp",
    "label_source",
    "label_confidence",
]


def training_dataset(
    transactions: DataFrame,
    labels: DataFrame,
    customer_rows: DataFrame,
    merchant_rows: DataFrame,
    model: str,
    as_of: str,
    min_label_age_days: int = 0,
    catalog: dict | None = None,
    *,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Labelled transactions with the model's features as they were known at the event."""
    examples = _examples(transactions, labels, as_of, min_label_age_days)
    return _with_features(examples, customer_rows, merchant_rows, model, catalog, slice_rows)


def extend_training_dataset(
    known: DataFrame,
    transactions: DataFrame,
    labels: DataFrame,
    customer_rows: DataFrame,
    merchant_rows: DataFrame,
    model: str,
    as_of: str,
    min_label_age_days: int = 0,
    catalog: dict | None = None,
    *,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """A stored training set carried on to a later ``as_of``: only labels that have matured or changed since are joined with features.

    Rows of ``known`` whose label is no longer the current one go; the others stay as they are, with the features they were given. Where no older
    feature rows were added in between, that is what ``training_dataset`` gives for ``as_of``.
    """
    # Both sides of the comparison read the examples, so they are stored once.
    examples = cut_lineage(_examples(transactions, labels, as_of, min_label_age_days))
    own = examples.selectExpr(*[f"{c} AS _{c}" for c in ENTITY_COLUMNS])
    same = F.expr(" AND ".join(["transaction_id = _transaction_id", *[f"{c} <=> _{c}" for c in ENTITY_COLUMNS[1:]]]))
    kept = known.join(own, same, "left_semi")
    theirs = known.selectExpr(*[f"{c} AS _{c}" for c in ENTITY_COLUMNS])
    fresh = examples.join(theirs, same, "left_anti")
    return kept.unionByName(_with_features(fresh, customer_rows, merchant_rows, model, catalog, slice_rows))


def _examples(transactions: DataFrame, labels: DataFrame, as_of: str, min_label_age_days: int) -> DataFrame:
    return training_examples(transactions, mature_labels(labels, as_of, min_label_age_days)).select(*ENTITY_COLUMNS)


def _with_features(
    examples: DataFrame, customer_rows: DataFrame, merchant_rows: DataFrame, model: str, catalog: dict | None, slice_rows: int
) -> DataFrame:
    """Both views in one plan: the examples are stored once, and the keys of both views are counted on them, not on what a join returns."""
    dataset = examples = cut_lineage(examples)
    stores = {"customer_transaction_stats_view": customer_rows, "merchant_risk_view": merchant_rows}
    wanted = refs_by_view(model_config(model, catalog)["feature_refs"])
    heats = {view: join_heat(examples, stores[view], VIEWS[view], slice_rows) for view in wanted}
    names: list[str] = []
    # A view without hot keys reads its entities once; so those come first and what they return is stored ahead of a view that reads it twice.
    for view in sorted(wanted, key=lambda v: heats[v].hot is not None):
        if heats[view].hot is not None and dataset is not examples:
            dataset = cut_lineage(dataset)
        dataset = join_view(dataset, stores[view], VIEWS[view], wanted[view], slice_rows, heats[view])
    for view in wanted:
        names += wanted[view]
    return dataset.select(*ENTITY_COLUMNS, *names)


def split_index(rows: int, share: float = 0.70) -> int:
    return max(1, min(rows - 1, int(rows * share)))


def time_split(df: DataFrame, share: float = 0.70, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``row_index`` in event-time order and ``part``: ``train`` for the first rows, then ``test``.

    A small set is numbered by one ordered task, a larger one by range slices.
    """
    rows = df.count()
    numbered = running(
        df, [], ["event_timestamp", "transaction_id"], {"row_index": ("sum", "1L")}, sliced=rows > slice_rows
    )
    return numbered.selectExpr("*", f"if(row_index <= {split_index(rows, share)}, 'train', 'test') AS part")


def training_metrics(split: DataFrame) -> DataFrame:
    return split.agg(
        F.expr("count_if(part = 'train') AS train_rows"),
        F.expr("count_if(part = 'test') AS test_rows"),
        F.expr("count_if(is_fraud = 1) AS positive_labels"),
        F.expr("count_if(is_fraud = 0) AS negative_labels"),
    )


def guard_counts(split: DataFrame) -> DataFrame:
    """One row: what decides whether a split may be trained on."""
    return split.agg(
        F.expr("count(1) AS rows"),
        F.expr("count_if(part = 'train') AS train_rows"),
        F.expr("count(DISTINCT is_fraud) AS labels"),
        F.expr("count(DISTINCT if(part = 'train', is_fraud, null)) AS train_labels"),
        F.expr("count_if(part = 'train' AND is_fraud = 1) AS train_positive"),
    )


def check_training_rows(split: DataFrame, min_rows: int = 4) -> dict[str, int]:
    """Raise unless there are enough rows and both labels, overall and in the training part."""
    found = guard_counts(split).first().asDict()
    if found["rows"] < min_rows:
        raise ValueError(f"{found['rows']} labeled rows; a split by time needs at least {min_rows}")
    if found["labels"] < 2:
        raise ValueError("all labels are equal; both kinds are needed")
    if found["train_labels"] < 2:
        raise ValueError("the earlier part holds one kind of label only")
    return found


def category_index(train: DataFrame, columns: Sequence[str], *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(column, value, index): categories numbered from 0 by falling frequency, then by value; nulls are none.

    Numbers are running counts over ranges of categories where a column has very many, so no task sorts all of them.
    """
    stacked = ", ".join(f"'{c}', cast({c} AS string)" for c in columns)
    counts = cut_lineage(
        train.selectExpr(f"stack({len(columns)}, {stacked}) AS (column, value)").where("value IS NOT NULL")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    sliced = counts.count() > slice_rows
    numbered = running(counts, ["column"], ["n DESC", "value"], {"number": ("sum", "1L")}, sliced=sliced)
    return numbered.selectExpr("column", "value", "cast(number - 1 AS int) AS index")


class CategoryNumbers(Transformer):
    """Adds ``_index_<column>`` from a category index by one join per column; unknown values and nulls get the number of categories."""

    def __init__(self, index: DataFrame, columns: Sequence[str]):
        super().__init__()
        self.index = cut_lineage(index)
        # One row per column.
        self.sizes = dict.fromkeys(columns, 0) | {r["column"]: r["n"] for r in self.index.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _transform(self, df: DataFrame) -> DataFrame:
        for name, size in self.sizes.items():
            mine = self.index.where(F.col("column") == name).selectExpr("value AS _value", f"index AS _number_{name}")
            mine = F.broadcast(mine) if size <= BROADCAST_KEYS else mine
            df = df.join(mine, F.expr(f"cast({name} AS string) = _value"), "left").drop("_value")
            df = df.withColumn(f"_index_{name}", F.expr(f"cast(coalesce(_number_{name}, {size}) AS double)")).drop(f"_number_{name}")
        return df


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    """Standardised numbers and one-hot categories in the column ``features``.

    Numbers use the population standard deviation, a constant column keeps scale 1. A category not
    seen in training becomes all zeros. Categories stay in a table of their own; only two numbers per column and
    the number of its categories reach the driver.
    """
    stats = train.agg(
        *[F.expr(f"avg(cast({c} AS double)) AS mean_{c}") for c in numeric],
        *[F.expr(f"stddev_pop(cast({c} AS double)) AS std_{c}") for c in numeric],
    ).first()
    scaled = [
        f"(cast({c} AS double) - {stats[f'mean_{c}']!r}D) / {(stats[f'std_{c}'] or 1.0)!r}D AS _scaled_{c}" for c in numeric
    ]
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
        CategoryNumbers(category_index(train, categorical), categorical),
        # Numbers beyond those of the training rows are kept as a last category, and that one is dropped.
        OneHotEncoder(
            inputCols=[f"_index_{c}" for c in categorical],
            outputCols=[f"_hot_{c}" for c in categorical],
            dropLast=True,
            handleInvalid="keep",
        ),
        VectorAssembler(
            inputCols=[f"_scaled_{c}" for c in numeric] + [f"_hot_{c}" for c in categorical], outputCol="features"
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def fit_model(split: DataFrame, model: str, min_rows: int = 4, catalog: dict | None = None) -> PipelineModel:
    """L2 logistic regression with balanced classes on the training part.

    The penalty of strength one on the summed loss is ``1 / rows`` on Spark's averaged loss.
    """
    config = model_config(model, catalog)
    found = check_training_rows(split, min_rows)
    rows, positive = found["train_rows"], found["train_positive"]
    train = split.where("part = 'train'").selectExpr(
        *config["numeric_columns"],
        *config["categorical_columns"],
        "cast(is_fraud AS double) AS label",
        f"if(is_fraud = 1, {rows / (2 * positive)!r}D, {rows / (2 * (rows - positive))!r}D) AS weight",
    ).cache()
    try:
        prepared = fit_preprocessor(train, config["numeric_columns"], config["categorical_columns"])
        classifier = LogisticRegression(
            featuresCol="features",
            labelCol="label",
            weightCol="weight",
            maxIter=1000,
            regParam=1.0 / rows,
            elasticNetParam=0.0,
            standardization=False,
        ).fit(prepared.transform(train))
    finally:
        train.unpersist()
    return PipelineModel(stages=[*prepared.stages, classifier])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` plus ``fraud_score``, the probability of fraud."""
    return model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias("fraud_score"))


def train_and_evaluate(dataset: DataFrame, model: str, threshold: float = DECLINE_AT) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(fitted model, classified test rows, one row of metrics)."""
    # The training set is written once; counting, splitting, fitting and scoring read the files.
    split = cut_lineage(time_split(cut_lineage(dataset)))
    fitted = fit_model(split, model)
    test = score(fitted, split.where("part = 'test'")).selectExpr(
        "*", f"{classify('fraud_score', threshold)} AS expected_is_fraud"
    )
    sizes = training_metrics(split).first().asDict()
    metrics = evaluation_metrics(test, threshold).drop("rows").selectExpr("*", *[f"{n}L AS {c}" for c, n in sizes.items()])
    return fitted, test, metrics
