"""Model resolution, enrichment, scores and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import classify, decision_from_score
from tidemark.schemas import CATALOG, REQUIRED_TRANSACTION_FIELDS, SERVICES, TRANSACTION_INPUTS, VIEWS, refs_by_view


def resolve_model(transactions: DataFrame, catalog: dict | None = None) -> DataFrame:
    """Add ``feature_service``, ``model_version`` and ``reject_reason`` for the requested model.

    The catalog is configuration with one entry per model, so it becomes an expression and no join.
    A ``feature_service`` already on the row overrides the default.
    """
    catalog = CATALOG if catalog is None else catalog

    def pick(field: str) -> str:
        cases = " ".join(f"WHEN '{model}' THEN '{config[field]}'" for model, config in catalog.items())
        return f"CASE requested_model {cases} END"

    service = pick("feature_service")
    if "feature_service" in transactions.columns:
        service = f"coalesce(nullif(trim(feature_service), ''), {service})"
    kept = [c for c in transactions.columns if c != "feature_service"]
    return transactions.selectExpr(
        *kept,
        f"{service} AS feature_service",
        f"{pick('model_version')} AS model_version",
        f"if({pick('model_version')} IS NULL, concat('No mapping configured for ', coalesce(requested_model, 'no model')), null) AS reject_reason",
    )


def transaction_payload(transactions: DataFrame) -> DataFrame:
    """Transactions under the names models use; other columns stay."""
    return transactions.withColumnsRenamed(
        {"amount": "transaction_amount", "country": "transaction_country", "event_timestamp": "timestamp"}
    )


def enrich(
    transactions: DataFrame,
    latest_customer: DataFrame,
    latest_merchant: DataFrame,
    service: str,
    strict: bool = True,
) -> DataFrame:
    """Model input of one feature service, with ``reject_reason`` when something is missing.

    Joins the latest feature row per customer and merchant; these are unique per key, and a key
    with many transactions is split by adaptive execution. ``strict`` reports blank transaction
    fields and null features; otherwise only features without a stored row become zero.
    """
    wanted = refs_by_view(SERVICES[service])
    rows = transaction_payload(transactions)
    stores = {"customer_transaction_stats_view": latest_customer, "merchant_risk_view": latest_merchant}
    for view, columns in wanted.items():
        entity = VIEWS[view].entity
        stored = stores[view].selectExpr(entity, f"struct({', '.join(columns)}) AS {view}")
        rows = rows.join(stored, entity, "left")
    return model_input(rows, service, strict)


#: Columns that go through a scorer beside the model's inputs, and what they are called there.
_CARRIED = {"customer_id": "_customer_id", "event_timestamp": "_event_timestamp"}


def model_input(rows: DataFrame, service: str, strict: bool = True, carry: dict[str, str] | None = None) -> DataFrame:
    """Select and check a service's features from rows with one struct column per feature view, with columns to ``carry`` under new names."""
    carried = list((carry or {}).values())
    wanted = refs_by_view(SERVICES[service])
    names = [name for refs in wanted.values() for name in refs]

    def feature(view: str, name: str) -> str:
        if strict:
            return f"{view}.{name}"
        zero = "'0'" if VIEWS[view].features[name] == "string" else f"cast(0 AS {VIEWS[view].features[name]})"
        return f"if({view} IS NULL, {zero}, {view}.{name})"

    features = [f"{feature(view, name)} AS {name}" for view, columns in wanted.items() for name in columns]
    rows = rows.selectExpr(
        "transaction_id",
        "customer_id",
        "merchant_id",
        "transaction_country",
        "merchant_category",
        "cast(transaction_amount AS double) AS transaction_amount",
        *features,
        *[f"{old} AS {new}" for old, new in (carry or {}).items()],
    )
    if not strict:
        return rows.selectExpr("transaction_id", *TRANSACTION_INPUTS, *names, *carried, "cast(null AS string) AS reject_reason")

    def listed(columns: list[str], blank: bool) -> str:
        tests = [
            f"if({c} IS NULL{f' OR trim(cast({c} AS string)) = {chr(39) * 2}' if blank else ''}, '{c}', null)"
            for c in sorted(columns)
        ]
        return f"array_join(array_compact(array({', '.join(tests)})), ', ')"

    return rows.selectExpr(
        "transaction_id",
        *TRANSACTION_INPUTS,
        *names,
        *carried,
        f"{listed(REQUIRED_TRANSACTION_FIELDS, True)} AS _fields",
        f"{listed(names, False)} AS _features",
    ).selectExpr(
        "transaction_id",
        *TRANSACTION_INPUTS,
        *names,
        *carried,
        "CASE WHEN _fields <> '' THEN concat('Missing required transaction fields for feature enrichment: ', _fields) "
        "WHEN _features <> '' THEN concat('Missing required online features: ', _features) END AS reject_reason",
    )


def rule_score(
    transactions: DataFrame, model: str = "MODEL_B", amount: float = 1000.0, high: float = 0.91, low: float = 0.42
) -> DataFrame:
    """Stand-in score: high for large amounts of one model."""
    return transactions.selectExpr(
        "*",
        f"if(requested_model = '{model}' AND coalesce(cast(amount AS double), 0.0D) >= {amount}D, {high}D, {low}D) AS fraud_score",
    )


def decide_per_model(rows: DataFrame, scorer, catalog: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, rejected) of transactions that carry one struct column per feature view.

    A ``feature_service`` on the row is used where it is a known one. ``rejected`` has transaction_id, model and
    reject_reason: unknown models, unknown services and inputs in which something is missing. ``scorer(model, inputs)`` adds ``fraud_score`` and keeps
    the other columns; two of them, whose names start with an underscore, are no inputs of the model.
    """
    catalog = CATALOG if catalog is None else catalog
    resolved = resolve_model(rows, catalog)
    services = ", ".join(f"'{s}'" for s in SERVICES)
    reason = (
        "coalesce(reject_reason, if(feature_service IN ({0}), null, concat('No features known for ', feature_service)))".format(services)
    )
    unknown = resolved.selectExpr("transaction_id", "requested_model AS model", f"{reason} AS reject_reason")
    rejected, decided = unknown.where("reject_reason IS NOT NULL"), None
    for model, config in catalog.items():
        for service in SERVICES if "feature_service" in rows.columns else [config["feature_service"]]:
            mine = resolved.where(F.expr(f"requested_model = '{model}' AND feature_service = '{service}'"))
            inputs = model_input(mine.drop("reject_reason"), service, carry=_CARRIED)
            used = ", ".join(f"'{c}'" for c in inputs.columns if c not in ("transaction_id", "reject_reason", *_CARRIED.values()))
            part = decide(scorer(model, inputs.where("reject_reason IS NULL"))).selectExpr(
                "transaction_id", f"'{model}' AS model", f"'{config['model_version']}' AS model_version", "fraud_score",
                "decision", f"array({used}) AS features_used", "_customer_id AS customer_id", "_event_timestamp AS inference_timestamp",
            )
            decided = part if decided is None else decided.unionByName(part)
            missing = inputs.where("reject_reason IS NOT NULL")
            rejected = rejected.unionByName(missing.selectExpr("transaction_id", f"'{model}' AS model", "reject_reason"))
    return decided, rejected


def decide(scored: DataFrame) -> DataFrame:
    return scored.selectExpr("*", f"{decision_from_score('fraud_score')} AS decision")


def classified_rows(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Adds the expected decision and the expected 0/1 label to scored rows."""
    label = classify("fraud_score") if threshold is None else classify("fraud_score", threshold)
    return scored.selectExpr(
        "*", f"{decision_from_score('fraud_score')} AS expected_decision", f"{label} AS expected_is_fraud"
    )


def check_inference(results: DataFrame) -> DataFrame:
    """``reject_reason`` for results without score, decision or used features."""
    return results.selectExpr(
        "*",
        "CASE WHEN fraud_score IS NULL THEN 'fraudScore is required' WHEN decision IS NULL THEN 'decision is required' "
        "WHEN features_used IS NULL OR size(features_used) = 0 THEN 'featuresUsed is required' END AS reject_reason",
    )


def with_metadata(results: DataFrame) -> DataFrame:
    """Put model version and feature service into the metadata map unless it already names them."""
    defaults = "map('model_version', model_version, 'feature_service', feature_service)"
    given = "coalesce(metadata, cast(map() AS map<string,string>))" if "metadata" in results.columns else (
        "cast(map() AS map<string,string>)"
    )
    kept = [c for c in results.columns if c != "metadata"]
    return results.selectExpr(
        *kept, f"map_concat(map_filter({defaults}, (k, v) -> NOT map_contains_key({given}, k)), {given}) AS metadata"
    )


def parse_prediction(payloads: DataFrame, column: str = "prediction") -> DataFrame:
    """``fraud_score`` of the first prediction of a document, and ``reject_reason``.

    The score stands under ``fraud_score``, or under ``score`` when there is no such field. Only an absent or null
    score, or no prediction at all, counts as 0; a document or a score that can't be read gives null and a reason.
    """
    parsed = f"from_json({column}, 'predictions array<map<string, string>>')"
    score = "_first[if(coalesce(map_contains_key(_first, 'fraud_score'), false), 'fraud_score', 'score')]"
    return payloads.selectExpr(
        "*", f"{parsed} AS _doc", f"get_json_object({column}, '$') IS NULL AS _broken"
    ).selectExpr("*", "try_element_at(_doc.predictions, 1) AS _first").selectExpr("*", f"{score} AS _text").selectExpr(
        *payloads.columns,
        "if(_broken, null, if(_text IS NULL, 0.0D, try_cast(trim(_text) AS double))) AS fraud_score",
        "CASE WHEN _broken THEN 'prediction is unreadable' "
        "WHEN _text IS NOT NULL AND try_cast(trim(_text) AS double) IS NULL THEN 'fraud score is unreadable' END AS reject_reason",
    )


def flatten_feature_response(payloads: DataFrame, column: str = "features") -> DataFrame:
    """Parallel name and value lists of a feature document as one map from name to first value.

    Of a repeated name the last entry counts; entries without a name are left out.
    """
    schema = "metadata struct<feature_names: array<string>>, results array<struct<values: array<string>>>"
    zipped = "slice(arrays_zip(_doc.metadata.feature_names, _doc.results), 1, greatest(_known, 0))"
    return payloads.selectExpr("*", f"from_json({column}, '{schema}') AS _doc").selectExpr(
        *payloads.columns,
        "least(coalesce(size(_doc.metadata.feature_names), 0), coalesce(size(_doc.results), 0)) AS _known",
        "_doc",
    ).selectExpr(*payloads.columns, f"{zipped} AS _entries").selectExpr(
        *payloads.columns,
        "map_from_entries(transform(filter(_entries, (p, i) -> p.feature_names IS NOT NULL AND NOT coalesce(array_contains("
        "slice(_entries.feature_names, i + 2, size(_entries)), p.feature_names), false)), "
        "p -> struct(p.feature_names, try_element_at(p.results.values, 1)))) AS feature_map",
    )


def prediction_log(decisions: DataFrame) -> DataFrame:
    """Rows of the prediction log table."""
    return decisions.select(
        "transaction_id",
        F.col("requested_model").alias("model"),
        "model_version",
        "fraud_score",
        "decision",
        "features_used",
        "inference_timestamp",
    )
