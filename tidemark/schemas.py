"""Fixed schemas, feature views, feature services and the model catalog."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta


# Table and feature names, types, defaults, time-to-live, service names and
# catalog lists are the public interface and must stay as they are. Schemas are DDL strings, which
# every Spark reader and ``createDataFrame`` take.

TRANSACTION = (
    "transaction_id string, customer_id string, card_id string, merchant_id string, merchant_category string, "
    "amount decimal(18,4), currency string, country string, timestamp timestamp, requested_model string"
)

LABEL = (
    "transaction_id string, is_fraud boolean, label_timestamp timestamp, label_source string, "
    "label_confidence decimal(9,6), annotator_id string, reason_code string"
)

ROLLING_FEATURES = {
    "customer_transaction_count_1h": "bigint",
    "customer_transaction_count_24h": "bigint",
    "customer_total_amount_24h": "double",
    "customer_avg_amount_7d": "double",
    "customer_max_amount_7d": "double",
    "customer_distinct_merchants_24h": "bigint",
    "customer_cross_border_count_7d": "bigint",
}

VISIT_FEATURES = {
    "current_merchant_visit_count_30d": "bigint",
    "current_merchant_visit_share_30d": "double",
    "current_merchant_rank_30d": "bigint",
    "is_current_merchant_top_visited_30d": "bigint",
    "days_since_first_seen_current_merchant": "double",
    "days_since_last_seen_current_merchant": "double",
    "customer_distinct_merchants_30d": "bigint",
    "is_new_merchant_for_customer": "bigint",
    "top_visited_merchant_id_30d": "string",
}

# What a customer row reads when it was written before the visit features existed.
VISIT_DEFAULTS = {
    "current_merchant_visit_count_30d": 0,
    "current_merchant_visit_share_30d": 0.0,
    "current_merchant_rank_30d": 0,
    "is_current_merchant_top_visited_30d": 0,
    "days_since_first_seen_current_merchant": -1.0,
    "days_since_last_seen_current_merchant": -1.0,
    "customer_distinct_merchants_30d": 0,
    "is_new_merchant_for_customer": 1,
    "top_visited_merchant_id_30d": "",
}

CUSTOMER_FEATURES = {**ROLLING_FEATURES, **VISIT_FEATURES}
MERCHANT_FEATURES = {"merchant_risk_score": "float", "merchant_category": "string"}


def _columns(features: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in features.items())


TABLES = {
    "fraud_transactions": (
        "transaction_id string, customer_id string, card_id string, merchant_id string, merchant_category string, "
        "amount double, currency string, country string, event_timestamp timestamp, created_timestamp timestamp"
    ),
    "customer_transaction_stats": (
        f"customer_id string, event_timestamp timestamp, created_timestamp timestamp, {_columns(CUSTOMER_FEATURES)}"
    ),
    "merchant_risk_features": (
        f"merchant_id string, event_timestamp timestamp, created_timestamp timestamp, {_columns(MERCHANT_FEATURES)}"
    ),
    "fraud_prediction_logs": (
        "transaction_id string, model string, model_version string, fraud_score double, decision string, "
        "features_used array<string>, inference_timestamp timestamp, created_timestamp timestamp"
    ),
    "fraud_transaction_processing": (
        "transaction_id string, model string, status string, error_message string, "
        "started_timestamp timestamp, updated_timestamp timestamp"
    ),
    "fraud_labels": (
        "transaction_id string, is_fraud int, label_timestamp timestamp, label_source string, label_confidence double, "
        "annotator_id string, reason_code string, created_timestamp timestamp, updated_timestamp timestamp"
    ),
    "fraud_label_events": (
        "transaction_id string, is_fraud int, label_timestamp timestamp, label_source string, label_confidence double, "
        "annotator_id string, reason_code string, created_timestamp timestamp"
    ),
}

TABLE_KEYS = {
    "fraud_transactions": ("transaction_id",),
    "customer_transaction_stats": ("customer_id", "event_timestamp"),
    "merchant_risk_features": ("merchant_id", "event_timestamp"),
    "fraud_prediction_logs": ("transaction_id", "model", "model_version"),
    "fraud_transaction_processing": ("transaction_id",),
    "fraud_labels": ("transaction_id",),
}


@dataclass(frozen=True)
class FeatureView:
    """A keyed, time-stamped feature table with a look-back limit."""

    name: str
    entity: str
    ttl: timedelta
    features: dict[str, str]
    bootstrap: dict[str, object]
    timestamp: str = "event_timestamp"
    created: str = "created_timestamp"


VIEWS = {
    "customer_transaction_stats_view": FeatureView(
        "customer_transaction_stats_view",
        "customer_id",
        timedelta(days=8),
        CUSTOMER_FEATURES,
        {
            "customer_id": "bootstrap-customer",
            "customer_transaction_count_1h": 0,
            "customer_transaction_count_24h": 0,
            "customer_total_amount_24h": 0.0,
            "customer_avg_amount_7d": 0.0,
            "customer_max_amount_7d": 0.0,
            "customer_distinct_merchants_24h": 0,
            "customer_cross_border_count_7d": 0,
            **VISIT_DEFAULTS,
        },
    ),
    "merchant_risk_view": FeatureView(
        "merchant_risk_view",
        "merchant_id",
        timedelta(days=7),
        MERCHANT_FEATURES,
        {"merchant_id": "bootstrap-merchant", "merchant_risk_score": 0.0, "merchant_category": "bootstrap"},
    ),
}

# The features of each model, in the order of its inputs.
_BASIC = [
    "customer_transaction_count_1h",
    "customer_transaction_count_24h",
    "customer_total_amount_24h",
    "customer_avg_amount_7d",
]
_FULL = [
    "customer_transaction_count_1h",
    "customer_transaction_count_24h",
    "customer_total_amount_24h",
    "customer_avg_amount_7d",
    "customer_max_amount_7d",
    "customer_distinct_merchants_24h",
    "customer_cross_border_count_7d",
    "current_merchant_visit_count_30d",
    "current_merchant_visit_share_30d",
    "current_merchant_rank_30d",
    "is_current_merchant_top_visited_30d",
    "days_since_first_seen_current_merchant",
    "days_since_last_seen_current_merchant",
    "customer_distinct_merchants_30d",
    "is_new_merchant_for_customer",
    "top_visited_merchant_id_30d",
]
_FULL_NUMERIC = [
    "customer_transaction_count_1h",
    "customer_transaction_count_24h",
    "customer_total_amount_24h",
    "customer_avg_amount_7d",
    "customer_max_amount_7d",
    "customer_distinct_merchants_24h",
    "customer_cross_border_count_7d",
    "current_merchant_visit_count_30d",
    "current_merchant_visit_share_30d",
    "current_merchant_rank_30d",
    "is_current_merchant_top_visited_30d",
    "days_since_first_seen_current_merchant",
    "days_since_last_seen_current_merchant",
    "customer_distinct_merchants_30d",
    "is_new_merchant_for_customer",
]


def _refs(view: str, names: list[str]) -> list[str]:
    return [f"{view}:{name}" for name in names]


SERVICES = {
    "fraud_model_a_feature_service": _refs("customer_transaction_stats_view", _BASIC),
    "fraud_model_b_feature_service": _refs("customer_transaction_stats_view", _FULL)
    + _refs("merchant_risk_view", ["merchant_risk_score"]),
}

CATALOG = {
    "MODEL_A": {
        "model_version": "demo-a-v1",
        "feature_service": "fraud_model_a_feature_service",
        "feature_refs": SERVICES["fraud_model_a_feature_service"],
        "numeric_columns": ["transaction_amount", *_BASIC],
        "categorical_columns": ["transaction_country", "merchant_category"],
    },
    "MODEL_B": {
        "model_version": "demo-b-v1",
        "feature_service": "fraud_model_b_feature_service",
        "feature_refs": SERVICES["fraud_model_b_feature_service"],
        "numeric_columns": ["transaction_amount", *_FULL_NUMERIC, "merchant_risk_score"],
        "categorical_columns": ["transaction_country", "merchant_category", "top_visited_merchant_id_30d"],
    },
}

# Transaction columns a model may use next to the features.
TRANSACTION_INPUTS = ["transaction_amount", "transaction_country", "merchant_category"]
REQUIRED_TRANSACTION_FIELDS = [
    "transaction_id",
    "customer_id",
    "merchant_id",
    "merchant_category",
    "transaction_amount",
    "transaction_country",
]

# The features that drift is measured on.
DRIFT_FEATURES = [
    "customer_transaction_count_1h",
    "customer_transaction_count_24h",
    "customer_total_amount_24h",
    "customer_avg_amount_7d",
    "customer_max_amount_7d",
    "customer_distinct_merchants_24h",
    "customer_cross_border_count_7d",
    "current_merchant_visit_count_30d",
    "current_merchant_visit_share_30d",
    "merchant_risk_score",
]

DEFAULT_MODEL = "MODEL_A"
HOME_COUNTRY = "SE"
VISIT_WINDOW_DAYS = 30
DECLINE_AT = 0.85
REVIEW_AT = 0.60
PSI_THRESHOLD = 0.20
MERCHANT_RISK = 0.50


def feature_names(refs: list[str]) -> list[str]:
    """``view:feature`` references to bare feature names."""
    return [ref.split(":", 1)[1] for ref in refs]


def refs_by_view(refs: list[str]) -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for ref in refs:
        view, name = ref.split(":", 1)
        grouped.setdefault(view, []).append(name)
    return grouped


def model_config(model: str, catalog: dict | None = None) -> dict:
    catalog = CATALOG if catalog is None else catalog
    if model not in catalog:
        raise ValueError(f"Unknown model {model}; available models: {', '.join(sorted(catalog))}")
    return catalog[model]


def check_catalog(catalog: dict | None = None, views: dict[str, FeatureView] | None = None) -> None:
    """Every reference and model column must exist in a view or among the transaction inputs."""
    catalog = CATALOG if catalog is None else catalog
    views = VIEWS if views is None else views
    for model, config in catalog.items():
        known = set(TRANSACTION_INPUTS)
        for ref in config["feature_refs"]:
            view, _, name = ref.partition(":")
            if view not in views or name not in views[view].features:
                raise ValueError(f"{model}: unknown feature reference {ref}")
            known.add(name)
        unknown = [c for c in config["numeric_columns"] + config["categorical_columns"] if c not in known]
        if unknown:
            raise ValueError(f"{model}: columns without a source: {', '.join(unknown)}")
