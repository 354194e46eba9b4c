"""DuckDB statements for the registered queries, written from the definitions.

They work on pairs of rows and whole partitions where that is the shortest way to say what is
meant; they are there to check results, not to be fast.
"""

from __future__ import annotations

from tidemark.checks.views import VIEWS, view_sql
from tidemark.schemas import CUSTOMER_FEATURES, DRIFT_FEATURES, ROLLING_FEATURES, VISIT_FEATURES

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
_EARLY = "TIMESTAMP '2024-01-02 00:00:00'"
_TX_COLUMNS = (
    "transaction_id, customer_id, card_id, merchant_id, merchant_category, amount, currency, country, event_timestamp, "
    "requested_model, arrival_seq"
)
_ROLLING = ", ".join(ROLLING_FEATURES)
_VISITS = ", ".join(VISIT_FEATURES)
_FEATURES = ", ".join(CUSTOMER_FEATURES)


def _half_up(numerator: str, denominator: str, digits: int) -> str:
    scale = 10**digits
    return f"((({numerator}) * {2 * scale} + ({denominator})) // (({denominator}) * 2))::DOUBLE / {scale}.0"


_PARTS = {name: view_sql(name) for name in VIEWS}

_PARTS["tx_ms"] = """
    SELECT *, epoch_us(event_timestamp) // 1000 AS ms, CAST(epoch_us(event_timestamp) // 86400000000 AS INTEGER) AS day,
           CAST(amount * 100 AS BIGINT) AS cents FROM tx_raw
"""

_PARTS["rolling"] = f"""
    SELECT transaction_id, customer_id, event_timestamp,
           count(*) OVER h AS customer_transaction_count_1h,
           count(*) OVER d AS customer_transaction_count_24h,
           (sum(cents) OVER d)::DOUBLE / 100.0 AS customer_total_amount_24h,
           ({_half_up("(sum(cents) OVER w)::BIGINT", "count(*) OVER w", 0)}) / 100.0 AS customer_avg_amount_7d,
           (max(cents) OVER w)::DOUBLE / 100.0 AS customer_max_amount_7d,
           count(DISTINCT merchant_id) OVER d AS customer_distinct_merchants_24h,
           CAST(sum(CASE WHEN country <> 'SE' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS customer_cross_border_count_7d
    FROM tx_ms
    WINDOW h AS (PARTITION BY customer_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW),
           d AS (PARTITION BY customer_id ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW),
           w AS (PARTITION BY customer_id ORDER BY ms RANGE BETWEEN 604800000 PRECEDING AND CURRENT ROW)
"""


def _visit_parts(days: int) -> dict[str, str]:
    return {
        "per_merchant": f"""
            SELECT t.transaction_id, p.merchant_id, count(*) AS n, min(p.ms) AS first_ms, max(p.ms) AS last_ms
            FROM tx_ms t JOIN tx_ms p ON p.customer_id = t.customer_id AND p.day BETWEEN t.day - {days - 1} AND t.day
              AND (p.ms < t.ms OR (p.ms = t.ms AND p.transaction_id < t.transaction_id))
            GROUP BY 1, 2
        """,
        "ranked_merchants": """
            SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY n DESC, merchant_id) AS rk FROM per_merchant
        """,
        "visit_totals": """
            SELECT transaction_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS merchants,
                   max(CASE WHEN rk = 1 THEN merchant_id END) AS top FROM ranked_merchants GROUP BY 1
        """,
        "visits": f"""
            SELECT t.transaction_id, t.customer_id, t.merchant_id, t.event_timestamp,
                   coalesce(r.n, 0) AS current_merchant_visit_count_30d,
                   CASE WHEN v.total IS NULL THEN 0.0::DOUBLE ELSE {_half_up("coalesce(r.n, 0)", "v.total", 6)} END
                     AS current_merchant_visit_share_30d,
                   coalesce(r.rk, 0) AS current_merchant_rank_30d,
                   CASE WHEN r.rk = 1 THEN 1::BIGINT ELSE 0::BIGINT END AS is_current_merchant_top_visited_30d,
                   CASE WHEN r.n IS NULL THEN -1.0::DOUBLE ELSE {_half_up("t.ms - r.first_ms", "86400000", 6)} END
                     AS days_since_first_seen_current_merchant,
                   CASE WHEN r.n IS NULL THEN -1.0::DOUBLE ELSE {_half_up("t.ms - r.last_ms", "86400000", 6)} END
                     AS days_since_last_seen_current_merchant,
                   coalesce(v.merchants, 0) AS customer_distinct_merchants_30d,
                   CASE WHEN r.n IS NULL THEN 1::BIGINT ELSE 0::BIGINT END AS is_new_merchant_for_customer,
                   coalesce(v.top, '') AS top_visited_merchant_id_30d
            FROM tx_ms t LEFT JOIN ranked_merchants r ON r.transaction_id = t.transaction_id AND r.merchant_id = t.merchant_id
              LEFT JOIN visit_totals v ON v.transaction_id = t.transaction_id
        """,
    }


_PARTS.update(_visit_parts(30))

_PARTS["customer_rows"] = f"""
    SELECT v.customer_id, v.event_timestamp, {_FEATURES}
    FROM visits v JOIN rolling r ON r.transaction_id = v.transaction_id
    QUALIFY row_number() OVER (PARTITION BY v.customer_id, v.event_timestamp ORDER BY v.transaction_id DESC) = 1
"""
_PARTS["merchant_rows"] = """
    SELECT merchant_id, event_timestamp, CAST(0.5 AS FLOAT) AS merchant_risk_score, merchant_category FROM tx_raw
    QUALIFY row_number() OVER (PARTITION BY merchant_id, event_timestamp ORDER BY transaction_id DESC) = 1
"""
_PARTS["latest_customers"] = (
    "SELECT * FROM customer_rows QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_timestamp DESC) = 1"
)
_PARTS["latest_merchants"] = (
    "SELECT * FROM merchant_rows QUALIFY row_number() OVER (PARTITION BY merchant_id ORDER BY event_timestamp DESC) = 1"
)

_PARTS["tx_normal"] = """
    SELECT nullif(trim(transaction_id), '') AS transaction_id, nullif(trim(customer_id), '') AS customer_id,
           nullif(trim(card_id), '') AS card_id, nullif(trim(merchant_id), '') AS merchant_id,
           lower(nullif(trim(merchant_category), '')) AS merchant_category, amount, upper(nullif(trim(currency), '')) AS currency,
           upper(nullif(trim(country), '')) AS country, event_timestamp,
           coalesce(upper(nullif(trim(requested_model), '')), 'MODEL_A') AS requested_model, arrival_seq
    FROM tx_dirty
"""
_PARTS["tx_checked"] = """
    SELECT *, CASE WHEN transaction_id IS NULL THEN 'transactionId is required' WHEN customer_id IS NULL THEN 'customerId is required'
      WHEN card_id IS NULL THEN 'cardId is required' WHEN merchant_id IS NULL THEN 'merchantId is required'
      WHEN merchant_category IS NULL THEN 'merchantCategory is required' WHEN amount IS NULL THEN 'amount is required'
      WHEN amount <= 0 THEN 'amount must be positive' WHEN currency IS NULL THEN 'currency is required'
      WHEN country IS NULL THEN 'country is required' WHEN event_timestamp IS NULL THEN 'timestamp is required' END AS reject_reason
    FROM tx_normal
"""
_PARTS["labels_normal"] = f"""
    SELECT trim(transaction_id) AS transaction_id, is_fraud, coalesce(label_timestamp, {_AS_OF}) AS label_timestamp,
           lower(trim(label_source)) AS label_source, coalesce(label_confidence, 1.0::DOUBLE) AS label_confidence, arrival_seq,
           CAST(NULL AS VARCHAR) AS annotator_id, CAST(NULL AS VARCHAR) AS reason_code
    FROM label_feed
"""
_PARTS["labels_now"] = """
    SELECT * FROM labels_normal
    WHERE label_confidence BETWEEN 0 AND 1 AND transaction_id IN (SELECT transaction_id FROM tx_raw)
    QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY arrival_seq DESC) = 1
"""
_PARTS["ledger_now"] = """
    SELECT transaction_id, arg_max(model, seq) AS model, arg_max(status, seq) AS status,
           CASE WHEN arg_max(status, seq) = 'FAILED' THEN substr(arg_max(error_message, seq), 1, 1000) END AS error_message,
           min(seq) AS started_seq, max(seq) AS updated_seq
    FROM ledger_feed GROUP BY transaction_id
"""
_PARTS["decided_before"] = "SELECT transaction_id FROM ledger_now WHERE status <> 'FAILED'"
_PARTS["replayed"] = """
    SELECT transaction_id, customer_id, merchant_id, epoch_us(event_timestamp) // 1000 AS ms, epoch_us(event_timestamp) // 86400000000 AS day
    FROM (SELECT transaction_id, customer_id, merchant_id, event_timestamp FROM tx_checked WHERE reject_reason IS NULL
          UNION ALL SELECT transaction_id, customer_id, merchant_id, event_timestamp FROM tx_raw
          WHERE transaction_id IN (SELECT transaction_id FROM decided_before)
            AND transaction_id NOT IN (SELECT transaction_id FROM tx_checked WHERE reject_reason IS NULL AND transaction_id IS NOT NULL))
"""
_PARTS["batch_counts"] = """
    SELECT c.transaction_id, c.requested_model, count(*) FILTER (p.ms >= r.ms - 86400000) AS n,
           count(*) FILTER (p.merchant_id = r.merchant_id AND p.day > r.day - 30
                            AND (p.ms < r.ms OR (p.ms = r.ms AND p.transaction_id < r.transaction_id))) AS visits
    FROM tx_checked c JOIN replayed r ON r.transaction_id = c.transaction_id
    JOIN replayed p ON p.customer_id = r.customer_id AND (p.ms < r.ms OR (p.ms = r.ms AND p.transaction_id <= r.transaction_id))
    WHERE c.reject_reason IS NULL AND c.transaction_id NOT IN (SELECT transaction_id FROM decided_before)
    GROUP BY 1, 2
"""

_PARTS["valid_ms"] = """
    SELECT *, epoch_us(event_timestamp) // 1000 AS ms, epoch_us(event_timestamp) // 86400000000 AS day FROM tx_checked WHERE reject_reason IS NULL
"""
_PARTS["stream_counts"] = """
    SELECT r.transaction_id, r.requested_model, count(*) FILTER (p.ms >= r.ms - 86400000) AS n,
           count(*) FILTER (p.merchant_id = r.merchant_id AND p.day > r.day - 30 AND p.transaction_id <> r.transaction_id) AS visits
    FROM valid_ms r JOIN valid_ms p ON p.customer_id = r.customer_id AND (p.ms < r.ms OR (p.ms = r.ms AND p.transaction_id <= r.transaction_id))
    GROUP BY 1, 2
"""

_PARTS["examples"] = """
    SELECT t.transaction_id, t.customer_id, t.merchant_id, t.event_timestamp, CAST(t.amount AS DOUBLE) AS transaction_amount,
           t.country AS transaction_country, t.merchant_category, l.is_fraud, l.label_timestamp, l.label_source, l.label_confidence
    FROM tx_raw t JOIN labels_now l ON l.transaction_id = t.transaction_id WHERE l.label_timestamp >= t.event_timestamp
"""
_PARTS["split"] = """
    SELECT *, row_number() OVER (ORDER BY event_timestamp, transaction_id) AS row_index, count(*) OVER () AS n FROM examples
"""
_PARTS["parts"] = """
    SELECT transaction_id, is_fraud, row_index,
           CASE WHEN row_index <= greatest(1, least(n - 1, CAST(floor(n * 0.70::DOUBLE) AS BIGINT))) THEN 'train' ELSE 'test' END AS part
    FROM split
"""
_PARTS["scored_labels"] = """
    SELECT p.transaction_id, p.fraud_score, l.is_fraud FROM predictions p JOIN labels_now l ON l.transaction_id = p.transaction_id
"""
_PARTS["entities"] = """
    SELECT transaction_id, customer_id, merchant_id, event_timestamp
        + CASE WHEN merchant_category = 'error' THEN INTERVAL '20' DAY ELSE INTERVAL '12' HOUR END AS event_timestamp FROM tx_raw
"""
_PARTS["drift_rows"] = """
    SELECT c.*, m.merchant_risk_score FROM customer_rows c LEFT JOIN merchant_rows m ON m.event_timestamp = c.event_timestamp
"""

_SIDE = f"""CASE WHEN event_timestamp >= {_AS_OF} - INTERVAL 30 DAY AND event_timestamp < {_AS_OF} - INTERVAL 14 DAY THEN 'baseline'
     WHEN event_timestamp >= {_AS_OF} - INTERVAL 14 DAY AND event_timestamp < {_AS_OF} THEN 'current' END"""


def _psi_parts(values: str) -> dict[str, str]:
    return {
        "vals": values,
        "ranked": """SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i,
            count(*) OVER (PARTITION BY feature) AS n FROM vals WHERE side = 'baseline'""",
        "positions": """SELECT feature, n, (n - 1) * CASE WHEN q = 10 THEN 1.0::DOUBLE ELSE q * 0.1::DOUBLE END AS pos
            FROM (SELECT DISTINCT feature, n FROM ranked), (SELECT unnest(range(0, 11)) AS q)""",
        "picked": """SELECT p.feature, p.pos - floor(p.pos) AS t, lo.value AS a, hi.value AS b FROM positions p
            JOIN ranked lo ON lo.feature = p.feature AND lo.i = CAST(floor(p.pos) AS BIGINT)
            JOIN ranked hi ON hi.feature = p.feature AND hi.i = least(CAST(floor(p.pos) AS BIGINT) + 1, p.n - 1)""",
        "edges": """SELECT feature, list_sort(list_distinct(list(
            CASE WHEN t >= 0.5 THEN b - (b - a) * (1 - t) ELSE a + (b - a) * t END))) AS e FROM picked GROUP BY feature""",
        "binned": """SELECT v.feature, v.side, least(len(list_filter(e.e, lambda x: x <= v.value)), len(e.e) - 1) AS bin, count(*) AS n
            FROM vals v JOIN edges e ON e.feature = v.feature
            WHERE len(e.e) >= 3 AND v.value >= e.e[1] AND v.value <= e.e[-1] GROUP BY ALL""",
        "bins": """SELECT feature, bin, sum(CASE WHEN side = 'baseline' THEN n ELSE 0 END) AS x,
            sum(CASE WHEN side = 'current' THEN n ELSE 0 END) AS y FROM binned GROUP BY feature, bin""",
        "shares": """SELECT feature, greatest(x::DOUBLE / greatest(sum(x) OVER f, 1)::DOUBLE, 0.0001) AS e,
            greatest(y::DOUBLE / greatest(sum(y) OVER f, 1)::DOUBLE, 0.0001) AS a FROM bins WINDOW f AS (PARTITION BY feature)""",
        "psi": """SELECT f.feature, coalesce(sum((a - e) * ln(a / e)), 0.0) AS psi
            FROM (SELECT DISTINCT feature FROM vals) f LEFT JOIN shares s ON s.feature = f.feature GROUP BY f.feature""",
    }


_DRIFT_VALUES = f"""
    SELECT side, feature, value FROM (
      SELECT {_SIDE} AS side, {", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in DRIFT_FEATURES)} FROM drift_rows
    ) UNPIVOT (value FOR feature IN ({", ".join(DRIFT_FEATURES)})) WHERE side IS NOT NULL
"""
_AMOUNT_VALUES = f"""
    SELECT side, 'amount' AS feature, value FROM (SELECT {_SIDE} AS side, CAST(amount AS DOUBLE) AS value FROM tx_raw)
    WHERE side IS NOT NULL
"""


def _statement(final: str, **own: str) -> str:
    """``final`` with the parts it needs, directly or through others, in order of definition."""
    parts = {**_PARTS, **own}
    words = set(_words(final))
    needed: set[str] = set()
    while True:
        more = {name for name in parts if name in words and name not in needed}
        if not more:
            break
        needed |= more
        for name in more:
            words |= set(_words(parts[name]))
    listed = ", ".join(f"{name} AS ({parts[name]})" for name in parts if name in needed)
    return f"WITH {listed} {final}" if listed else final


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in text).split()


def _confusion(threshold: float) -> str:
    hit = f"fraud_score >= {threshold}"
    return f"""SELECT count(*) FILTER (WHERE is_fraud = 0 AND NOT ({hit})) AS tn, count(*) FILTER (WHERE is_fraud = 0 AND {hit}) AS fp,
        count(*) FILTER (WHERE is_fraud = 1 AND NOT ({hit})) AS fn, count(*) FILTER (WHERE is_fraud = 1 AND {hit}) AS tp"""


def _safe(numerator: str, denominator: str) -> str:
    return f"CASE WHEN ({denominator}) = 0 THEN 0.0::DOUBLE ELSE ({numerator})::DOUBLE / ({denominator})::DOUBLE END"


_P, _R, _F = _safe("tp", "tp + fp"), _safe("tp", "tp + fn"), _safe("2 * tp", "2 * tp + fp + fn")
_NP, _NR, _NF = _safe("tn", "tn + fn"), _safe("tn", "tn + fp"), _safe("2 * tn", "2 * tn + fn + fp")


def _ranking(rows: str) -> dict[str, str]:
    return {
        "steps": f"""SELECT fraud_score, count(*) FILTER (WHERE is_fraud = 1) AS p, count(*) FILTER (WHERE is_fraud = 0) AS q
            FROM {rows} GROUP BY 1""",
        "curve": """SELECT p, q, sum(p) OVER s AS tp, sum(q) OVER s AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg
            FROM steps WINDOW s AS (ORDER BY fraud_score DESC)""",
        "areas": """SELECT sum(p::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / max(pos)::DOUBLE AS pr_auc,
            sum(q::DOUBLE * (tp + tp - p)::DOUBLE / 2) / (max(pos)::DOUBLE * max(neg)::DOUBLE) AS roc_auc FROM curve""",
    }


_CASE_DECISION = "CASE WHEN fraud_score >= 0.85 THEN 'DECLINE' WHEN fraud_score >= 0.6 THEN 'REVIEW' ELSE 'APPROVE' END"
_RULE = "CASE WHEN requested_model = 'MODEL_B' AND amount >= 100 THEN 0.91::DOUBLE ELSE 0.42::DOUBLE END"
_EXAMPLE_COLUMNS = (
    "x.transaction_id, x.customer_id, x.merchant_id, x.event_timestamp, x.transaction_amount, x.transaction_country, "
    "x.merchant_category, x.is_fraud, x.label_timestamp, x.label_source, x.label_confidence"
)
_MATURE = f"(SELECT * FROM examples WHERE label_timestamp <= {_AS_OF} - INTERVAL 5 DAY)"
_INPUTS = (
    "t.transaction_id, CAST(t.amount AS DOUBLE) AS transaction_amount, t.country AS transaction_country, t.merchant_category"
)
_BASIC = list(CUSTOMER_FEATURES)[:4]
_EARLY_CUSTOMERS = (
    f"SELECT * FROM customer_rows WHERE event_timestamp <= {_EARLY} "
    "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_timestamp DESC) = 1"
)


def _alive(alias: str, columns: list[str], days: int) -> str:
    return ", ".join(
        f"CASE WHEN {alias}.event_timestamp >= x.event_timestamp - INTERVAL {days} DAY THEN {alias}.{c} END AS {c}" for c in columns
    )


def statements() -> dict[str, str]:
    names = [*DRIFT_FEATURES]
    psi_all = _psi_parts(_DRIFT_VALUES)
    short = _visit_parts(7)
    customer_features = list(CUSTOMER_FEATURES)
    sql = {
        "bootstrap_features": f"""SELECT customer_id, {_FEATURES} FROM latest_customers UNION ALL
            SELECT 'bootstrap-customer', 0, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0.0, 0, 0, -1.0, -1.0, 0, 1, ''""",
        "upsert_latest_transactions": f"""SELECT {_TX_COLUMNS} FROM tx_dup
            QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY arrival_seq DESC) = 1""",
        "upsert_latest_predictions": """SELECT transaction_id, model, model_version, 
            round(CASE WHEN fraud_score >= 0.5 THEN 1.0::DOUBLE - fraud_score ELSE fraud_score END, 9) AS fraud_score, inference_timestamp,
            arrival_seq + CASE WHEN fraud_score >= 0.5 THEN 100000000 ELSE 0 END AS arrival_seq FROM predictions""",
        "latest_customer_features": f"SELECT customer_id, event_timestamp, {_FEATURES} FROM latest_customers",
        "latest_merchant_features": "SELECT merchant_id, event_timestamp, merchant_risk_score, merchant_category FROM latest_merchants",
        "decision_events": f"""SELECT transaction_id, concat('fraud_decision_event transaction_id=', transaction_id, ' customer_id=', customer_id,
            ' model=', requested_model, ' decision=', {_CASE_DECISION}, ' score=', CAST(fraud_score AS VARCHAR)) AS line
            FROM (SELECT *, {_RULE} AS fraud_score FROM tx_raw)""",
        "label_events": """SELECT transaction_id, concat('fraud_label_ingested transaction_id=', transaction_id, ' is_fraud=',
            CASE WHEN is_fraud = 1 THEN 'true' ELSE 'false' END, ' label_source=', label_source, ' confidence=',
            CAST(label_confidence AS VARCHAR)) AS line FROM labels_now""",
        "normalize_transactions": f"SELECT {_TX_COLUMNS} FROM tx_normal",
        "validate_transactions": f"SELECT {_TX_COLUMNS} FROM tx_checked WHERE reject_reason IS NULL",
        "rejected_by_reason": """SELECT reject_reason, count(*) AS rows FROM tx_checked WHERE reject_reason IS NOT NULL GROUP BY 1""",
        "normalize_labels": "SELECT * FROM labels_normal",
        "validate_labels": """SELECT transaction_id, arrival_seq, CASE WHEN NOT (label_confidence BETWEEN 0 AND 1)
            THEN 'labelConfidence must be between 0 and 1' END AS reject_reason FROM labels_normal""",
        "decisions": f"SELECT transaction_id, fraud_score, {_CASE_DECISION} AS decision FROM predictions",
        "classified_rows": f"""SELECT transaction_id, fraud_score, is_fraud, {_CASE_DECISION} AS expected_decision,
            CAST(fraud_score >= 0.85 AS INTEGER) AS expected_is_fraud FROM scored_labels""",
        "resolve_model": """SELECT transaction_id, m AS requested_model,
            CASE WHEN merchant_category = 'view' THEN 'own_feature_service' WHEN m = 'MODEL_A' THEN 'fraud_model_a_feature_service'
                 WHEN m = 'MODEL_B' THEN 'fraud_model_b_feature_service' END AS feature_service,
            CASE m WHEN 'MODEL_A' THEN 'demo-a-v1' WHEN 'MODEL_B' THEN 'demo-b-v1' END AS model_version,
            CASE WHEN m = 'MODEL_X' THEN 'No mapping configured for MODEL_X' WHEN m IS NULL THEN 'No mapping configured for no model'
            END AS reject_reason
            FROM (SELECT *, CASE merchant_category WHEN 'error' THEN 'MODEL_X' WHEN 'signup' THEN NULL ELSE requested_model END AS m FROM tx_raw)""",
        "transaction_payload": """SELECT transaction_id, customer_id, card_id, merchant_id, merchant_category, amount AS transaction_amount,
            currency, country AS transaction_country, event_timestamp AS timestamp, requested_model FROM tx_raw""",
        "rule_score": f"SELECT transaction_id, requested_model, amount, {_RULE} AS fraud_score FROM tx_raw",
        "parse_prediction": """SELECT transaction_id, CASE WHEN NOT ok OR text = 'abc' THEN NULL ELSE CAST(coalesce(text, '0') AS DOUBLE) END AS fraud_score,
            CASE WHEN NOT ok THEN 'prediction is unreadable' WHEN text = 'abc' THEN 'fraud score is unreadable' END AS reject_reason
            FROM (SELECT transaction_id, json_valid(prediction) AS ok, CASE WHEN NOT json_valid(prediction) THEN NULL
                  WHEN contains(prediction, '"fraud_score"') THEN json_extract_string(CASE WHEN json_valid(prediction) THEN prediction END, '$.predictions[0].fraud_score')
                  ELSE json_extract_string(CASE WHEN json_valid(prediction) THEN prediction END, '$.predictions[0].score') END AS text FROM payloads)""",
        "flatten_feature_response": """SELECT transaction_id, json_extract_string(features, '$.results[1].values[0]') AS customer_id,
            json_extract_string(features, '$.results[2].values[0]') AS merchant_risk_score,
            CASE WHEN contains(features, '"extra"') THEN 3::BIGINT ELSE 2::BIGINT END AS features FROM payloads""",
        "validate_inference": """SELECT transaction_id, CASE WHEN fraud_score = 0.5 THEN 'fraudScore is required'
            WHEN fraud_score = 0.25 THEN 'featuresUsed is required' END AS reject_reason FROM predictions""",
        "inference_metadata": """SELECT transaction_id, CASE WHEN country = 'SE' THEN 'SE' WHEN requested_model = 'MODEL_A' THEN 'demo-a-v1'
            ELSE 'demo-b-v1' END AS model_version, CASE requested_model WHEN 'MODEL_A' THEN 'fraud_model_a_feature_service'
            ELSE 'fraud_model_b_feature_service' END AS feature_service, currency AS source,
            CASE WHEN country = 'SE' THEN 3::BIGINT ELSE 4::BIGINT END AS entries FROM tx_raw""",
        "feature_window": f"""SELECT transaction_id, event_timestamp FROM tx_raw WHERE event_timestamp >= {_AS_OF} - INTERVAL 14 DAY
            AND event_timestamp < {_AS_OF} - INTERVAL 7 DAY""",
        "mature_labels": f"""SELECT transaction_id, label_timestamp FROM labels_now WHERE label_timestamp <= {_AS_OF} - INTERVAL 5 DAY""",
        "dedupe_transactions": f"""SELECT {_TX_COLUMNS} FROM tx_dup
            QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY arrival_seq) = 1""",
        "ledger_status": "SELECT * FROM ledger_now",
        "stale_started": "SELECT * FROM ledger_now WHERE status = 'STARTED'",
        "admission_gate": """SELECT t.transaction_id, l.status AS ledger_status, l.status IS NULL OR l.status = 'FAILED' AS admitted
            FROM tx_raw t LEFT JOIN ledger_now l ON l.transaction_id = t.transaction_id""",
        "labels_current": """SELECT * FROM labels_normal
            QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY arrival_seq DESC) = 1""",
        "known_labels": """SELECT transaction_id, label_source, arrival_seq FROM labels_normal
            WHERE transaction_id IN (SELECT transaction_id FROM tx_raw)""",
        "unknown_labels": """SELECT transaction_id, label_source, arrival_seq FROM labels_normal
            WHERE transaction_id NOT IN (SELECT transaction_id FROM tx_raw)""",
        "label_history_new": """SELECT transaction_id, label_source, label_timestamp, is_fraud
            FROM (SELECT * FROM labels_normal UNION ALL SELECT * REPLACE (1 - is_fraud AS is_fraud, arrival_seq + 1000000000 AS arrival_seq) FROM labels_normal) n
            WHERE NOT EXISTS (SELECT 1 FROM labels_normal h WHERE h.label_source = 'chargeback' AND h.is_fraud = 0 AND h.transaction_id = n.transaction_id
              AND h.label_timestamp = n.label_timestamp AND h.label_source = n.label_source)
            QUALIFY row_number() OVER (PARTITION BY transaction_id, label_timestamp, label_source ORDER BY arrival_seq) = 1""",
        "insert_if_absent": f"""SELECT {_TX_COLUMNS} FROM tx_dup
            WHERE transaction_id NOT IN (SELECT transaction_id FROM tx_raw WHERE merchant_category = 'view')
            QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY arrival_seq) = 1""",
        "evolve_schema": f"""SELECT t.transaction_id, t.customer_id, t.card_id, t.merchant_id, t.merchant_category, t.currency, t.country,
            t.event_timestamp, t.requested_model, {_ROLLING}, 0::BIGINT AS current_merchant_visit_count_30d,
            0.0::DOUBLE AS current_merchant_visit_share_30d, 0::BIGINT AS current_merchant_rank_30d,
            0::BIGINT AS is_current_merchant_top_visited_30d, -1.0::DOUBLE AS days_since_first_seen_current_merchant,
            -1.0::DOUBLE AS days_since_last_seen_current_merchant, 0::BIGINT AS customer_distinct_merchants_30d,
            1::BIGINT AS is_new_merchant_for_customer, '' AS top_visited_merchant_id_30d
            FROM tx_raw t JOIN rolling r ON r.transaction_id = t.transaction_id""",
        "rolling_stats": f"SELECT transaction_id, customer_id, {_ROLLING} FROM rolling",
        "merchant_day_buckets": """SELECT customer_id, day, merchant_id, count(*) AS visits, min(ms) AS first_ms, max(ms) AS last_ms
            FROM tx_ms GROUP BY ALL""",
        "merchant_window": """SELECT d.customer_id, d.day, p.merchant_id, count(*) AS visits, min(p.ms) AS first_ms, max(p.ms) AS last_ms
            FROM (SELECT DISTINCT customer_id, day FROM tx_ms) d JOIN tx_ms p ON p.customer_id = d.customer_id
              AND p.day BETWEEN d.day - 6 AND d.day - 1 GROUP BY ALL""",
        "customer_feature_rows": f"SELECT customer_id, event_timestamp, {_FEATURES} FROM customer_rows",
        "merchant_feature_rows": "SELECT * FROM merchant_rows",
        "training_examples": "SELECT * FROM examples",
        "pit_customer": f"""SELECT x.*, {_alive("f", ["customer_transaction_count_24h", "customer_total_amount_24h",
            "top_visited_merchant_id_30d"], 8)} FROM entities x ASOF LEFT JOIN customer_rows f
            ON f.customer_id = x.customer_id AND x.event_timestamp >= f.event_timestamp""",
        "pit_merchant": f"""SELECT x.*, {_alive("f", ["merchant_risk_score", "merchant_category"], 7)} FROM entities x
            ASOF LEFT JOIN merchant_rows f ON f.merchant_id = x.merchant_id AND x.event_timestamp >= f.event_timestamp""",
        "training_dataset_model_a": f"""SELECT {_EXAMPLE_COLUMNS}, {_alive("f", _BASIC, 8)} FROM {_MATURE} x
            ASOF LEFT JOIN customer_rows f ON f.customer_id = x.customer_id AND x.event_timestamp >= f.event_timestamp""",
        "training_dataset_model_b": f"""SELECT {_EXAMPLE_COLUMNS}, {_alive("f", customer_features, 8)},
            {_alive("g", ["merchant_risk_score"], 7)} FROM {_MATURE} x
            ASOF LEFT JOIN customer_rows f ON f.customer_id = x.customer_id AND x.event_timestamp >= f.event_timestamp
            ASOF LEFT JOIN merchant_rows g ON g.merchant_id = x.merchant_id AND x.event_timestamp >= g.event_timestamp""",
        "enrich_model_a": f"""SELECT {_INPUTS}, {", ".join(f"c.{f}" for f in _BASIC)}
            FROM tx_raw t JOIN latest_customers c ON c.customer_id = t.customer_id""",
        "enrich_model_b": f"""SELECT {_INPUTS}, {", ".join(f"c.{f}" for f in customer_features)}, m.merchant_risk_score
            FROM tx_raw t JOIN latest_customers c ON c.customer_id = t.customer_id JOIN latest_merchants m ON m.merchant_id = t.merchant_id""",
        "enrich_rejected": f"""SELECT t.transaction_id, 'Missing required online features: {", ".join(sorted(_BASIC))}' AS reject_reason
            FROM tx_raw t WHERE t.customer_id NOT IN (SELECT customer_id FROM customer_rows WHERE event_timestamp <= {_EARLY})""",
        "enrich_lenient": f"""SELECT {_INPUTS}, {", ".join(f"coalesce(c.{f}, 0) AS {f}" for f in _BASIC)}
            FROM tx_raw t LEFT JOIN ({_EARLY_CUSTOMERS}) c ON c.customer_id = t.customer_id""",
        "labeled_predictions": """SELECT p.transaction_id, p.fraud_score, l.is_fraud, p.inference_timestamp FROM predictions p
            JOIN labels_now l ON l.transaction_id = p.transaction_id WHERE p.model = 'MODEL_B' AND p.model_version = 'demo-b-v1'""",
        "drift_features": """SELECT customer_id, event_timestamp, customer_transaction_count_24h, current_merchant_visit_share_30d,
            merchant_risk_score FROM drift_rows""",
        "time_split": "SELECT transaction_id, is_fraud, row_index, part FROM parts",
        "label_counts": """SELECT count(*) FILTER (WHERE part = 'train') AS train_rows, count(*) FILTER (WHERE part = 'test') AS test_rows,
            count(*) FILTER (WHERE is_fraud = 1) AS positive_labels, count(*) FILTER (WHERE is_fraud = 0) AS negative_labels FROM parts""",
        "confusion_matrix": f"{_confusion(0.85)} FROM scored_labels",
        "precision_recall_f1": f"""SELECT round({_P}, 9) AS precision, round({_R}, 9) AS recall, round({_F}, 9) AS f1
            FROM ({_confusion(0.85)} FROM scored_labels)""",
        "classification_report": f"""
            SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support FROM (
              SELECT label, p, r, f, support FROM per_class
              UNION ALL SELECT 'accuracy', NULL, NULL, {_safe("tn + tp", "tn + fp + fn + tp")}, tn + fp + fn + tp FROM counts
              UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM per_class
              UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class)""",
        "psi_amount": "SELECT feature, round(psi, 9) AS psi FROM psi",
        "psi_all_features": "SELECT feature, round(psi, 9) AS psi FROM psi",
        "drift_report": f"""SELECT (SELECT count(*) FROM drift_rows WHERE ({_SIDE}) = 'baseline') AS baseline_rows,
            (SELECT count(*) FROM drift_rows WHERE ({_SIDE}) = 'current') AS current_rows, 0.2::DOUBLE AS psi_threshold,
            coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE psi >= 0.2), '') AS drifted,
            {len(names)}::BIGINT AS features, count(*) FILTER (WHERE psi >= 0.2) > 0 AS retrain_recommended FROM psi""",
        "score_batch": f"""SELECT transaction_id, requested_model AS model,
            CASE requested_model WHEN 'MODEL_A' THEN 'demo-a-v1' WHEN 'MODEL_B' THEN 'demo-b-v1' END AS model_version,
            fraud_score, {_CASE_DECISION} AS decision, n AS customer_transaction_count_24h, visits AS current_merchant_visit_count_30d,
            CASE requested_model WHEN 'MODEL_A' THEN 7::BIGINT ELSE 20::BIGINT END AS features_used, NULL::VARCHAR AS reject_reason
            FROM (SELECT *, round(least(0.3::DOUBLE * n + CASE requested_model WHEN 'MODEL_B' THEN 0.1::DOUBLE * visits ELSE 0 END, 1.0::DOUBLE), 9)
                  AS fraud_score FROM batch_counts)
            UNION ALL SELECT transaction_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reject_reason FROM tx_checked WHERE reject_reason IS NOT NULL
            UNION ALL SELECT transaction_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'transaction is already processed'
            FROM tx_checked WHERE reject_reason IS NULL AND transaction_id IN (SELECT transaction_id FROM decided_before)""",
        "score_batch_ledger": """SELECT transaction_id, m AS model, CASE WHEN error IS NULL THEN 'DECISION_PUBLISHED' ELSE 'FAILED' END AS status,
            error AS error_message, CASE WHEN error IS NOT NULL THEN NULL WHEN m = 'MODEL_B' OR merchant_category = 'view' THEN 20::BIGINT
            ELSE 7::BIGINT END AS features_used
            FROM (SELECT *, CASE WHEN m = 'MODEL_X' THEN 'No mapping configured for MODEL_X'
                         WHEN merchant_category = 'click' THEN 'No features known for nothing' END AS error
                  FROM (SELECT *, CASE merchant_category WHEN 'error' THEN 'MODEL_X' WHEN 'signup' THEN 'MODEL_A' ELSE requested_model END AS m
                        FROM tx_checked WHERE reject_reason IS NULL))""",
        "stream_decisions": f"""SELECT transaction_id, requested_model AS model, fraud_score, {_CASE_DECISION} AS decision,
            'DECISION_PUBLISHED' AS status, NULL::VARCHAR AS reject_reason
            FROM (SELECT transaction_id, requested_model, round(least(0.3::DOUBLE * n + CASE requested_model WHEN 'MODEL_B'
                         THEN 0.1::DOUBLE * visits ELSE 0 END, 1.0::DOUBLE), 9) AS fraud_score FROM stream_counts)
            UNION ALL SELECT transaction_id, NULL, NULL, NULL, NULL, reject_reason FROM tx_checked WHERE reject_reason IS NOT NULL""",
        "stream_upsert_latest": f"""SELECT {_TX_COLUMNS} FROM tx_dup
            QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY arrival_seq DESC) = 1""",
        "recent_transactions": """SELECT transaction_id, customer_id, event_timestamp FROM tx_raw
            ORDER BY event_timestamp DESC, transaction_id LIMIT 10""",
    }
    own = {
        "classification_report": {
            "counts": f"{_confusion(0.85)} FROM scored_labels",
            "per_class": f"""SELECT '0' AS label, {_NP} AS p, {_NR} AS r, {_NF} AS f, tn + fp AS support FROM counts
                UNION ALL SELECT '1', {_P}, {_R}, {_F}, fn + tp FROM counts""",
        },
        "psi_amount": _psi_parts(_AMOUNT_VALUES),
        "psi_all_features": psi_all,
        "drift_report": psi_all,
    }
    built = {name: _statement(text, **own.get(name, {})) for name, text in sql.items()}
    built["merchant_visit_features"] = _statement(
        f"SELECT transaction_id, customer_id, merchant_id, {_VISITS} FROM visits", **short
    )
    for name in ("average_precision", "roc_auc"):
        column = "pr_auc" if name == "average_precision" else "roc_auc"
        built[name] = _statement(f"SELECT round({column}, 9) AS {column} FROM areas", **_ranking("scored_labels"))
    mine = "(SELECT * FROM scored_labels WHERE transaction_id IN (SELECT transaction_id FROM predictions WHERE model = 'MODEL_B'))"
    built["evaluate_deployed"] = _statement(
        f"""SELECT tn + fp + fn + tp AS rows, 'MODEL_B' AS model, 'demo-b-v1' AS model_version, 0.5::DOUBLE AS threshold,
            round({_P}, 9) AS precision, round({_R}, 9) AS recall, round({_F}, 9) AS f1, tn, fp, fn, tp,
            round(pr_auc, 9) AS pr_auc, round(roc_auc, 9) AS roc_auc FROM areas, ({_confusion(0.5)} FROM {mine})""",
        **_ranking(mine),
    )
    built["stream_feature_rows"] = _statement(
        f"""SELECT v.transaction_id, v.customer_id, {_FEATURES} FROM visits v JOIN rolling r ON r.transaction_id = v.transaction_id"""
    )
    built["stream_feature_rows_hot"] = _statement(
        f"SELECT v.transaction_id, v.customer_id, {_FEATURES} FROM visits v JOIN rolling r ON r.transaction_id = v.transaction_id",
        **{"tx_ms": _PARTS["tx_ms"].replace("SELECT *", "SELECT * REPLACE ('cust-all' AS customer_id)"), **short},
    )
    built["stream_late_rows"] = _statement(
        """SELECT transaction_id, customer_id, moved AS event_timestamp, late, NOT late AS has_features FROM (
             SELECT r.*, coalesce(floor(epoch(moved) / 86400) <= floor(epoch(max(moved) OVER (PARTITION BY customer_id ORDER BY part
                    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 86400) - 9, false) AS late
             FROM (SELECT t.*, CAST(arrival_seq * 3 // (SELECT max(arrival_seq) + 1 FROM tx_raw) AS INTEGER) AS part,
                          CASE WHEN merchant_category = 'error' THEN event_timestamp - INTERVAL 20 DAY ELSE event_timestamp END AS moved
                   FROM tx_raw t) r)"""
    )
    built["stream_labels_current"] = _statement(
        """SELECT transaction_id, is_fraud, label_source, label_timestamp, NULL::VARCHAR AS reject_reason FROM labels_now UNION ALL
           SELECT transaction_id, NULL, NULL, NULL, CASE WHEN NOT (label_confidence BETWEEN 0 AND 1) THEN 'labelConfidence must be between 0 and 1'
                  ELSE 'transaction is unknown' END
           FROM labels_normal WHERE NOT (label_confidence BETWEEN 0 AND 1) OR transaction_id NOT IN (SELECT transaction_id FROM tx_raw)"""
    )
    built["merchant_window_maintained"] = built["merchant_window"]
    built["merchant_visit_features_maintained"] = f"""SELECT * FROM ({built["merchant_visit_features"]})
        WHERE transaction_id IN (SELECT concat('tx-', event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00')"""
    built["ledger_status_merged"] = built["ledger_status"]
    built["drift_report_rolled"] = " UNION ALL ".join(
        f"SELECT {-k} AS as_of, * FROM ({built['drift_report'].replace(_AS_OF, f'({_AS_OF} - INTERVAL {k} DAY)')}) r{k}" for k in range(5)
    )
    built["training_dataset_incremental"] = built["training_dataset_model_b"]
    built["training_guards"] = _statement(
        """SELECT count(*) AS rows, count(*) FILTER (WHERE part = 'train') AS train_rows, count(DISTINCT is_fraud) AS labels,
           count(DISTINCT CASE WHEN part = 'train' THEN is_fraud END) AS train_labels,
           count(*) FILTER (WHERE part = 'train' AND is_fraud = 1) AS train_positive FROM parts"""
    )
    scaled = ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM fitted)) / coalesce(nullif((SELECT stddev_pop({c}) FROM fitted), 0), 1), 9) AS scaled_{c}"
        for c in ("transaction_amount", "label_confidence")
    )
    categories = ("merchant_category", "transaction_country")
    built["preprocessed"] = _statement(
        f"SELECT transaction_id, {scaled}, {', '.join(f'coalesce(n_{c}.i, (SELECT count(*) FROM n_{c}))::INTEGER AS index_{c}' for c in categories)} "
        f"FROM examples e {' '.join(f'LEFT JOIN n_{c} ON n_{c}.value = e.{c}' for c in categories)}",
        fitted="SELECT e.* FROM examples e JOIN parts p ON p.transaction_id = e.transaction_id WHERE p.part = 'train'",
        **{
            f"n_{c}": f"SELECT {c} AS value, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i FROM fitted GROUP BY {c}" for c in categories
        },
    )
    built["stream_dedupe"] = _statement("SELECT transaction_id, customer_id FROM tx_raw")
    built["rolling_stats_running_sums"] = built["rolling_stats"]
    built["customer_feature_rows_hot"] = built["customer_feature_rows"]
    built["pit_merchant_hot"] = built["pit_merchant"]
    return built
