"""Transactions, labels, ledger events and payloads derived from the given tables.

Each view is one SQL text that Spark and DuckDB both run; names in braces are other views.
Every view covers all rows of the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import use_utc

VIEWS = {
    "tx_raw": """
        SELECT concat('tx-', event_id) AS transaction_id, concat('cust-', user_id) AS customer_id,
               concat('card-', user_id) AS card_id,
               concat('m-', lpad(cast(k % 20 AS string), 2, '0')) AS merchant_id, event_type AS merchant_category,
               cast(value AS decimal(18,2)) AS amount, 'EUR' AS currency,
               CASE (event_id + cast(floor(event_id / 10.0) AS bigint)) % 10 WHEN 0 THEN 'NO' WHEN 3 THEN 'US' ELSE 'SE' END AS country,
               ts AS event_timestamp,
               CASE WHEN cast(floor(event_id / 10.0) AS bigint) % 2 = 0 THEN 'MODEL_A' ELSE 'MODEL_B' END AS requested_model,
               event_id AS arrival_seq
        FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM {events}) e
    """,
    "tx_dirty": """
        SELECT transaction_id, CASE WHEN arrival_seq % 89 = 0 THEN '  ' ELSE concat(' ', customer_id, ' ') END AS customer_id,
               card_id, merchant_id, upper(merchant_category) AS merchant_category,
               CASE WHEN arrival_seq % 97 = 0 THEN -amount WHEN arrival_seq % 101 = 0 THEN NULL ELSE amount END AS amount,
               lower(currency) AS currency, lower(country) AS country,
               CASE WHEN arrival_seq % 103 = 0 THEN NULL ELSE event_timestamp END AS event_timestamp,
               CASE WHEN arrival_seq % 3 = 0 THEN NULL ELSE lower(requested_model) END AS requested_model, arrival_seq
        FROM {tx_raw}
    """,
    "tx_dup": """
        SELECT * FROM {tx_raw}
        UNION ALL
        SELECT transaction_id, customer_id, card_id, merchant_id, merchant_category, cast(amount + 1 AS decimal(18,2)) AS amount,
               currency, country, event_timestamp, requested_model, arrival_seq + 100000000 AS arrival_seq
        FROM {tx_raw}
        UNION ALL
        SELECT transaction_id, customer_id, card_id, merchant_id, merchant_category, cast(amount + 2 AS decimal(18,2)) AS amount,
               currency, country, event_timestamp, requested_model, arrival_seq + 200000000 AS arrival_seq
        FROM {tx_raw} WHERE country = 'US'
    """,
    "label_feed": """
        SELECT concat('tx-', l.doc_id * 10) AS transaction_id, l.toxic AS is_fraud,
               coalesce(e.ts, TIMESTAMP '2024-01-15 00:00:00') + (l.doc_id % 23 - 2) * INTERVAL '1' DAY AS label_timestamp,
               'Chargeback' AS label_source, cast(1.0 AS double) AS label_confidence, l.doc_id AS arrival_seq
        FROM {labels} l LEFT JOIN {events} e ON e.event_id = l.doc_id * 10
        UNION ALL
        SELECT concat('tx-', l.doc_id * 10), 1 - l.toxic, coalesce(e.ts, TIMESTAMP '2024-01-15 00:00:00') + INTERVAL '1' DAY, ' Review ', cast(0.8 AS double),
               l.doc_id + 100000000
        FROM {labels} l LEFT JOIN {events} e ON e.event_id = l.doc_id * 10 WHERE l.quality = 0
        UNION ALL
        SELECT concat('tx-missing-', l.doc_id), l.toxic, e.ts, 'dispute', cast(1.2 AS double), l.doc_id + 200000000
        FROM {labels} l LEFT JOIN {events} e ON e.event_id = l.doc_id * 10 WHERE l.toxic = 1
    """,
    "ledger_feed": """
        SELECT transaction_id, requested_model AS model, 'STARTED' AS status, cast(NULL AS string) AS error_message,
               arrival_seq * 3 AS seq
        FROM {tx_raw} WHERE merchant_category <> 'signup'
        UNION ALL
        SELECT transaction_id, requested_model,
               CASE WHEN merchant_category = 'error' THEN 'FAILED' ELSE 'PREDICTION_RECORDED' END,
               CASE WHEN merchant_category = 'error' THEN repeat('upstream error ', 80) END, arrival_seq * 3 + 1
        FROM {tx_raw} WHERE merchant_category IN ('error', 'view', 'purchase')
        UNION ALL
        SELECT transaction_id, requested_model, 'DECISION_PUBLISHED', NULL, arrival_seq * 3 + 2
        FROM {tx_raw} WHERE merchant_category = 'view'
    """,
    "payloads": """
        SELECT transaction_id,
               CASE WHEN arrival_seq % 11 = 0 THEN 'not json' WHEN arrival_seq % 13 = 0 THEN '{{"predictions": [{{"fraud_score": "abc"}}]}}'
                    WHEN arrival_seq % 17 = 0 THEN '{{"predictions": [{{"fraud_score": null, "score": 7}}]}}'
                    WHEN arrival_seq % 19 = 0 THEN '{{"predictions": []}}' ELSE
               concat('{{"predictions": [{{"', CASE WHEN arrival_seq % 2 = 0 THEN 'fraud_score' ELSE 'score' END, '": ',
                      CASE WHEN arrival_seq % 7 = 0 THEN concat('"', cast(arrival_seq % 100 AS string), '"')
                           ELSE cast(arrival_seq % 100 AS string) END, '}}]}}') END AS prediction,
               concat('{{"metadata": {{"feature_names": [', CASE WHEN arrival_seq % 3 = 0 THEN '"merchant_risk_score"' WHEN arrival_seq % 3 = 1 THEN 'null'
                      ELSE '"extra"' END, ', "customer_id", "merchant_risk_score"]}}, "results": [{{"values": ["first"]}}, {{"values": ["', customer_id,
                      '"]}}, {{"values": [', CASE WHEN arrival_seq % 5 = 0 THEN '' ELSE cast(arrival_seq % 10 AS string) END, ']}}]}}') AS features
        FROM {tx_raw}
    """,
    "predictions": """
        SELECT transaction_id, requested_model AS model,
               CASE requested_model WHEN 'MODEL_A' THEN 'demo-a-v1' ELSE 'demo-b-v1' END AS model_version,
               cast((arrival_seq * 37 % 100) / 100.0 AS double) AS fraud_score, event_timestamp AS inference_timestamp, arrival_seq
        FROM {tx_raw}
    """,
}

_NEEDS = {
    "tx_raw": ["events"],
    "tx_dirty": ["tx_raw"],
    "tx_dup": ["tx_raw"],
    "label_feed": ["events", "labels"],
    "ledger_feed": ["tx_raw"],
    "payloads": ["tx_raw"],
    "predictions": ["tx_raw"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{need: view(spark, sf_dir, need) for need in _NEEDS[name]})


def view_sql(name: str) -> str:
    """The same text for DuckDB, where the other views are common table expressions."""
    names = [*VIEWS, "events", "labels"]
    return VIEWS[name].format(**{n: n for n in names})
