"""One query per operator over the given tables; ``oracle`` holds the SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checks.views import VIEWS as VIEW_SQL
from tidemark.checks.views import view
from tidemark.operators import clean, feature_rows, joins, ledger, metrics, rolling, scoring, tables, visits
from tidemark.plans import drift, evaluation, serving, training
from tidemark.schemas import CUSTOMER_FEATURES, VIEWS
from tidemark.session import cut_lineage, new_folder, stored, use_utc
from tidemark.sources import readers, sinks
from tidemark.streaming import features
from tidemark.streaming import tables as streams
from tidemark.streaming.features import stream_features
from tidemark.streaming.keyed import Folder, KeyedTable

AS_OF = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
EARLY = "TIMESTAMP_NTZ '2024-01-02 00:00:00'"
MIN_LABEL_AGE = 5
SHORT_WINDOW = 7
RANGES = {"baseline": (30, 14), "current": (14, 0)}
REVIEW_AMOUNT = 100.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _tx(spark, sf_dir):
    return view(spark, sf_dir, "tx_raw")


def _customer_rows(spark, sf_dir):
    return feature_rows.customer_feature_rows(_tx(spark, sf_dir))


def _stored_customer_rows(spark, sf_dir):
    """The feature table written once, for jobs that read it more than once."""
    return stored(_customer_rows(spark, sf_dir), "customer-rows")


def _merchant_rows(spark, sf_dir):
    return feature_rows.merchant_feature_rows(_tx(spark, sf_dir))


def _labels(spark, sf_dir):
    """Current labels: normalised, valid, of recorded transactions."""
    valid, _ = clean.validate_labels(view(spark, sf_dir, "label_feed"), AS_OF)
    known, _ = ledger.known_labels(valid, _tx(spark, sf_dir))
    return ledger.labels_current(known)


def _scored(spark, sf_dir):
    predictions = view(spark, sf_dir, "predictions").select("transaction_id", "fraud_score")
    return predictions.join(_labels(spark, sf_dir).select("transaction_id", "is_fraud"), "transaction_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.selectExpr(*[f"round({c}, 9) AS {c}" if c in columns else c for c in df.columns])


# Sources and sinks


@query
def bootstrap_features(spark, sf_dir):
    customers = VIEWS["customer_transaction_stats_view"]
    stored = tables.online_values(_customer_rows(spark, sf_dir), customers)
    first = readers.bootstrap_features(spark, customers, datetime(2024, 1, 1)).drop("created_timestamp")
    return first.unionByName(stored).drop("event_timestamp")


@query
def upsert_latest_transactions(spark, sf_dir):
    return tables.upsert_latest(view(spark, sf_dir, "tx_dup"), ["transaction_id"], "arrival_seq")


@query
def upsert_latest_predictions(spark, sf_dir):
    log = view(spark, sf_dir, "predictions")
    again = log.where("fraud_score >= 0.5").selectExpr(
        "transaction_id", "model", "model_version", "1.0D - fraud_score AS fraud_score", "inference_timestamp",
        "arrival_seq + 100000000 AS arrival_seq",
    )
    return _rounded(
        tables.merge_upsert(log, again, ["transaction_id", "model", "model_version"], "arrival_seq"), "fraud_score"
    )


@query
def latest_customer_features(spark, sf_dir):
    return tables.latest_features(_customer_rows(spark, sf_dir), "customer_id")


@query
def latest_merchant_features(spark, sf_dir):
    return tables.latest_features(_merchant_rows(spark, sf_dir), "merchant_id")


@query
def decision_events(spark, sf_dir):
    scored = scoring.decide(scoring.rule_score(_tx(spark, sf_dir), amount=REVIEW_AMOUNT))
    return sinks.decision_events(scored.withColumnRenamed("requested_model", "model"))


@query
def label_events(spark, sf_dir):
    return sinks.label_events(_labels(spark, sf_dir))


# Projections, validation


@query
def normalize_transactions(spark, sf_dir):
    return clean.normalize_transactions(view(spark, sf_dir, "tx_dirty"))


@query
def validate_transactions(spark, sf_dir):
    return clean.validate_transactions(view(spark, sf_dir, "tx_dirty"))[0]


@query
def rejected_by_reason(spark, sf_dir):
    return clean.rejected_by_reason(clean.validate_transactions(view(spark, sf_dir, "tx_dirty"))[1])


@query
def normalize_labels(spark, sf_dir):
    return clean.normalize_labels(view(spark, sf_dir, "label_feed"), AS_OF)


@query
def validate_labels(spark, sf_dir):
    return clean.check_labels(view(spark, sf_dir, "label_feed"), AS_OF).select("transaction_id", "arrival_seq", "reject_reason")


@query
def decisions(spark, sf_dir):
    return scoring.decide(view(spark, sf_dir, "predictions")).select("transaction_id", "fraud_score", "decision")


@query
def classified_rows(spark, sf_dir):
    return scoring.classified_rows(_scored(spark, sf_dir))


@query
def resolve_model(spark, sf_dir):
    asked = _tx(spark, sf_dir).selectExpr(
        "transaction_id",
        "CASE merchant_category WHEN 'error' THEN 'MODEL_X' WHEN 'signup' THEN null ELSE requested_model END AS requested_model",
        "if(merchant_category = 'view', 'own_feature_service', ' ') AS feature_service",
    )
    return scoring.resolve_model(asked)


@query
def transaction_payload(spark, sf_dir):
    return scoring.transaction_payload(_tx(spark, sf_dir)).drop("arrival_seq")


@query
def rule_score(spark, sf_dir):
    scored = scoring.rule_score(_tx(spark, sf_dir), amount=REVIEW_AMOUNT)
    return scored.select("transaction_id", "requested_model", "amount", "fraud_score")


@query
def parse_prediction(spark, sf_dir):
    return scoring.parse_prediction(view(spark, sf_dir, "payloads")).select("transaction_id", "fraud_score", "reject_reason")


@query
def flatten_feature_response(spark, sf_dir):
    return scoring.flatten_feature_response(view(spark, sf_dir, "payloads")).selectExpr(
        "transaction_id",
        "feature_map['customer_id'] AS customer_id",
        "feature_map['merchant_risk_score'] AS merchant_risk_score",
        "cast(size(feature_map) AS bigint) AS features",
    )


@query
def validate_inference(spark, sf_dir):
    results = scoring.decide(
        view(spark, sf_dir, "predictions").selectExpr("transaction_id", "nullif(fraud_score, 0.5D) AS fraud_score")
    ).selectExpr(
        "transaction_id", "fraud_score", "decision", "if(fraud_score = 0.25D, array(), array('transaction_amount')) AS features_used"
    )
    return scoring.check_inference(results).select("transaction_id", "reject_reason")


@query
def inference_metadata(spark, sf_dir):
    results = scoring.resolve_model(_tx(spark, sf_dir)).selectExpr(
        "transaction_id", "feature_service", "model_version",
        "map('source', currency, if(country = 'SE', 'model_version', 'note'), country) AS metadata",
    )
    return scoring.with_metadata(results).selectExpr(
        "transaction_id",
        "metadata['model_version'] AS model_version",
        "metadata['feature_service'] AS feature_service",
        "metadata['source'] AS source",
        "cast(size(metadata) AS bigint) AS entries",
    )


@query
def feature_window(spark, sf_dir):
    return clean.feature_window(_tx(spark, sf_dir), AS_OF, 14, 7).select("transaction_id", "event_timestamp")


@query
def mature_labels(spark, sf_dir):
    return clean.mature_labels(_labels(spark, sf_dir), AS_OF, MIN_LABEL_AGE).select("transaction_id", "label_timestamp")


# Idempotency and ledger


@query
def dedupe_transactions(spark, sf_dir):
    return tables.dedupe_transactions(view(spark, sf_dir, "tx_dup"))


def _ledger(spark, sf_dir):
    return ledger.fold_ledger(view(spark, sf_dir, "ledger_feed"))


@query
def ledger_status(spark, sf_dir):
    return _ledger(spark, sf_dir)


@query
def ledger_status_merged(spark, sf_dir):
    """The same states from a snapshot and the states of the events after it."""
    events = view(spark, sf_dir, "ledger_feed")
    snapshot = cut_lineage(ledger.fold_ledger(events.where("status = 'STARTED'")))
    return ledger.merge_ledger(snapshot.unionByName(ledger.ledger_states(events.where("status <> 'STARTED'"))))


@query
def stale_started(spark, sf_dir):
    return ledger.stale_started(_ledger(spark, sf_dir))


@query
def admission_gate(spark, sf_dir):
    gate = ledger.admission(_tx(spark, sf_dir), _ledger(spark, sf_dir))
    return gate.select("transaction_id", "ledger_status", "admitted")


@query
def labels_current(spark, sf_dir):
    return ledger.labels_current(clean.normalize_labels(view(spark, sf_dir, "label_feed"), AS_OF))


@query
def known_labels(spark, sf_dir):
    labels = clean.normalize_labels(view(spark, sf_dir, "label_feed"), AS_OF)
    return ledger.known_labels(labels, _tx(spark, sf_dir))[0].select("transaction_id", "label_source", "arrival_seq")


@query
def unknown_labels(spark, sf_dir):
    labels = clean.normalize_labels(view(spark, sf_dir, "label_feed"), AS_OF)
    return ledger.known_labels(labels, _tx(spark, sf_dir))[1].select("transaction_id", "label_source", "arrival_seq")


@query
def label_history_new(spark, sf_dir):
    labels = clean.normalize_labels(view(spark, sf_dir, "label_feed"), AS_OF)
    history = labels.where("label_source = 'chargeback' AND is_fraud = 0")
    again = labels.withColumns({"is_fraud": F.expr("1 - is_fraud"), "arrival_seq": F.expr("arrival_seq + 1000000000")})
    return tables.append_if_absent(labels.unionByName(again), history).select("transaction_id", "label_source", "label_timestamp", "is_fraud")


@query
def insert_if_absent(spark, sf_dir):
    stored = _tx(spark, sf_dir).where("merchant_category = 'view'")
    return tables.insert_if_absent(view(spark, sf_dir, "tx_dup"), stored, ["transaction_id"], "arrival_seq")


@query
def evolve_schema(spark, sf_dir):
    return tables.evolve_schema(rolling.rolling_customer_stats(_tx(spark, sf_dir)).drop("amount", "arrival_seq"))


# Windows


@query
def rolling_stats(spark, sf_dir):
    stats = rolling.rolling_customer_stats(_tx(spark, sf_dir))
    return stats.select("transaction_id", "customer_id", *list(CUSTOMER_FEATURES)[:7])


@query
def rolling_stats_running_sums(spark, sf_dir):
    """The same features on the way dense customers take."""
    stats = rolling.rolling_customer_stats(_tx(spark, sf_dir), frame_rows=0)
    return stats.select("transaction_id", "customer_id", *list(CUSTOMER_FEATURES)[:7])


@query
def merchant_day_buckets(spark, sf_dir):
    return visits.merchant_day_buckets(_tx(spark, sf_dir))


@query
def merchant_window(spark, sf_dir):
    return visits.merchant_window(visits.merchant_day_buckets(_tx(spark, sf_dir)), SHORT_WINDOW)


@query
def merchant_window_maintained(spark, sf_dir):
    """The same windows from stored day buckets, kept up by the buckets of four parts; the last part holds late transactions."""
    part = "CASE WHEN merchant_category = 'error' THEN 3 ELSE arrival_seq % 3 END"
    transactions = _tx(spark, sf_dir).withColumn("part", F.expr(part))
    table = KeyedTable(new_folder(spark, "day-buckets"), "customer_id", visits.merge_buckets, buckets=2, day="day")
    for k in range(4):
        table.append(visits.merchant_day_buckets(transactions.where(f"part = {k}")), "main", k)
        table.compact(spark, fan=2)
    return visits.merchant_window(table.read(spark), SHORT_WINDOW)


@query
def merchant_visit_features_maintained(spark, sf_dir):
    """Visit features of the last days of all customers from raw transactions of those days and stored buckets of all days before."""
    transactions = _tx(spark, sf_dir)
    old = "event_timestamp < TIMESTAMP_NTZ '2024-01-20 00:00:00'"
    stored = cut_lineage(visits.merchant_day_buckets(transactions.where(old)))
    found = feature_rows.transaction_features(transactions.where(f"NOT ({old})"), window_days=SHORT_WINDOW, stored=stored)
    return found.select("transaction_id", "customer_id", "merchant_id", *list(CUSTOMER_FEATURES)[7:])


@query
def merchant_visit_features(spark, sf_dir):
    found = visits.merchant_visit_features(_tx(spark, sf_dir), SHORT_WINDOW)
    return found.select("transaction_id", "customer_id", "merchant_id", *list(CUSTOMER_FEATURES)[7:])


@query
def customer_feature_rows(spark, sf_dir):
    return _customer_rows(spark, sf_dir)


@query
def customer_feature_rows_hot(spark, sf_dir):
    """The same table with every customer above the slicing limit, as for customers with very many rows."""
    rows = feature_rows.customer_feature_rows(_tx(spark, sf_dir), slice_rows=0)
    return rows


@query
def merchant_feature_rows(spark, sf_dir):
    return _merchant_rows(spark, sf_dir)


def _events_stream(spark, sf_dir):
    events = use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything that is there and read what it wrote."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, name))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


#: Rows of a file that a micro-batch reads, about.
FILE_ROWS = 250_000


def _micro_batches(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """A stream of ``rows`` in order of arrival, so many micro-batches of it.

    Every part has the same number of files, which tasks write and read beside each other; a part with too few rows for that gets empty ones.
    """
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
    known = rows.selectExpr("max(arrival_seq) AS last", "count(arrival_seq) AS n").first()
    end, files = (known["last"] or 0) + 1, max(1, known["n"] // (parts * FILE_ROWS))
    empty = spark.createDataFrame([], rows.schema)
    for k in range(parts):
        # Plain bounds reach the scan.
        part = rows.where(f"arrival_seq BETWEEN {-(-k * end // parts)} AND {((k + 1) * end - 1) // parts}")
        part.repartition(files).sortWithinPartitions("arrival_seq").write.mode("append").parquet(path)
        for _ in range((k + 1) * files - sum(n.startswith("part-") for n in Folder(spark, path).names(""))):
            empty.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query
def stream_feature_rows(spark, sf_dir):
    """The keyed state of the live path, fed with all events in three micro-batches."""
    arriving = _micro_batches(_tx(spark, sf_dir), 3, "stream-features-in")
    rows = _run_to_table(stream_features(arriving, expire=False), "stream-features")
    return rows.select("transaction_id", "customer_id", *CUSTOMER_FEATURES)


@query
def stream_feature_rows_hot(spark, sf_dir):
    """The same with horizons by arrival and all events from one customer."""
    arriving = _micro_batches(_tx(spark, sf_dir).withColumn("customer_id", F.lit("cust-all")), 4, "stream-hot-in")
    rows = _run_to_table(stream_features(arriving, window_days=SHORT_WINDOW), "stream-hot")
    return rows.select("transaction_id", "customer_id", *CUSTOMER_FEATURES)


@query
def stream_late_rows(spark, sf_dir):
    """Some transactions arrive 20 days late; those beyond the horizon of their customer go to an output of their own."""
    late = "if(merchant_category = 'error', event_timestamp - INTERVAL '20' DAY, event_timestamp)"
    arriving = _micro_batches(_tx(spark, sf_dir).withColumn("event_timestamp", F.expr(late)), 3, "stream-late-in")
    rows = _run_to_table(stream_features(arriving, window_days=SHORT_WINDOW, expire=False, late_rows=True), "stream-late")
    main, beyond = features.split_late(rows)
    shown = ["transaction_id", "customer_id", "cast(event_timestamp AS timestamp_ntz) AS event_timestamp"]
    counted = "customer_transaction_count_24h > 0 AS has_features"
    return main.selectExpr(*shown, "false AS late", counted).unionByName(beyond.selectExpr(*shown, "true AS late", "false AS has_features"))


@query
def stream_labels_current(spark, sf_dir):
    """Labels in three micro-batches: the current label of every known transaction, and the reason for every rejected one."""
    feed, root = view(spark, sf_dir, "label_feed"), new_folder(spark, "stream-labels")
    transactions = _tx(spark, sf_dir)
    started = streams.stream_labels(_micro_batches(feed, 3, "stream-labels-in"), root, lambda: transactions, AS_OF, writer="main")
    started.option("checkpointLocation", new_folder(spark, "label-log")).trigger(availableNow=True).start().awaitTermination()
    current = streams.read_upserted(spark, f"{root}/fraud_labels", ["transaction_id"], "arrival_seq")
    rejected = spark.read.parquet(f"{root}/rejected_labels").select("transaction_id", "reject_reason")
    return current.selectExpr(
        "transaction_id", "is_fraud", "label_source", "label_timestamp", "cast(null AS string) AS reject_reason"
    ).unionByName(rejected, allowMissingColumns=True)


@query
def stream_dedupe(spark, sf_dir):
    """Copies of every transaction in one stream; which copy comes first is not defined, so only ids are kept."""
    transactions = spark.sql(VIEW_SQL["tx_raw"], events=_events_stream(spark, sf_dir))
    copies = transactions.unionByName(spark.sql(VIEW_SQL["tx_raw"], events=_events_stream(spark, sf_dir)))
    return _run_to_table(features.stream_dedupe(copies), "stream-dedupe").select("transaction_id", "customer_id")


# Joins


@query
def training_examples(spark, sf_dir):
    return joins.training_examples(_tx(spark, sf_dir), _labels(spark, sf_dir)).drop("annotator_id", "reason_code")


def _as_stream(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a stream of their files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


@query
def stream_upsert_latest(spark, sf_dir):
    """Two writers of one table, each with a checkpoint of its own, and a compaction between them."""
    table, keys = new_folder(spark, "stream-upsert"), ["transaction_id"]
    copies = view(spark, sf_dir, "tx_dup")
    for writer, part in (("again", "country = 'US'"), ("first", "country <> 'US'")):
        stream = _as_stream(copies.where(part), "stream-upsert-in")
        started = streams.stream_upsert(stream, table, keys, "arrival_seq", writer=writer)
        started.option("checkpointLocation", new_folder(spark, "upsert-log")).trigger(availableNow=True).start().awaitTermination()
        streams.compact(spark, table, table, keys, "arrival_seq")
    return streams.read_upserted(spark, table, keys, "arrival_seq")


def _feature_score(model: str, inputs: DataFrame) -> DataFrame:
    """A score that needs a count of the last day and, where the model has them, the visits to the merchant."""
    visits = "current_merchant_visit_count_30d" if "current_merchant_visit_count_30d" in inputs.columns else "0"
    return inputs.selectExpr("*", f"least(0.3D * customer_transaction_count_24h + 0.1D * {visits}, 1.0D) AS fraud_score")


@query
def stream_decisions(spark, sf_dir):
    """Dirty transactions in three micro-batches, in order of arrival."""
    root = new_folder(spark, "stream-decisions")
    stream = _micro_batches(view(spark, sf_dir, "tx_dirty"), 3, "stream-decisions-in")
    started = streams.stream_decisions(stream, root, _feature_score, writer="main", fan=2, buckets=2)
    started.option("checkpointLocation", new_folder(spark, "decision-log")).trigger(availableNow=True).start().awaitTermination()
    states = streams.decision_tables(root, 2)["processing_ledger"].read(spark).select("transaction_id", "status")
    decided = spark.read.parquet(f"{root}/fraud_prediction_logs").join(states, "transaction_id")
    rejected = spark.read.parquet(f"{root}/rejected").select("transaction_id", "reject_reason")
    return decided.selectExpr(
        "transaction_id", "model", "round(fraud_score, 9) AS fraud_score", "decision", "status", "cast(null AS string) AS reject_reason"
    ).unionByName(rejected, allowMissingColumns=True)


def _entities(spark, sf_dir):
    """Probes half a day after each event, so that the newest row is not always the event's own; some so late that rows have expired."""
    return _tx(spark, sf_dir).selectExpr(
        "transaction_id", "customer_id", "merchant_id",
        "event_timestamp + if(merchant_category = 'error', INTERVAL '20' DAY, INTERVAL '12' HOUR) AS event_timestamp",
    )


@query
def pit_customer(spark, sf_dir):
    customers = VIEWS["customer_transaction_stats_view"]
    columns = ["customer_transaction_count_24h", "customer_total_amount_24h", "top_visited_merchant_id_30d"]
    return joins.join_view(_entities(spark, sf_dir), _stored_customer_rows(spark, sf_dir), customers, columns)


@query
def pit_merchant(spark, sf_dir):
    return joins.join_view(
        _entities(spark, sf_dir), _merchant_rows(spark, sf_dir), VIEWS["merchant_risk_view"], ["merchant_risk_score", "merchant_category"]
    )


@query
def pit_merchant_hot(spark, sf_dir):
    """The same join with every merchant above the slicing limit."""
    return joins.join_view(
        _entities(spark, sf_dir), _merchant_rows(spark, sf_dir), VIEWS["merchant_risk_view"], ["merchant_risk_score", "merchant_category"],
        slice_rows=0,
    )


def _dataset(spark, sf_dir, model):
    return training.training_dataset(
        _tx(spark, sf_dir),
        _labels(spark, sf_dir),
        _stored_customer_rows(spark, sf_dir),
        _merchant_rows(spark, sf_dir),
        model,
        AS_OF,
        MIN_LABEL_AGE,
    )


@query
def training_dataset_model_a(spark, sf_dir):
    return _dataset(spark, sf_dir, "MODEL_A")


@query
def training_dataset_model_b(spark, sf_dir):
    return _dataset(spark, sf_dir, "MODEL_B")


@query
def training_dataset_incremental(spark, sf_dir):
    """The set as of ten days earlier, carried on by the labels that matured or changed since."""
    sources = (_tx(spark, sf_dir), _labels(spark, sf_dir), _stored_customer_rows(spark, sf_dir), _merchant_rows(spark, sf_dir), "MODEL_B")
    known = cut_lineage(training.training_dataset(*sources, f"{AS_OF} - INTERVAL '10' DAY", MIN_LABEL_AGE))
    return training.extend_training_dataset(known, *sources, AS_OF, MIN_LABEL_AGE)


def _enriched(spark, sf_dir, service, as_of=None, strict=True):
    return scoring.enrich(
        _tx(spark, sf_dir),
        tables.latest_features(_customer_rows(spark, sf_dir), "customer_id", as_of=as_of),
        tables.latest_features(_merchant_rows(spark, sf_dir), "merchant_id", as_of=as_of),
        service,
        strict,
    )


@query
def enrich_model_a(spark, sf_dir):
    return _enriched(spark, sf_dir, "fraud_model_a_feature_service").where("reject_reason IS NULL").drop("reject_reason")


@query
def enrich_model_b(spark, sf_dir):
    return _enriched(spark, sf_dir, "fraud_model_b_feature_service").where("reject_reason IS NULL").drop("reject_reason")


@query
def enrich_rejected(spark, sf_dir):
    """Against the store as it was on the second day: customers without features are rejected."""
    found = _enriched(spark, sf_dir, "fraud_model_a_feature_service", EARLY)
    return found.where("reject_reason IS NOT NULL").select("transaction_id", "reject_reason")


@query
def enrich_lenient(spark, sf_dir):
    found = _enriched(spark, sf_dir, "fraud_model_a_feature_service", EARLY, strict=False)
    return found.drop("reject_reason")


@query
def labeled_predictions(spark, sf_dir):
    return joins.labeled_predictions(view(spark, sf_dir, "predictions"), _labels(spark, sf_dir), "MODEL_B", "demo-b-v1")


@query
def drift_features(spark, sf_dir):
    return joins.drift_features(_customer_rows(spark, sf_dir), _merchant_rows(spark, sf_dir)).select(
        "customer_id", "event_timestamp", "customer_transaction_count_24h", "current_merchant_visit_share_30d", "merchant_risk_score"
    )


# Training, evaluation, drift


@query
def time_split(spark, sf_dir):
    examples = joins.training_examples(_tx(spark, sf_dir), _labels(spark, sf_dir))
    return training.time_split(examples).select("transaction_id", "is_fraud", "row_index", "part")


@query
def label_counts(spark, sf_dir):
    examples = joins.training_examples(_tx(spark, sf_dir), _labels(spark, sf_dir))
    return training.training_metrics(training.time_split(examples))


@query
def training_guards(spark, sf_dir):
    examples = joins.training_examples(_tx(spark, sf_dir), _labels(spark, sf_dir))
    return training.guard_counts(training.time_split(examples))


@query
def preprocessed(spark, sf_dir):
    """Scaled numbers and category numbers of all examples, from what was fitted on the training part."""
    split = cut_lineage(training.time_split(joins.training_examples(_tx(spark, sf_dir), _labels(spark, sf_dir))))
    numeric, categorical = ["transaction_amount", "label_confidence"], ["merchant_category", "transaction_country"]
    found = training.fit_preprocessor(split.where("part = 'train'"), numeric, categorical).transform(split)
    return found.selectExpr(
        "transaction_id", *[f"round(_scaled_{c}, 9) AS scaled_{c}" for c in numeric], *[f"cast(_index_{c} AS int) AS index_{c}" for c in categorical]
    )


@query
def scored(spark, sf_dir):
    """A model fitted on the first 70 % of the training set and applied to the rest."""
    _, test, _ = training.train_and_evaluate(_dataset(spark, sf_dir, "MODEL_B"), "MODEL_B")
    return test.select("transaction_id", "is_fraud", "fraud_score", "expected_is_fraud")


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(scoring.classified_rows(_scored(spark, sf_dir)))


@query
def precision_recall_f1(spark, sf_dir):
    counts = metrics.confusion(scoring.classified_rows(_scored(spark, sf_dir)))
    return _rounded(metrics.precision_recall_f1(counts), "precision", "recall", "f1")


@query
def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(_scored(spark, sf_dir)), "pr_auc")


@query
def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(_scored(spark, sf_dir)), "roc_auc")


@query
def classification_report(spark, sf_dir):
    counts = metrics.confusion(scoring.classified_rows(_scored(spark, sf_dir)))
    return _rounded(metrics.classification_report(counts), "precision", "recall", "f1")


@query
def psi_amount(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    sides = [
        clean.feature_window(tx, AS_OF, *days).selectExpr(
            "'amount' AS feature", f"'{side}' AS side", "cast(amount AS double) AS value", "1L AS weight"
        )
        for side, days in RANGES.items()
    ]
    return _rounded(drift.psi(drift.count_values(sides[0].unionByName(sides[1])), ["amount"]), "psi")


@query
def psi_all_features(spark, sf_dir):
    found = drift.feature_psi(_stored_customer_rows(spark, sf_dir), _merchant_rows(spark, sf_dir), AS_OF, **RANGES)
    return _rounded(found, "psi")


@query
def drift_report(spark, sf_dir):
    report = drift.drift_report(_stored_customer_rows(spark, sf_dir), _merchant_rows(spark, sf_dir), AS_OF, **RANGES)
    return report.selectExpr(
        "baseline_rows",
        "current_rows",
        "psi_threshold",
        "array_join(map_keys(drifted_features), ',') AS drifted",
        "cast(size(feature_psi) AS bigint) AS features",
        "retrain_recommended",
    )


@query
def drift_report_rolled(spark, sf_dir):
    """The reports of five days in a row from daily counts that are stored once."""
    daily = cut_lineage(drift.daily_counts(_stored_customer_rows(spark, sf_dir), _merchant_rows(spark, sf_dir), AS_OF))
    return drift.rolled_reports(daily, range(-4, 1), **RANGES).selectExpr(
        "as_of",
        "baseline_rows",
        "current_rows",
        "psi_threshold",
        "array_join(map_keys(drifted_features), ',') AS drifted",
        "cast(size(feature_psi) AS bigint) AS features",
        "retrain_recommended",
    )


@query
def evaluate_deployed(spark, sf_dir):
    found = evaluation.evaluate_deployed(
        view(spark, sf_dir, "predictions"), _labels(spark, sf_dir), "MODEL_B", "demo-b-v1", 0.5
    )
    return _rounded(found, "precision", "recall", "f1", "pr_auc", "roc_auc")


@query
def score_batch(spark, sf_dir):
    """The whole pipeline on dirty transactions, those already processed being the stored history.

    The score needs a count of the last day and the visits to the merchant; every input row comes back once.
    """

    states = _ledger(spark, sf_dir)
    done = states.where("status <> 'FAILED'").select("transaction_id")
    history = _tx(spark, sf_dir).join(done, "transaction_id", "left_semi")
    batch = serving.score_batch(view(spark, sf_dir, "tx_dirty"), _feature_score, states, history)
    shown = ["customer_transaction_count_24h", "current_merchant_visit_count_30d"]
    decided = batch.decisions.join(batch.features.select("transaction_id", *shown), "transaction_id").selectExpr(
        "transaction_id", "model", "model_version", "round(fraud_score, 9) AS fraud_score", "decision", *shown,
        "cast(size(features_used) AS bigint) AS features_used", "cast(null AS string) AS reject_reason",
    )
    return decided.unionByName(batch.rejected, allowMissingColumns=True)


@query
def score_batch_ledger(spark, sf_dir):
    """States after scoring; a batch without history, in which unknown models and services fail."""
    asked = view(spark, sf_dir, "tx_dirty").selectExpr(
        "* EXCEPT (requested_model)",
        "CASE merchant_category WHEN 'ERROR' THEN 'MODEL_X' WHEN 'SIGNUP' THEN null ELSE requested_model END AS requested_model",
        "if(merchant_category = 'VIEW', 'fraud_model_b_feature_service', if(merchant_category = 'CLICK', 'nothing', '')) AS feature_service",
    )
    batch = serving.score_batch(asked, lambda model, inputs: inputs.selectExpr("*", "0.7D AS fraud_score"))
    folded = ledger.fold_ledger(batch.ledger_events)
    used = batch.decisions.selectExpr("transaction_id", "cast(size(features_used) AS bigint) AS features_used")
    return folded.select("transaction_id", "model", "status", "error_message").join(used, "transaction_id", "left")


@query
def recent_transactions(spark, sf_dir):
    """Top ten by event time."""
    return joins.recent(_tx(spark, sf_dir)).select("transaction_id", "customer_id", "event_timestamp")
