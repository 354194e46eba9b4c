"""Streams against the batch operators and against a replay in order of arrival."""

import tempfile
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from test_features import frame, make_rows
from tidemark.checks.views import view
from tidemark.operators.feature_rows import transaction_features
from tidemark.operators.ledger import known_labels, labels_current
from tidemark.operators.clean import validate_labels
from tidemark.operators.scoring import rule_score
from tidemark.schemas import CUSTOMER_FEATURES
from tidemark.streaming.features import stream_dedupe, stream_features
from tidemark.streaming.tables import compact, read_upserted, stream_labels, stream_score, stream_upsert


def folder():
    return tempfile.mkdtemp(prefix="tidemark-stream-")


def write_parts(df, order, parts):
    """One file per consecutive range of ``order``, with file times in that order."""
    root = folder()
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    edges = [float("-inf"), *bounds, float("inf")]
    for low, high in zip(edges, edges[1:]):
        part = df.where((F.col(order) > low) & (F.col(order) <= high))
        part.coalesce(1).write.mode("append").parquet(root)
    return root, df.schema


def open_stream(spark, root, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def run(writer):
    query = writer.option("checkpointLocation", folder()).trigger(availableNow=True).start()
    query.awaitTermination()


def to_parquet(stream):
    out = folder()
    run(stream.writeStream.format("parquet").option("path", out))
    return stream.sparkSession.read.parquet(out)


def test_stream_features_equal_batch_on_ordered_input(spark, sf_dir):
    tx = view(spark, sf_dir, "tx_raw")
    root, schema = write_parts(tx, "arrival_seq", 3)
    got = to_parquet(stream_features(open_stream(spark, root, schema), window_days=7, expire=False))
    columns = ["transaction_id", "customer_id", *CUSTOMER_FEATURES]
    want = transaction_features(tx, window_days=7).select(*columns)
    assert got.count() == tx.count()
    assert got.select(*columns).exceptAll(want).count() == 0


def test_repeated_ids_are_ignored(spark, sf_dir):
    tx = view(spark, sf_dir, "tx_raw")
    again = tx.withColumn("arrival_seq", F.col("arrival_seq") + 1)
    root, schema = write_parts(tx.unionByName(again), "arrival_seq", 2)
    assert to_parquet(stream_features(open_stream(spark, root, schema), expire=False)).count() == tx.count()
    assert to_parquet(stream_dedupe(open_stream(spark, root, schema))).count() == tx.count()


def test_late_transactions_see_what_is_kept(spark):
    start = datetime(2024, 3, 1, tzinfo=timezone.utc)

    def event(i, hours, merchant):
        ms = int((start + timedelta(hours=hours)).timestamp() * 1000)
        return {"id": f"tx-{i}", "customer": "c", "merchant": merchant, "amount": Decimal(10 * (i + 1)), "country": "SE", "ms": ms}

    batches = [[event(0, 0, "m-1"), event(1, 240, "m-2")], [event(2, 239, "m-1")], [event(3, 100, "m-3")]]
    root = folder()
    for batch in batches:
        frame(spark, batch).selectExpr("*", "'x' AS merchant_category").coalesce(1).write.mode("append").parquet(root)
    schema = spark.read.parquet(root).schema
    rows = {r["transaction_id"]: r for r in to_parquet(stream_features(open_stream(spark, root, schema), expire=False)).collect()}
    # One hour late: the later transaction is not in its windows, the merchant was seen on day 0.
    assert rows["tx-2"]["customer_transaction_count_24h"] == 1
    assert rows["tx-2"]["current_merchant_visit_count_30d"] == 1
    # Days late: older transactions have left the rolling list, the day buckets are still there.
    assert rows["tx-3"]["customer_transaction_count_24h"] == 1
    assert rows["tx-3"]["customer_avg_amount_7d"] == 40.0
    assert rows["tx-3"]["customer_distinct_merchants_30d"] == 1


def test_stream_upsert_and_compaction(spark, sf_dir):
    tx = view(spark, sf_dir, "tx_dup")
    root, schema = write_parts(tx, "arrival_seq", 3)
    out, packed = folder(), folder()
    run(stream_upsert(open_stream(spark, root, schema), out, ["transaction_id"], "arrival_seq", writer="main"))
    compact(spark, out, packed, ["transaction_id"])
    for path in (out, packed):
        newest = read_upserted(spark, path, ["transaction_id"])
        assert newest.count() == tx.select("transaction_id").distinct().count()
        want = tx.groupBy("transaction_id").agg(F.max("arrival_seq").alias("arrival_seq"))
        assert newest.select("transaction_id", "arrival_seq").exceptAll(want).count() == 0


def test_writers_and_compactions_leave_each_other_alone(spark):
    out = folder()
    for writer, value in (("one", 1), ("two", 2)):
        root = folder()
        spark.createDataFrame([(f"{writer}-{i}", value, i) for i in range(3)] + [("both", value, value)], "k string, v int, n int").write.mode("append").parquet(root)
        run(stream_upsert(open_stream(spark, root, spark.read.parquet(root).schema), out, ["k"], "n", writer=writer))
        compact(spark, out, out, ["k"], "n")
    rows = {r["k"]: r["v"] for r in read_upserted(spark, out, ["k"], "n").collect()}
    assert len(rows) == 7 and rows["both"] == 2


def test_late_transactions_stay_in_the_deduplicated_stream(spark):
    root, start = folder(), datetime(2024, 3, 1, tzinfo=timezone.utc)
    for i, day in enumerate([0, 40, 1, 1]):
        row = spark.createDataFrame([(f"tx-{min(i, 2)}", start + timedelta(days=day))], "transaction_id string, event_timestamp timestamp")
        row.coalesce(1).write.mode("append").parquet(root)
    got = to_parquet(stream_dedupe(open_stream(spark, root, spark.read.parquet(root).schema)))
    assert sorted(r["transaction_id"] for r in got.collect()) == ["tx-0", "tx-1", "tx-2"]


def test_stream_score_writes_every_table(spark, sf_dir):
    tx = view(spark, sf_dir, "tx_raw")
    root, schema = write_parts(tx, "arrival_seq", 2)
    out = folder()

    def scorer(model, inputs):
        named = inputs.withColumns({"requested_model": F.lit(model), "amount": F.col("transaction_amount")})
        return rule_score(named, amount=100.0)

    run(stream_score(stream_features(open_stream(spark, root, schema), expire=False), out, scorer, writer="main"))
    log = spark.read.parquet(f"{out}/fraud_prediction_logs")
    assert log.count() == tx.count()
    assert {r["n"] for r in log.selectExpr("size(features_used) AS n").distinct().collect()} == {7, 20}
    assert spark.read.parquet(f"{out}/rejected").count() == 0
    assert spark.read.parquet(f"{out}/customer_transaction_stats").count() == tx.count()
    high = log.where("decision = 'DECLINE'").count()
    assert high == tx.where("requested_model = 'MODEL_B' AND amount >= 100").count() > 0
    assert spark.read.parquet(f"{out}/decision_events").where("line LIKE '%decision=DECLINE%'").count() == high


def test_stream_labels_equal_batch(spark, sf_dir):
    tx, feed = view(spark, sf_dir, "tx_raw"), view(spark, sf_dir, "label_feed")
    now = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
    root, schema = write_parts(feed, "arrival_seq", 3)
    out = folder()
    run(stream_labels(open_stream(spark, root, schema), out, lambda: tx, now, writer="main"))
    valid, invalid = validate_labels(feed, now)
    known, unknown = known_labels(valid, tx)
    current = read_upserted(spark, f"{out}/fraud_labels", ["transaction_id"], "arrival_seq")
    want = labels_current(known).select("transaction_id", "is_fraud", "label_source")
    assert current.select("transaction_id", "is_fraud", "label_source").exceptAll(want).count() == 0
    assert current.count() == want.count()
    assert spark.read.parquet(f"{out}/fraud_label_events").count() == known.count()
    assert spark.read.parquet(f"{out}/rejected_labels").count() == invalid.count() + unknown.count()


def test_window_is_checked(spark, sf_dir):
    rows = frame(spark, make_rows(1, n=2))
    with pytest.raises(ValueError):
        stream_features(rows, window_days=0)
