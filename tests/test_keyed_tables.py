"""Keyed tables of streams: what is read, what a compaction leaves, and interrupted writers."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_streaming import folder, open_stream, run
from tidemark.checks.views import view
from tidemark.operators import ledger, visits
from tidemark.streaming import tables as streams
from tidemark.streaming.keyed import FAN, Folder, KeyedTable, Part, latest

SCHEMA = "k string, day int, v int, n int"


def stored_rows(spark, table):
    return sum(spark.read.parquet(str(p)).count() for p in Path(table.path).rglob("*.parquet"))


def make(path=None, fan_buckets=4, day="day"):
    return KeyedTable(path or folder(), "k", latest(["k"], "n"), fan_buckets, day)


def batch(spark, number, keys=20, days=3):
    rows = [(f"k{k}", k % days, number, number * 100 + k) for k in range(keys)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rows_stored_fall_and_levels_grow(spark):
    table = make()
    for number in range(7):
        table.append(batch(spark, number), "main", number)
        if number == 3:
            assert [p.level for p in table.compact(spark, fan=3)] == [0, 0, 0]
            assert stored_rows(spark, table) == 40  # one folded part and the newest micro-batch
    before = stored_rows(spark, table)
    table.compact(spark, fan=3)
    assert stored_rows(spark, table) < before
    parts = table.parts(spark)
    assert sorted(p.level for p in parts) == [0, 1, 1]
    table.append(batch(spark, 7), "main", 7)
    table.append(batch(spark, 8), "main", 8)
    table.append(batch(spark, 9), "main", 9)
    table.compact(spark, fan=3)
    assert sorted(p.level for p in table.parts(spark)) == [0, 2] and stored_rows(spark, table) == 40
    rows = table.read(spark).collect()
    assert len(rows) == 20 and {r["v"] for r in rows} == {9}


def test_reads_name_buckets_and_days(spark):
    table = make()
    for number in range(12):
        rows = [(f"k{k}", number, number, number * 100 + k) for k in range(40)]
        table.append(spark.createDataFrame(rows, SCHEMA), "main", number)
    keys = spark.createDataFrame([("k1",), ("k2",)], "k string")
    wanted = table.bucket_numbers(keys)
    assert 1 <= len(wanted) <= 2
    found = table.read(spark, wanted, {10, 11})
    assert {r["k"] for r in found.where("k IN ('k1', 'k2')").collect()} == {"k1", "k2"}
    everything = len(table.read(spark).inputFiles())
    assert len(found.inputFiles()) <= 2 * len(wanted) < everything / 10
    assert table.read(spark, wanted, {99}) is None and table.read(spark, [], {11}) is None
    assert make().read(spark) is None


def test_repeated_and_interrupted_batches(spark):
    table = make(day=None)
    table.append(batch(spark, 0), "main", 0)
    table.append(batch(spark, 1), "main", 1)
    # The stream repeats its newest micro-batch: it must not see itself, and replaces what it wrote.
    assert {r["v"] for r in table.read(spark, without=("main", 1)).collect()} == {0}
    table.append(batch(spark, 1, keys=10), "main", 1)
    assert {(r["k"], r["v"]) for r in table.read(spark).collect()} == {(f"k{k}", int(k < 10)) for k in range(20)}
    # A micro-batch without its mark of success is not there yet.
    table.append(batch(spark, 2), "other", 0)
    Folder(spark, table.path).delete("writer=other/batch=0000000000/_SUCCESS")
    assert all(p.folder.startswith("writer=main") for p in table.parts(spark))
    # A folded micro-batch that was not deleted is not read again, and goes with the next compaction.
    table.append(batch(spark, 2), "main", 2)
    table.append(batch(spark, 3), "main", 3)
    table.compact(spark, fan=2)
    table.append(batch(spark, 0, keys=30), "main", 0)
    assert table.read(spark).count() == 20
    table.append(batch(spark, 4), "main", 4)
    table.append(batch(spark, 5), "main", 5)
    table.compact(spark, fan=2)
    assert not (Path(table.path) / "writer=main" / "batch=0000000000").exists()


def test_only_one_of_two_compactions_publishes(spark, monkeypatch):
    table = make()
    for number in range(4):
        table.append(batch(spark, number), "main", number)
    create = Folder.create

    def overtaken(self, name, content):
        create(self, name, json.dumps({"parts": [], "folded": {}}))
        return create(self, name, content)

    monkeypatch.setattr(Folder, "create", overtaken)
    assert table.compact(spark, fan=2) == []
    monkeypatch.undo()
    assert table.read(spark).count() == 20 and all(isinstance(p, Part) and p.level == 0 for p in table.parts(spark))


def test_day_buckets_kept_up_by_parts(spark, sf_dir):
    tx = view(spark, sf_dir, "tx_raw")
    table = KeyedTable(folder(), "customer_id", visits.merge_buckets, 2, "day")
    for k in range(5):
        table.append(visits.merchant_day_buckets(tx.where(f"arrival_seq % 5 = {k}")), "main", k)
        table.compact(spark, fan=2)
    want = visits.merchant_day_buckets(tx)
    assert table.read(spark).select(*want.columns).exceptAll(want).count() == 0 and table.read(spark).count() == want.count()


def test_ledger_states_merge_in_any_order(spark, sf_dir):
    events = view(spark, sf_dir, "ledger_feed")
    whole = ledger.fold_ledger(events)
    parts = [ledger.fold_ledger(events.where(f"pmod(seq, 4) = {k}")) for k in (2, 0, 3, 1)]
    merged = parts[0]
    for part in parts[1:]:
        merged = ledger.merge_ledger(merged.unionByName(part))
    assert merged.exceptAll(whole).count() == 0 and merged.count() == whole.count()


def test_compaction_in_place_leaves_fewer_rows(spark):
    out = folder()
    for number in range(4):
        streams.write_batch(spark.createDataFrame([(f"k{k}", number, number) for k in range(10)], "k string, v int, n int"), out, "main", number)
    streams.compact(spark, out, out, ["k"], "n")
    assert spark.read.parquet(out).count() == 20
    streams.compact(spark, out, out, ["k"], "n")
    assert spark.read.parquet(out).count() == 20
    rows = streams.read_upserted(spark, out, ["k"], "n").collect()
    assert len(rows) == 10 and {r["v"] for r in rows} == {3}


def test_decisions_read_a_bounded_share(spark, monkeypatch):
    """Six micro-batches, two weeks apart each: what one reads does not grow, and nobody is scored without own history."""
    start, root = datetime(2024, 1, 1, 12), folder()
    schema = (
        "transaction_id string, customer_id string, card_id string, merchant_id string, merchant_category string, amount decimal(18,2), "
        "currency string, country string, event_timestamp timestamp, requested_model string, arrival_seq long"
    )
    incoming = folder()
    for number in range(6):
        at = start + timedelta(days=14 * number)
        rows = [
            (f"t{number}-{k}", f"c{k % 5}", "card", f"m{k % 2}", "grocery", None, "EUR", "SE", at + timedelta(hours=k), "MODEL_B", number * 100 + k)
            for k in range(10)
        ]
        df = spark.createDataFrame(rows, schema).withColumn("amount", F.expr("cast(10 AS decimal(18, 2))"))
        df.coalesce(1).write.mode("append").parquet(incoming)
    seen = []
    rows_of = KeyedTable.rows

    def counted(self, spark, parts, buckets=None, days=None):
        found = rows_of(self, spark, parts, buckets, days)
        if days is not None:
            seen.append((self.path.rsplit("/", 1)[1], len(found.inputFiles()) if found is not None else 0))
        return found

    monkeypatch.setattr(KeyedTable, "rows", counted)
    stream = open_stream(spark, incoming, spark.read.parquet(incoming).schema)

    def scorer(model, inputs):
        counted = "current_merchant_visit_count_30d" if "current_merchant_visit_count_30d" in inputs.columns else "0"
        return inputs.selectExpr("*", f"least(0.1D * {counted}, 1.0D) AS fraud_score")

    run(streams.stream_decisions(stream, root, scorer, writer="main", buckets=2))
    read = {name: [n for table, n in seen if table == name] for name in ("transactions", "merchant_day_buckets")}
    assert read["transactions"] == [0] * 6 and max(read["merchant_day_buckets"]) <= 8
    scores = {r["transaction_id"]: round(r["fraud_score"], 9) for r in spark.read.parquet(f"{root}/fraud_prediction_logs").collect()}
    assert len(scores) == 60
    # Each customer visits either merchant once per micro-batch; 30 days hold the two micro-batches before.
    assert [scores[f"t{n}-0"] for n in range(6)] == [0.0, 0.1, 0.2, 0.2, 0.2, 0.2]


@pytest.mark.parametrize("fan", [FAN])
def test_small_tables_are_left_alone(spark, fan):
    table = make()
    table.append(batch(spark, 0), "main", 0)
    assert table.compact(spark, fan) == []
