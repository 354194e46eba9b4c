"""Ways for large tables against those they replace."""

import random

import pandas as pd
from pyspark.sql import functions as F

from test_features import frame, make_rows
from test_stream_state import batch_frame, feed, memory
from test_streaming import folder
from tidemark.checks import queries
from tidemark.operators.rolling import add_rolling, dates_near
from tidemark.operators.visits import add_visits, ids_repeat
from tidemark.streaming import features

VISITS = [
    "transaction_id", "customer_id", "current_merchant_visit_count_30d", "current_merchant_visit_share_30d", "current_merchant_rank_30d",
    "days_since_first_seen_current_merchant", "days_since_last_seen_current_merchant", "customer_distinct_merchants_30d", "top_visited_merchant_id_30d",
]


def odd(spark):
    """Few merchants, so that they tie and overtake; some without a customer, a merchant or a moment."""
    return frame(spark, make_rows(11, n=300)).selectExpr(
        "* EXCEPT (merchant_id, customer_id, event_timestamp)",
        "if(crc32(transaction_id) % 11 = 0, null, concat('m-', crc32(concat(transaction_id, 'm')) % 4)) AS merchant_id",
        "if(crc32(transaction_id) % 13 = 0, null, customer_id) AS customer_id",
        "if(crc32(transaction_id) % 17 = 0, null, event_timestamp) AS event_timestamp",
    )


def test_visits_by_lists_equal_visits_by_rows(spark):
    tx = odd(spark)
    for days in (1, 7, 30):
        lists, rows = [add_visits(tx, days, sliced=False, lists=way).select(*VISITS) for way in (True, False)]
        assert lists.count() == tx.count() and lists.exceptAll(rows).count() == 0 and rows.exceptAll(lists).count() == 0


def test_repeated_ids_keep_their_way(spark):
    tx = odd(spark)
    assert not ids_repeat(tx) and not ids_repeat(tx.limit(0)) and ids_repeat(tx.unionByName(tx.limit(3)))


def test_lists_sort_one_row_per_day_and_no_blocks(spark):
    """A day's merchants are not rows among the transactions, nor is a transaction multiplied."""
    plan = add_visits(odd(spark), 30, sliced=False, lists=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Generate") == 1


def test_frames_by_bigint_equal_those_by_decimal(spark):
    tx = odd(spark).where("event_timestamp IS NOT NULL")
    tx = tx.unionByName(tx.withColumn("transaction_id", F.concat(F.lit("same-ms-"), "transaction_id")))
    near, exact = [add_rolling(tx, sliced=False, frames=True, near=way) for way in (True, False)]
    assert near.exceptAll(exact).count() == 0 and near.count() == tx.count()
    assert dates_near(tx) and not dates_near(tx.selectExpr("* EXCEPT (event_timestamp)", "timestamp_millis(2000000000000000) AS event_timestamp"))


def test_micro_batches_have_many_files(spark, monkeypatch):
    """As many micro-batches as asked for, each of several files, with the rows of its stretch of arrivals."""
    monkeypatch.setattr(queries, "FILE_ROWS", 10)
    rows = spark.range(100).selectExpr("if(id < 90, id, 3 * id) AS arrival_seq", "id")
    seen, files = {}, []

    def look(batch, number):
        seen[number] = sorted(r["arrival_seq"] for r in batch.collect())
        files.append(batch.select(F.input_file_name()).distinct().count())

    stream = queries._micro_batches(rows, 3, "growth")
    stream.writeStream.foreachBatch(look).option("checkpointLocation", folder()).trigger(availableNow=True).start().awaitTermination()
    ids = [k if k < 90 else 3 * k for k in range(100)]
    assert seen == {k: [i for i in ids if i * 3 // 298 == k] for k in range(3)}
    assert files[:2] == [3, 0]


def test_a_large_micro_batch_of_one_customer_in_pieces(monkeypatch):
    """State and rows are the same whether a micro-batch is handed out in pieces or at once, and none of it is one large entry."""
    rng = random.Random(5)
    events = [
        {"id": f"t{rng.randrange(2500)}", "merchant": f"m-{rng.randrange(9)}", "cents": rng.randrange(1, 9999), "abroad": rng.randrange(2),
         "ms": 1_700_000_000_000 + rng.randrange(9 * 86_400) * 1000, "arrived": 1_700_800_000_000}
        for _ in range(3000)
    ]
    found = []
    for pieces in (10_000, 100):
        monkeypatch.setattr(features, "ROWS_AT_ONCE", pieces)
        made = memory()
        found.append(pd.concat([feed(made, events[:2000]), feed(made, events[2000:])], ignore_index=True))
        assert max(len(ids) for ids, _ in made.maps["markers"].entries.values()) <= 4 * features.MARKERS
    pd.testing.assert_frame_equal(*found)
    made = memory()
    assert max(len(out) for out in made.handleInputRows(("c",), iter([batch_frame(events)]), None)) == 100
