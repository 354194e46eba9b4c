"""Customer features against the plain replay, on the plain, the running-sum and the sliced way."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from replay import replay
from tidemark.operators import scan
from tidemark.operators.feature_rows import customer_feature_rows, transaction_features
from tidemark.operators.visits import merchant_day_buckets, merchant_visit_features
from tidemark.schemas import CUSTOMER_FEATURES

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_rows(seed, n=400, customers=4, merchants=6, days=12, step_ms=3_600_000):
    """Skewed customers and merchants, many equal times, times on window edges."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        customer = "cust-0" if rng.random() < 0.6 else f"cust-{rng.randrange(customers)}"
        merchant = "m-0" if rng.random() < 0.3 else f"m-{rng.randrange(merchants)}"
        ms = int(START.timestamp() * 1000) + rng.randrange(days * 86_400_000 // step_ms) * step_ms + rng.choice([0, 0, 0, 1, -1])
        rows.append(
            {
                "id": f"tx-{i:05d}",
                "customer": customer,
                "merchant": merchant,
                "amount": Decimal(rng.randrange(1, 500_000)).scaleb(-3),
                "country": rng.choice(["SE", "se", "NO", "US"]),
                "ms": ms,
            }
        )
    return rows


def frame(spark, rows):
    data = [
        (
            r["id"],
            r["customer"],
            r["merchant"],
            r["amount"],
            r["country"],
            datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=r["ms"]),
        )
        for r in rows
    ]
    return spark.createDataFrame(
        data,
        "transaction_id string, customer_id string, merchant_id string, amount decimal(18,3), country string, "
        "event_timestamp timestamp",
    )


WAYS = {
    "frames": {},
    "running sums": {"frame_rows": 0},
    "hot customer": {"slice_rows": 150, "frame_rows": 10**6},
    "all sliced": {"slice_rows": 0, "merchants": 0},
    "scanned": {"slice_rows": 0},
    "scanned and sliced": {"slice_rows": 60, "merchants": 5},
}


# The sliced ways run many small jobs, so they get one data set each.
CASES = [("frames", 1, 30), ("frames", 3, 1), ("running sums", 2, 3), ("hot customer", 2, 5), ("all sliced", 1, 30), ("scanned", 1, 30), ("scanned", 3, 1), ("scanned and sliced", 2, 5)]


@pytest.mark.parametrize("way,seed,window_days", CASES)
def test_features_equal_replay(spark, way, seed, window_days):
    rows = make_rows(seed, step_ms=[3_600_000, 1_800_000, 21_600_000][seed - 1])
    expected = replay(rows, window_days=window_days)
    got = transaction_features(frame(spark, rows), window_days=window_days, **WAYS[way]).collect()
    assert len(got) == len(rows)
    for row in got:
        want = expected[row["transaction_id"]]
        for name in CUSTOMER_FEATURES:
            assert row[name] == want[name], (way, row["transaction_id"], name)


def test_one_customer_and_one_day_in_many_slices(spark):
    """No task gets more than its slice of the moves."""
    rows = [{**r, "customer": "cust-0"} for r in make_rows(6, n=600, days=1, merchants=9, step_ms=60_000)]
    df = frame(spark, rows)
    expected = replay(rows)
    plain = {r["transaction_id"]: r.asDict() for r in transaction_features(df, slice_rows=0).collect()}
    assert all(plain[i][name] == expected[i][name] for i in expected for name in CUSTOMER_FEATURES)
    moves = scan._moves(df, "SE").repartitionByRange(6, *scan._ORDER).groupBy(F.spark_partition_id()).count().collect()
    assert len(moves) == 6 and max(r["count"] for r in moves) < 2 * 4 * 600 / 6


def test_stored_buckets_stand_for_older_transactions(spark):
    """Buckets of older days and the transactions since then give the visits of all transactions, on the plain way and on the hot one."""
    rows = make_rows(7, n=300, days=20, step_ms=21_600_000)
    df, cut = frame(spark, rows), int(START.timestamp() * 1000) + 9 * 86_400_000
    old, new = (df.where(f"unix_millis(event_timestamp) {how} {cut}") for how in ("<", ">="))
    expected = replay(rows, window_days=6)
    for limits in ({}, {"slice_rows": 0}, {"slice_rows": 0, "merchants": 0}):
        got = transaction_features(new, window_days=6, stored=merchant_day_buckets(old), **limits).collect()
        assert len(got) == sum(r["ms"] >= cut for r in rows) > 100
        for row in got:
            for name in list(CUSTOMER_FEATURES)[7:]:
                assert row[name] == expected[row["transaction_id"]][name], (limits, row["transaction_id"], name)


def test_a_far_future_date_is_no_obstacle(spark):
    rows = make_rows(4, n=60)
    rows[7]["ms"] = 253_000_000_000_000
    frames, sums = [
        {r["transaction_id"]: r for r in transaction_features(frame(spark, rows), **WAYS[way]).collect()} for way in ("frames", "running sums")
    ]
    assert frames == sums and frames["tx-00007"]["customer_transaction_count_24h"] == 1


def test_equal_times_keep_the_last_transaction(spark):
    rows = make_rows(5, n=120)
    table = customer_feature_rows(frame(spark, rows)).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        last[(r["customer"], r["ms"])] = r["id"]
    assert len(table) == len(last)
    expected = replay(rows)
    for row in table:
        key = (row["customer_id"], int(row["event_timestamp"].replace(tzinfo=timezone.utc).timestamp() * 1000))
        assert row["customer_transaction_count_24h"] == (
            expected[last[key]]["customer_transaction_count_24h"]
        )


def test_window_must_hold_a_day(spark):
    with pytest.raises(ValueError):
        merchant_visit_features(frame(spark, make_rows(1, n=3)), window_days=0)
