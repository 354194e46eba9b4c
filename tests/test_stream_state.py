"""The keyed state of the live path against a plain replay of every micro-batch, with an in-memory store."""

import math
import random
import time
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replay import DAY
from test_streaming import folder, open_stream, to_parquet, write_parts
from tidemark.checks.views import view
from tidemark.schemas import CUSTOMER_FEATURES
from tidemark.streaming import features
from tidemark.streaming.features import _CustomerMemory, split_late, stream_features
from tidemark.streaming.memory import WEEK_MS, half_up

HOUR = DAY // 24
FEATURES = list(CUSTOMER_FEATURES)


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map:
    """Entries by key; counts what is read and written."""

    def __init__(self):
        self.entries, self.touched = {}, 0

    def exists(self):
        return bool(self.entries)

    def getValue(self, key):
        self.touched += 1
        return self.entries.get(tuple(key))

    def updateValue(self, key, value):
        self.touched += 1
        self.entries[tuple(key)] = tuple(value)

    def removeKey(self, key):
        self.entries.pop(tuple(key), None)

    def iterator(self):
        return iter(list(self.entries.items()))

    def keys(self):
        return iter(list(self.entries))

    def clear(self):
        self.entries.clear()


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def memory(window_days=30, expire=True, late_rows=False):
    made = _CustomerMemory(window_days, expire, late_rows)
    made.init(Handle())
    return made


def batch_frame(events):
    rows = [
        {
            "customer_id": "c", "transaction_id": e["id"], "merchant_id": e["merchant"], "merchant_category": "x", "amount": e["cents"] / 100,
            "country": "SE", "requested_model": "MODEL_A", "event_timestamp": pd.Timestamp(e["ms"], unit="ms"), "ms": e["ms"], "cents": e["cents"],
            "abroad": e["abroad"], "arrived_ms": e["arrived"],
        }
        for e in events
    ]
    return pd.DataFrame(rows)


def feed(made, events):
    out = list(made.handleInputRows(("c",), iter([batch_frame(events)]), None))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["transaction_id", *FEATURES, "beyond_horizon"])


class Plain:
    """One event after the other on plain lists."""

    def __init__(self, window_days, expire):
        self.window_days, self.expire = window_days, expire
        self.rows, self.buckets, self.markers = [], {}, {}
        self.now = self.newest = self.written = -(2**62)

    def _features(self, e):
        def window(width):
            return [r for r in self.rows if e["ms"] - width <= r["ms"] <= e["ms"]]

        day, week = window(DAY), window(7 * DAY)
        total = sum(r["cents"] for r in week)
        today, merged = e["ms"] // DAY, {}
        for (d, m), (n, first, last, _) in sorted(self.buckets.items()):
            if today - self.window_days < d <= today:
                k = merged.setdefault(m, [0, first, last])
                k[0], k[1], k[2] = k[0] + n, min(k[1], first), max(k[2], last)
        ranked = sorted(merged, key=lambda m: (-merged[m][0], m))
        all_visits, mine = sum(v[0] for v in merged.values()), merged.get(e["merchant"])
        rolling = [
            len(window(HOUR)), len(day), sum(r["cents"] for r in day) / 100.0, half_up(total, len(week), 0) / 100.0, max(r["cents"] for r in week) / 100.0,
            len({r["merchant"] for r in day}), sum(r["abroad"] for r in week),
        ]
        if mine is None:
            return [*rolling, 0, 0.0, 0, 0, -1.0, -1.0, len(merged), 1, ranked[0] if ranked else ""]
        since = [half_up(max(0, e["ms"] - moment), DAY, 6) for moment in mine[1:]]
        place = ranked.index(e["merchant"]) + 1
        return [*rolling, mine[0], half_up(mine[0], all_visits, 6), place, int(place == 1), *since, len(merged), 0, ranked[0]]

    def feed(self, events):
        out, seen = {}, set()
        ordered = [e for e in sorted(events, key=lambda e: (e["ms"], e["id"])) if not (e["id"] in seen or seen.add(e["id"]))]
        clocks, ahead = [], max(self.newest, self.now)
        for e in ordered:
            ahead = max(ahead, e["ms"])
            clocks.append(e["arrived"] if self.expire else ahead)
        self.now = max(self.now, max(clocks))
        if self.expire:
            if self.written + 8 * DAY <= self.now:
                self.rows = []
            last = {}
            for (d, _), v in self.buckets.items():
                last[d] = max(last.get(d, v[3]), v[3])
            self.buckets = {k: v for k, v in self.buckets.items() if last[k[0]] + (self.window_days + 2) * DAY > self.now}
        for e, clock in zip(ordered, clocks):
            age = clock - self.markers[e["id"]] if e["id"] in self.markers else math.inf
            if age < 8 * DAY:
                continue
            self.markers[e["id"]] = clock
            self.rows = [r for r in [*self.rows, e] if r["ms"] > e["ms"] - WEEK_MS - 1]
            out[e["id"]] = self._features(e)
            if age >= (self.window_days + 2) * DAY:
                key = (e["ms"] // DAY, e["merchant"])
                n, first, last, _ = self.buckets.get(key, (0, e["ms"], e["ms"], 0))
                self.buckets[key] = (n + 1, min(first, e["ms"]), max(last, e["ms"]), self.now)
            self.newest, self.written = max(self.newest, e["ms"]), self.now
        if not self.expire:
            oldest = self.newest // DAY - self.window_days - 2
            self.buckets = {k: v for k, v in self.buckets.items() if k[0] > oldest}
        return out


@given(st.integers(0, 10**9), st.sampled_from([1, 3, 30]), st.booleans(), st.sampled_from([1, 12, 60]), st.sampled_from([(1, 1, 0), (3, 2, 900), (1000, 256, 0), (1000, 256, 50_000)]))
@settings(max_examples=250, deadline=None)
def test_micro_batches_equal_a_replay(seed, window_days, expire, days, limits):
    """Late, repeated and simultaneous transactions, silent stretches and any cut into micro-batches and entries."""
    rng = random.Random(seed)
    features.DAY_ROWS, features.MARKERS, features.SMALL = limits
    made, plain = memory(window_days, expire), Plain(window_days, expire)
    arrival = 1000 * DAY
    for _ in range(rng.randrange(1, 7)):
        arrival += rng.choice([0, HOUR, DAY, 9 * DAY, 40 * DAY])
        start = 900 * DAY + rng.randrange(days * DAY)
        events = [
            {
                "id": f"t{rng.randrange(40)}", "ms": start + rng.choice([0, 0, 1, HOUR, rng.randrange(days * DAY)]), "merchant": f"m{rng.randrange(4)}",
                "cents": rng.randrange(1, 900), "abroad": rng.randrange(2), "arrived": arrival,
            }
            for _ in range(rng.randrange(1, 14))
        ]
        got = feed(made, events)
        got = {r["transaction_id"]: [r[c] for c in FEATURES] for r in got.to_dict("records")}
        assert got == plain.feed(events)
    features.DAY_ROWS, features.MARKERS, features.SMALL = 1000, 256, 50_000


def test_silent_customers_are_forgotten_by_timers():
    """Windows go 8 days after the last write, visits and markers with the visit window; nothing is left in the end."""
    made = memory(30, True)
    arrival = 1000 * DAY
    feed(made, [{"id": "t", "ms": 990 * DAY, "merchant": "m", "cents": 5, "abroad": 0, "arrived": arrival}])
    fired = []
    while made.handle.timers:
        due = min(made.handle.timers)
        made.handle.timers.discard(due)
        list(made.handleExpiredTimer(("c",), SimpleNamespace(getCurrentWatermarkInMs=lambda: due), None))
        fired.append((due - arrival, made.rows.exists(), made.visits.exists(), made.markers.exists()))
    assert fired[0][0] <= 8 * DAY + 2 * HOUR and fired[0][1:] == (False, True, True)
    assert fired[-1][0] <= 42 * DAY and fired[-1][1:] == (False, False, False)
    assert not made.known.exists()


def test_work_of_a_micro_batch_follows_its_rows():
    """A customer with 100 000 transactions in 40 micro-batches: time per transaction stays, entries touched follow the rows."""
    rng = np.random.default_rng(3)
    n, batches = 100_000, 40
    ms = np.sort(rng.integers(900 * DAY, 940 * DAY, n))
    merchant = rng.integers(0, 5000, n)
    made, seconds, touched = memory(30, False), [], []
    held = made.maps
    for part in np.array_split(np.arange(n), batches):
        events = [
            {"id": f"t{k}", "ms": int(ms[k]), "merchant": f"m{merchant[k]:05d}", "cents": 100 + k % 7, "abroad": k % 2, "arrived": 0} for k in part.tolist()
        ]
        start, before = time.perf_counter(), held["rows"].touched + held["sums"].touched
        got = feed(made, events)
        seconds.append(time.perf_counter() - start)
        touched.append(held["rows"].touched + held["sums"].touched - before)
        assert len(got) == len(events)
    assert sum(seconds[30:]) < 4 * sum(seconds[5:15]) + 1
    # A micro-batch of one day reads two days and writes one, besides the sums of the week.
    assert max(touched) < 24 * 12
    assert len(held["rows"].entries) <= 7 * 24 + 2 and len(held["visits"].entries) <= 33 and len(held["markers"].entries) > 100


def test_late_rows_go_to_an_output_of_their_own(spark):
    start = datetime(2024, 3, 1, tzinfo=timezone.utc)
    root = folder()
    for part in ([("t1", 0), ("t2", 60)], [("t3", 59), ("t4", 1)], [("t5", 28), ("t6", 29), ("t4", 1)]):
        rows = [("c", i, "m", "x", 10.0, "SE", start + timedelta(days=d)) for i, d in part]
        df = spark.createDataFrame(
            rows, "customer_id string, transaction_id string, merchant_id string, merchant_category string, amount double, country string, event_timestamp timestamp"
        )
        df.coalesce(1).write.mode("append").parquet(root)
    schema = spark.read.parquet(root).schema
    found = to_parquet(stream_features(open_stream(spark, root, schema), expire=False, late_rows=True))
    main, late = split_late(found)
    assert sorted(r["transaction_id"] for r in main.collect()) == ["t1", "t2", "t3", "t6"]
    assert sorted(r["transaction_id"] for r in late.collect()) == ["t4", "t5"]
    assert main.where("customer_transaction_count_24h IS NULL").count() == 0
    assert found.where("beyond_horizon AND customer_transaction_count_24h IS NOT NULL").count() == 0


def test_horizons_by_arrival(spark):
    """A clock that moves with the data: copies within 8 days give no row, later ones no second visit, and visits go in the end."""
    start, root = datetime(2024, 3, 1, tzinfo=timezone.utc), folder()
    feed_days = [("t1", 0, 0), ("t1", 0, 1), ("t2", 1, 2), ("t1", 0, 12), ("t3", 2, 13), ("other", 0, 60), ("t4", 3, 61)]
    for i, event_day, arrival_day in feed_days:
        row = ("x" if i == "other" else "c", i, "m", "x", 10.0, "SE", start + timedelta(days=event_day), start + timedelta(days=arrival_day))
        df = spark.createDataFrame(
            [row],
            "customer_id string, transaction_id string, merchant_id string, merchant_category string, amount double, country string, "
            "event_timestamp timestamp, at timestamp",
        )
        df.coalesce(1).write.mode("append").parquet(root)
    schema = spark.read.parquet(root).schema
    got = to_parquet(stream_features(open_stream(spark, root, schema), expire=True, arrived="at"))
    rows = [(r["transaction_id"], r["current_merchant_visit_count_30d"], r["customer_transaction_count_24h"]) for r in got.collect()]
    # t1: the copy of the next day is ignored; that of day 12 counts in the windows only, which were empty by then.
    # t3 sees the visits of t1 and t2 once each; t4 comes when all of them have outlived their horizon.
    assert sorted(rows) == [("other", 0, 1), ("t1", 0, 1), ("t1", 1, 1), ("t2", 1, 2), ("t3", 2, 1), ("t4", 0, 1)]


@pytest.mark.parametrize("parts", [4])
def test_stream_equals_batch_over_many_micro_batches(spark, sf_dir, parts):
    from tidemark.operators.feature_rows import transaction_features

    tx = view(spark, sf_dir, "tx_raw")
    root, schema = write_parts(tx, "arrival_seq", parts)
    got = to_parquet(stream_features(open_stream(spark, root, schema), expire=True))
    columns = ["transaction_id", "customer_id", *CUSTOMER_FEATURES]
    want = transaction_features(tx).select(*columns)
    assert got.count() == tx.count()
    assert got.select(*columns).exceptAll(want).count() == 0
    assert got.select(F.countDistinct("transaction_id")).first()[0] == tx.count()


@pytest.mark.parametrize("limits", [(1000, 256, 50_000), (3, 2, 300)])
def test_customers_of_a_group_share_a_call(limits, monkeypatch):
    """One frame in and one out for all customers of a group, each with the rows of a memory of its own; timers leave nothing behind."""
    for name, value in zip(("DAY_ROWS", "MARKERS", "SMALL"), limits):
        monkeypatch.setattr(features, name, value)
    rng = random.Random(8)
    group = features._GroupMemory(30, True, True)
    group.init(Handle())
    alone = {c: memory(late_rows=True) for c in ("a", "b", "c", None)}
    arrival = 1_700_000_000_000
    for turn in range(6):
        arrival += rng.choice([HOUR, 3 * DAY, 9 * DAY])
        here = {c: [] for c in alone if turn % 2 or c != "a"}
        for c, events in here.items():
            for k in range(rng.randrange(1, 12)):
                events.append(
                    {"id": f"t{rng.randrange(40)}", "merchant": f"m-{rng.randrange(4)}", "cents": rng.randrange(1, 999), "abroad": k % 2,
                     "ms": arrival - rng.randrange(40) * 5 * HOUR * (8 if k == 7 else 1), "arrived": arrival}
                )
        frames = [batch_frame(events).assign(customer_id=pd.Series([c] * len(events), dtype=object)) for c, events in here.items()]
        mixed = pd.concat(frames, ignore_index=True).sample(frac=1, random_state=turn)
        out = list(group.handleInputRows((1,), iter([mixed.iloc[:5], mixed.iloc[5:]]), None))
        assert sorted(o["beyond_horizon"].iloc[0] for o in out) in ([False], [False, True])
        found = {(r["customer_id"], r["transaction_id"]): r for o in out for r in o.astype(object).to_dict("records")}
        expected = {}
        for c in here:
            mine = mixed[mixed["customer_id"].isna() if c is None else mixed["customer_id"] == c]
            for o in alone[c].handleInputRows((c,), iter([mine]), None):
                expected |= {(c, r["transaction_id"]): r for r in o.astype(object).to_dict("records")}
        assert found.keys() == expected.keys()
        for key, r in expected.items():
            assert {k: v for k, v in found[key].items() if not pd.isna(v)} == {k: v for k, v in r.items() if not pd.isna(v)}
    handle = group.scope.handle
    while handle.timers:
        due = min(handle.timers)
        handle.timers.discard(due)
        passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: due)
        list(group.handleExpiredTimer((1,), passed, SimpleNamespace(getExpiryTimeInMs=lambda: due)))
    kept = [group.member.known.values, group.scope.lists, group.scope.due, *[p.entries for p in group.scope.parts]]
    assert not any(m.entries for m in kept)
