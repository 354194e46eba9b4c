"""Rows and state in pieces, and features of many visits at a time, against one row after the other."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replay import DAY
from test_stream_state import Handle, Plain, batch_frame, feed, memory
from test_streaming import folder, open_stream, to_parquet
from tidemark.checks.views import view
from tidemark.schemas import CUSTOMER_FEATURES
from tidemark.streaming import features, packs
from tidemark.streaming.features import stream_features
from tidemark.streaming.memory import Crowd, Standing

FEATURES = list(CUSTOMER_FEATURES)


@given(st.integers(0, 10**9), st.sampled_from([1, 3, 30]), st.booleans(), st.sampled_from([1, 12]), st.sampled_from([(1, 1, 0), (3, 2, 900), (1000, 256, 50_000)]))
@settings(max_examples=100, deadline=None)
def test_visits_in_arrays_equal_a_replay(seed, window_days, expire, days, limits):
    rng = random.Random(seed)
    before = features.DAY_ROWS, features.MARKERS, features.SMALL, features.CROWD_ROWS
    features.DAY_ROWS, features.MARKERS, features.SMALL, features.CROWD_ROWS = (*limits, 0)
    try:
        made, plain, arrival = memory(window_days, expire), Plain(window_days, expire), 1000 * DAY
        for _ in range(rng.randrange(1, 6)):
            arrival += rng.choice([0, DAY, 9 * DAY, 40 * DAY])
            start = 900 * DAY + rng.randrange(days * DAY)
            events = [
                {
                    "id": f"t{rng.randrange(60)}", "ms": start + rng.choice([0, 1, rng.randrange(DAY), rng.randrange(days * DAY)]),
                    "merchant": f"m{rng.randrange(5)}", "cents": rng.randrange(1, 900), "abroad": rng.randrange(2), "arrived": arrival,
                }
                for _ in range(rng.randrange(1, 30))
            ]
            got = {r["transaction_id"]: [r[c] for c in FEATURES] for r in feed(made, events).to_dict("records")}
            assert got == plain.feed(events)
    finally:
        features.DAY_ROWS, features.MARKERS, features.SMALL, features.CROWD_ROWS = before


@pytest.mark.parametrize("merchants", [1, 2, 7, 300])
def test_a_crowd_stands_as_its_visits_do(merchants):
    """Ranks, tops and first visits of many visits at a time, some of them not counted, over stored days and several calls a day."""
    rng, names = np.random.default_rng(merchants), [f"m{k:04d}" for k in range(merchants)]
    stored = {}
    for day in (3, 9, 10, 12):
        who = np.sort(rng.choice(merchants, max(1, merchants // 2), replace=False))
        first = day * DAY + rng.integers(0, DAY // 2, len(who))
        stored[day] = who, rng.integers(1, 6, len(who)), first, first + rng.integers(0, DAY // 2, len(who))
    standing = Standing({(d, names[m]): tuple(v) for d, value in stored.items() for m, *v in zip(*[c.tolist() for c in value])}, 7)
    crowd = Crowd(dict(stored), merchants, 7)
    for day in (9, 10, 11, 12, 17):
        ms = np.sort(day * DAY + rng.integers(0, DAY, 400))
        who, counted = rng.integers(0, merchants, 400) * rng.integers(0, 2, 400), rng.random(400) < 0.9
        expected = []
        for m, at, counts in zip(who.tolist(), ms.tolist(), counted.tolist()):
            standing.move_to(day)
            expected.append(standing.features(names[m], at))
            if counts:
                standing.count(names[m], at, day)
        crowd.move_to(day)
        found = [np.concatenate(c) for c in zip(*[crowd.features(who[p], ms[p], counted[p]) for p in np.array_split(np.arange(400), 3)])]
        found[-1] = np.array([*names, ""], object)[found[-1]]
        assert [list(r) for r in zip(*[c.tolist() for c in found])] == expected


def test_rows_of_a_customer_reach_the_handler_in_few_pieces(monkeypatch):
    """A piece holds many rows with equal keys, and none is lost; before, each row came by itself."""
    monkeypatch.setattr(packs, "PIECE_ROWS", 200)
    monkeypatch.setattr(packs, "DEALT_ROWS", 500)
    rng = random.Random(3)
    events = [{"id": f"t{k}", "merchant": "m", "cents": k, "abroad": 0, "ms": k, "arrived": rng.randrange(2)} for k in range(1200)]
    frame = batch_frame(events).assign(customer_group=[rng.randrange(3) if k < 500 else 1 for k in range(1200)], merchant_id=["m", None] * 600)
    frame["arrived"] = pd.to_datetime(frame["arrived_ms"], unit="ms", utc=True).astype("datetime64[us, UTC]")
    batches = pa.Table.from_pandas(frame, preserve_index=False).to_batches(max_chunksize=100)
    out = pa.Table.from_batches(packs.packer(["customer_group", "arrived"], features._ROW)(batches)).to_pandas()
    assert len(out) <= 6 + 2 * 4 + 2 * 2
    rows = []
    for group, arrived, piece in out.itertuples(index=False):
        part = packs.unpacked(pd.DataFrame({"piece": [piece]}), features._ROW).to_pandas()
        assert len(part) <= 200 and set(part["arrived_ms"]) == {arrived.value // 1_000_000}
        rows += [(group, r.transaction_id, r.merchant_id, r.cents) for r in part.itertuples()]
    assert sorted(rows, key=lambda r: r[3]) == list(frame[["customer_group", "transaction_id", "merchant_id", "cents"]].itertuples(index=False, name=None))


def test_rows_leave_the_handler_in_pieces(monkeypatch):
    """Few records for many rows, each with a place of its own, so that many tasks read and write them; before, the task of the customer did."""
    monkeypatch.setattr(packs, "PIECE_ROWS", 100)
    events = [{"id": f"t{k}", "merchant": f"m{k % 3}", "cents": k, "abroad": 0, "ms": 900 * DAY + k, "arrived": 1000 * DAY} for k in range(950)]
    made = [kind(30, True, True) for kind in (features._PieceMemory, features._GroupMemory)]
    for m in made:
        m.init(Handle())
    out, plain = (pd.concat(list(m.handleInputRows((3,), iter([batch_frame(events)]), None)), ignore_index=True) for m in made)
    assert len(out) == out["place"].nunique() == 10
    batches = packs.unpacker(features._OUT)(pa.RecordBatch.from_pandas(out[["piece"]], preserve_index=False).slice(k, 5) for k in (0, 5))
    found = pa.Table.from_batches(batches).to_pandas()
    pd.testing.assert_frame_equal(found, plain, check_dtype=False)


def test_state_values_are_one_piece():
    kinds = packs.columns_of("merchants array<string>, visits array<bigint>, written bigint")
    for value in ((["a", None, "ö"], [1, 2, 3], 7), ([], [], 0)):
        data = packs.to_bytes(value, kinds)
        assert isinstance(data, bytes) and tuple(packs.plain(v) if k < 2 else v for k, v in enumerate(packs.from_bytes(data, kinds))) == value


def test_groups_of_markers_stay_few():
    """36 million ids of a customer were 262 144 groups, each read and written by a call of its own in every micro-batch."""
    groups = 1
    for ids in range(9_000_000, 36_000_001, 9_000_000):
        groups = features._groups(groups, ids)
    assert groups <= 16_384 and 36_000_000 / groups < 10_000
    assert features._groups(1, 100_000) == 256


def test_entries_of_a_group_are_binary():
    """A large customer's state reaches the store as binary values; as arrays, every element was looked at on the way."""
    group = features._GroupMemory(30, True, False)
    group.init(Handle())
    events = [{"id": f"t{k}", "merchant": f"m{k % 7}", "cents": 1, "abroad": 0, "ms": 900 * DAY + k * 1000, "arrived": 1000 * DAY} for k in range(5000)]
    out = pd.concat(list(group.handleInputRows((1,), iter([batch_frame(events)]), None)))
    assert len(out) == 5000
    for part in group.scope.parts:
        assert part.entries.entries and all([type(v) for v in value] == [bytes] for value in part.entries.entries.values())


@pytest.mark.parametrize("one_hash", [False, True])
def test_repeated_ids_of_a_large_micro_batch(monkeypatch, one_hash):
    """The first row of an id stays, of each customer, also where other ids have its hash and many rows their moment."""
    rng = random.Random(4)
    events = [
        {"id": f"t{rng.randrange(300)}", "merchant": f"m{rng.randrange(5)}", "cents": rng.randrange(1, 99), "abroad": 0, "ms": 900 * DAY + rng.randrange(20) * 1000, "arrived": 1}
        for _ in range(600)
    ]
    frame = batch_frame(events).assign(customer_id=[rng.choice(["a", "b", None]) for _ in events])
    found = []
    for pieces in (10_000, 50):
        monkeypatch.setattr(features, "ROWS_AT_ONCE", pieces)
        if one_hash:
            monkeypatch.setattr(features, "crc32", lambda data: 5)
        found.append([(c, ids.to_pylist(), columns["cents"].tolist()) for c, columns, ids in features._arranged(iter([frame[:250], frame[250:]]))])
    assert found[0] == found[1]
    for c, ids, cents in found[0]:
        mine = frame[frame["customer_id"].isna() if c is None else frame["customer_id"] == c].sort_values(["ms", "transaction_id"], kind="stable")
        mine = mine.drop_duplicates("transaction_id")
        assert (ids, cents) == (mine["transaction_id"].tolist(), mine["cents"].tolist())


def test_pieces_keep_the_watermark_of_their_rows(spark, sf_dir):
    """Rows that arrive before the watermark of earlier micro-batches are left out one by one, as without pieces; those at other times stay."""
    tx = view(spark, sf_dir, "tx_raw").limit(40).withColumn("customer_id", F.lit("c"))
    root = folder()
    for k, hours in enumerate([(100,), (100,), (1, 100), (1, 101)]):
        part = tx.where(f"pmod(xxhash64(transaction_id), 4) = {k}").withColumn("hour", F.element_at(F.array(*map(F.lit, hours)), F.expr(f"cast(pmod(arrival_seq, {len(hours)}) + 1 AS int)")))
        part.withColumn("at", F.expr("timestamp_seconds(1700000000 + hour * 3600)")).coalesce(1).write.mode("append").parquet(root)
    given_rows = spark.read.parquet(root)
    got = to_parquet(stream_features(open_stream(spark, root, given_rows.schema), arrived="at"))
    kept = given_rows.where("hour >= 100")
    assert given_rows.where("hour = 1").count() > 0
    assert sorted(r[0] for r in got.select("transaction_id").collect()) == sorted(r[0] for r in kept.select("transaction_id").collect())
