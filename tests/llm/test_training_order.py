"""Slots of the training order: the same for every split of the input, shards across ranges, shared and missing ids."""

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe, training_order

OPTIONS = {
    "vocabulary": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "length": 8, "stride": 16,
}
TEXTS = [" ".join(f"word{i * k % 97} and" for k in range(i % 60)) for i in range(150)]


def _slots(df):
    return sorted((r.slot, r.shard, r.shard_size, r.doc_id, r.sequence, r.n_tokens, bytes(r.tokens)) for r in df.collect())


def test_slots_do_not_depend_on_the_split(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[50]), (7, "another text of document seven"), (-(2**40), "far away")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = _slots(training_order.training_order(docs.coalesce(1), **OPTIONS))
    assert [r[0] for r in plain] == list(range(len(plain)))
    assert plain == _slots(training_order.training_order(docs.repartition(5, "text"), **OPTIONS))
    assert plain == _slots(training_order.training_order(docs.orderBy("text").repartition(3), **OPTIONS))
    # It is an order of its own, not that of the ids.
    ids = [r[3] for r in plain if r[3] is not None]
    assert sum(a <= b for a, b in zip(ids, ids[1:])) < 0.7 * len(ids)
    assert [r[3:5] for r in plain] != [r[3:5] for r in _slots(training_order.training_order(docs, key=1, **OPTIONS))]


@pytest.mark.parametrize("id_type", ["long", "string", "smallint"])
def test_shards_that_two_ranges_share_are_written_whole(spark, id_type, monkeypatch, tmp_path):
    """Ranges smaller than a shard, too; ids of any type, wide ones as well."""
    monkeypatch.setattr(training_order, "RANGE_SHARDS", 1)
    monkeypatch.setattr(training_order, "READ_SHARDS", 2)
    monkeypatch.setattr(training_order, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    numbers = {"long": lambda i: (-1) ** i * (2**62 + i), "string": str, "smallint": int}
    rows = [(numbers[id_type](i), t, i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, f"doc_id {id_type}, text string, slot int")
    ordered = training_order.training_order(docs, **OPTIONS)
    assert ordered.rdd.getNumPartitions() > 3
    expected = _slots(ordered)
    found = training_order.stored_order(docs, **OPTIONS).collect()
    assert [(r.slot, r.doc_id, r.sequence, r.tokens_sha256) for r in found] == [(r[0], r[3], r[4], hashlib.sha256(r[6]).hexdigest()) for r in expected]
    files = sorted((tmp_path / "training-shards").glob("*.bin"))
    assert [len(f.read_bytes()) for f in files] == [16 * 16] * (len(files) - 1) + [(len(expected) - 16 * (len(files) - 1)) * 16]
    with open(OPTIONS["vocabulary"], "rb") as file:
        ranks = {t: n for n, t in enumerate(byte_bpe.read_ranks(file.read()))}
    coder = tiktoken.Encoding("own", pat_str=OPTIONS["pattern"], mergeable_ranks=ranks, special_tokens={})
    pieces = {(r[3], r[4]): r[6] for r in expected}
    for i, t, _ in rows:
        ids = coder.encode_ordinary(t)
        for k in range(0, len(ids), 8):
            assert pieces.pop((i, k // 8)) == struct.pack("<8H", *(ids[k : k + 8] + [50_256] * 8)[:8])
    assert not pieces


def test_an_id_that_many_rows_share_is_spread(spark, monkeypatch):
    monkeypatch.setattr(training_order, "RANGE_SHARDS", 1)
    rows = [(5, "the very same words in each of them")] * 300 + [(None, "no id here")] * 300 + [(i, t) for i, t in enumerate(TEXTS)]
    ordered = training_order.training_order(spark.createDataFrame(rows, "doc_id long, text string"), **OPTIONS)
    sizes = [n for n in ordered.rdd.mapPartitions(lambda p: [sum(r.doc_id == 5 for r in p)]).collect()]
    found = _slots(ordered)
    assert [r[0] for r in found] == list(range(len(found))) and sum(sizes) > 300
    assert max(sizes) < sum(sizes) / 3


def test_tokens_move_once(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = training_order.training_order(docs, **OPTIONS)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in text


def test_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert training_order.training_order(docs, **OPTIONS).count() == 0
    assert training_order.stored_order(docs.where("false"), **OPTIONS).count() == 0


def test_long_runs_are_encoded_by_either_codec():
    encode = training_order.short_ids(OPTIONS["vocabulary"], OPTIONS["pattern"])
    other = byte_bpe.codec(OPTIONS["vocabulary"], OPTIONS["pattern"])
    for text in (" " * 2_000_000 + "end", "ab" * 50_000, "-" * 100_000 + "1", "\u4e2d" * 5000, "<|endoftext|> it's"):
        assert encode(text) == np.frombuffer(other.encode([text])[0], "<u4").astype("<u2").tobytes()
