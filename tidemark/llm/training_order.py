"""Training order: a keyed permutation gives every sequence a slot, slots are laid out in fixed-stride shards.

Documents become token ids; each document is cut into sequences of ``length`` tokens, the last one padded. A sequence has a
number made of its document's id and its place there, so numbers have gaps but need no counting. A keyed Feistel network
permutes them, walking along its cycles until it is back in range: every number gets a place of its own. Partitions are ranges of
places; a range knows from the counts of those ahead which slots are its own, so slots have no gaps. A shard is ``stride`` slots;
one task writes it, every sequence at (slot - first slot of the shard) * bytes of a sequence, so a reader
finds any slot by arithmetic, reads sequentially and resumes anywhere. The tokens move once and are stored once, in the shards.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.byte_bpe import codec, portions, read_ranks
from tidemark.llm.common import mix, saved
from tidemark.session import new_folder

ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 .. size - 1."""

    size: int
    key: int

    @property
    def _half(self) -> np.uint64:
        return np.uint64(max(1, -(-max(1, self.size - 1).bit_length() // 2)))

    def _keys(self) -> np.ndarray:
        return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(self.key & (2**64 - 1)))

    def _network(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        half = self._half
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ key) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & mask)
        return (left << half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        out = np.array(x, np.uint64)
        keys, todo = self._keys(), np.arange(len(out))
        while len(todo):
            out[todo] = self._network(out[todo], keys, back)
            todo = todo[out[todo] >= np.uint64(self.size)]
        return out.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(slots, True)


#: Shards of a range, counted as if every byte of text were a token; ranges hold a quarter to a half of that in ordinary texts.
RANGE_SHARDS = 16
#: Shards that a task reads back.
READ_SHARDS = 8


class ShortIds:
    """Encodes to ids packed as little-endian unsigned 16-bit integers."""

    def __init__(self, vocabulary: str, pattern: str):
        self.files = vocabulary, pattern
        with open(vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary), "rb") as file:
            ranks = {token: rank for rank, token in enumerate(read_ranks(file.read()))}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        try:
            ids = self.coder.encode_to_numpy(text)
        except ValueError:
            # Runs of more than a million blanks exhaust the stack of its pattern matcher; the other codec gives the same ids.
            ids = np.frombuffer(codec(*self.files).encode([text])[0], "<u4")
        return ids.astype("<u2").tobytes()


@lru_cache(maxsize=1)
def short_ids(vocabulary: str, pattern: str) -> ShortIds:
    return ShortIds(vocabulary, pattern)


def _placer(vocabulary: str, pattern: str, length: int, order: Permutation, each: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = short_ids(vocabulary, pattern)
        for batch in batches:
            at = 0
            for texts in portions(batch.column("text").to_pylist()):
                ids = [encode(t) for t in texts]
                part, at = batch.slice(at, len(ids)), at + len(ids)
                count = np.array([-(-len(i) // (2 * length)) for i in ids], np.int64)
                sequence = _steps(count)
                place = order.slots(np.repeat(part.column("base").to_numpy(), count) * each + sequence)
                kept = part.select(["id", "text_hash"]).take(pa.array(np.repeat(np.arange(len(ids)), count)))
                cut = [t[k : k + 2 * length] for t in ids for k in range(0, len(t), 2 * length)]
                made = [sequence, place, (place // width).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *map(pa.array, made), pa.array(cut, pa.binary())], ["id", "text_hash", "sequence", "place", "range", "tokens"]
                )

    return run


def _steps(count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def training_order(
    docs: DataFrame, *, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    length: int = 512, stride: int = 8192, key: int = 20_24, pad: int = 50_256,
) -> DataFrame:
    """One row per sequence: slot, shard, shard_size, ``id_col``, sequence (its number in the document), n_tokens, tokens.

    tokens holds ``length`` little-endian unsigned 16-bit ids, ``pad`` after the last one. Slots run from 0 without gaps,
    a shard holds ``stride`` of them, the last one what is left (shard_size). Partitions are ranges of places, so rows come in the order
    of their slots. Slots follow from the ids, the texts and the key alone: how the input is split or ordered makes no difference.

    Null and empty texts have no sequence. Rows that repeat an id, or have none, are documents of their own; rows without an id
    take the number of a hash of their text. Rows of an id that more than ``stride`` rows share are spread by their position
    in the input, so only their slots depend on it. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)["id"]
    whole = id_type in ("tinyint", "smallint", "int", "bigint")
    low, high, total_bytes = docs.selectExpr(
        "cast(min(id) AS bigint)" if whole else "null", "cast(max(id) AS bigint)" if whole else "null", "coalesce(sum(octet_length(text)), 0)"
    ).first()
    # A text has less than 2 ** 31 bytes, so no document has more sequences.
    each = 2**31 // length + 1
    span = max(2**32, high - low + 1) if whole and low is not None else 2**32
    numbered = whole and low is not None and span * each <= 2**62
    if not numbered:
        span = 2**62 // each
    order = Permutation(span * each, key)
    ranges = max(1, -(-total_bytes // (length * stride * RANGE_SHARDS)))
    by_text = f"pmod(xxhash64(text), {span}L)"
    base = f"coalesce({f'cast(id AS bigint) - ({low}L)' if numbered else f'pmod(xxhash64(id), {span}L)'}, {by_text})"
    keyed = docs.where("octet_length(text) > 0")
    shared = saved(docs.groupBy("id").count().where(f"count > {stride}").selectExpr("id AS its_id"), "shared-ids")
    if shared.isEmpty():
        keyed = keyed.selectExpr("id", "text", "xxhash64(text) AS text_hash", f"{base} AS base")
    else:
        spread = f"pmod(xxhash64(text, row), {span}L)"
        keyed = keyed.withColumn("row", F.monotonically_increasing_id()).join(
            shared.selectExpr("its_id", "true AS hot"), F.expr("id <=> its_id"), "left"
        ).selectExpr("id", "text", "xxhash64(text) AS text_hash", f"IF(hot, {spread}, {base}) AS base")
    placed = keyed.mapInArrow(
        _placer(vocabulary, pattern, length, order, each, -(-order.size // ranges)),
        f"id {id_type}, text_hash long, sequence long, place long, range int, tokens binary",
    )
    # The bounds of the ranges are known, so no sample of the rows is needed.
    # Both branches see the same filter, and the checksum names every column, so that they read one exchange.
    ranged = placed.where("range IS NOT NULL").repartitionById(ranges, "range")
    counts = ranged.groupBy("range").agg(F.count("*").alias("here"), F.bit_xor(F.xxhash64(*ranged.columns)).alias("checksum"))
    # One row for each range.
    counts = counts.selectExpr(
        "range AS its_range", "sum(here) OVER (ORDER BY range) - here AS before", "sum(here) OVER () AS total", "checksum"
    )
    ordered = ranged.join(F.broadcast(counts), F.expr("range = its_range")).where("checksum IS NOT NULL")
    ordered = ordered.sortWithinPartitions("range", "place", "id", "text_hash", "sequence")
    # A partition is one range, so the number of a row in its partition follows the slots of the ranges ahead.
    slotted = ordered.selectExpr("*", f"before + (monotonically_increasing_id() & {2**33 - 1}L) AS slot").selectExpr(
        "slot",
        f"slot div {stride} AS shard",
        f"least({stride}L, total - slot div {stride} * {stride}) AS shard_size",
        "id", "sequence",
        "cast(octet_length(tokens) div 2 AS bigint) AS n_tokens",
        f"concat(tokens, substring(X'{struct.pack('<H', pad).hex() * length}', 1, {2 * length} - octet_length(tokens))) AS tokens",
    )
    return slotted.withColumnRenamed("id", id_col)


_INDEX = ".index"


def _path(folder: str, shard: int) -> str:
    return f"{folder.rstrip('/')}/shard-{shard:08d}.bin"


def _writer(folder: str, columns: list[str], schema: pa.Schema):
    """Writes the shards that are complete in its partition and hands on the rows of the others, one shard in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)

        def write(shard: int, rows: pa.Table) -> None:
            trial, path = f".{uuid.uuid4().hex}", _path(root, shard)
            with system.open_output_stream(path + trial) as out:
                for tokens in rows.column("tokens").chunks:
                    out.write(b"".join(tokens.to_pylist()))
            index = rows.select(columns)
            with system.open_output_stream(path + _INDEX + trial) as sink, pa.ipc.new_file(sink, index.schema) as file:
                file.write_table(index)
            system.move(path + _INDEX + trial, path + _INDEX)
            system.move(path + trial, path)

        def ended(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            if len(rows) == rows.column("shard_size")[0].as_py():
                write(shard, rows)
                yield pa.RecordBatch.from_pylist([{"shard": shard, "sequences": len(rows)}], schema)
            else:
                yield from rows.to_batches()

        shard, parts = None, []
        for batch in batches:
            if "sequences" not in batch.schema.names:
                batch = batch.append_column("sequences", pa.nulls(len(batch), pa.int64()))
            done = batch.column("sequences").is_valid()
            if pc.any(done).as_py():
                yield batch.filter(done).cast(schema)
                batch = batch.filter(pc.invert(done))
            batch = batch.cast(schema)
            numbers = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                if numbers[at] != shard:
                    if parts:
                        yield from ended(shard, parts)
                    shard, parts = int(numbers[at]), []
                parts.append(batch.slice(at, end - at))
        if parts:
            yield from ended(shard, parts)

    return run


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write the shards of ``training_order`` below ``folder`` (a URI that executors share); returns (shard, sequences).

    A task writes the shards that lie wholly in its range; the rows of a shard that two ranges share move to one task.
    Beside the tokens of a shard lies an index, an Arrow file with the other columns of its rows. Both are written under a name
    of their attempt and renamed when they are complete, the tokens last, so a repeated task replaces them by the same bytes
    and a reader never sees a part of a shard.
    """
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    columns = [c for c in ordered.columns if c not in ("shard_size", "tokens")]
    fields = ordered.withColumn("sequences", F.lit(None).cast("long")).schema
    for field in fields:
        field.nullable = True
    schema = to_arrow_schema(fields)
    handed = ordered.mapInArrow(_writer(folder, columns, schema), fields)
    gathered = handed.repartition("shard").sortWithinPartitions("shard", "slot").mapInArrow(_writer(folder, columns, schema), fields)
    return saved(gathered.select("shard", "sequences"), "shards")


def _reader(folder: str, columns: list[str], length: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, sequences in zip(batch.column("shard").to_pylist(), batch.column("sequences").to_pylist()):
                digests = [hashlib.sha256(s).hexdigest() for s in read_slots(folder, shard * stride, sequences, length=length, stride=stride)]
                with system.open_input_file(_path(root, shard) + _INDEX) as file:
                    index = pa.ipc.open_file(file).read_all()
                if not len(digests) == len(index) == sequences:
                    raise ValueError(f"shard {shard} holds {len(digests)} sequences, its index {len(index)}, {sequences} were written")
                found = index.select(columns).append_column("tokens_sha256", pa.array(digests, pa.string()))
                yield from found.combine_chunks().to_batches()

    return run


def stored_order(docs: DataFrame, *, id_col: str = "doc_id", length: int = 512, stride: int = 8192, **options) -> DataFrame:
    """``training_order`` through files: the shards are written below the shared folder and read back.

    One row per sequence in the order of the slots: slot, shard, ``id_col``, sequence, n_tokens, tokens_sha256 of the bytes read.
    """
    ordered = training_order(docs, id_col=id_col, length=length, stride=stride, **options)
    folder = new_folder(docs.sparkSession, "training-shards")
    written = write_shards(ordered, folder)
    tasks = max(1, -(-written.count() // READ_SHARDS))
    columns = [c for c in ordered.columns if c not in ("shard_size", "tokens")]
    types = dict(ordered.dtypes)
    dealt = written.repartitionById(tasks, F.expr(f"cast(shard div {READ_SHARDS} AS int)")).sortWithinPartitions("shard")
    return dealt.mapInArrow(
        _reader(folder, columns, length, stride), ", ".join([*(f"`{c}` {types[c]}" for c in columns), "tokens_sha256 string"])
    )


def read_slots(folder: str, first: int, count: int, *, length: int = 512, stride: int = 8192) -> Iterator[np.ndarray]:
    """The sequences of ``count`` slots from slot ``first`` on, one seek for each shard touched."""
    system, root = fs.FileSystem.from_uri(folder)
    end = first + count
    while first < end:
        shard = first // stride
        here = min(end, (shard + 1) * stride) - first
        with system.open_input_file(_path(root, shard)) as file:
            file.seek((first - shard * stride) * 2 * length)
            content = file.read(here * 2 * length)
        yield from np.frombuffer(content, "<u2").reshape(-1, length)
        if len(content) < here * 2 * length:
            return
        first += here
