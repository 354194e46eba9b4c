"""Rows and state as binary pieces of Arrow columns.

A row that goes to the handler of keyed state by itself costs about twenty microseconds of Python before it is looked at, and a value of a state
about half a microsecond. So rows of a group travel in pieces of many, and arrays of a state in one binary value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a task that are dealt to pieces at once, and rows of a piece at most.
DEALT_ROWS, PIECE_ROWS = 100_000, 20_000

TEXT = pa.large_string()
_KINDS = {"string": TEXT, "bigint": pa.int64(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC"), "boolean": pa.bool_()}


def columns_of(text: str) -> pa.Schema:
    """Arrow columns of "name kind, name kind"; kinds may be arrays."""
    found = []
    for name, kind in (c.split() for c in text.split(", ")):
        inner = kind.removeprefix("array<").removesuffix(">")
        found.append((name, _KINDS[kind] if inner == kind else pa.list_(_KINDS[inner])))
    return pa.schema(found)


def packer(keys: Sequence[str], rows: pa.Schema):
    """A function for ``mapInArrow``: (keys, piece) for each run of rows with equal keys among those of a task that are dealt at once."""

    def deal(table: pa.Table) -> pa.RecordBatch:
        keyed = table.select(keys).combine_chunks()
        if any(len(pc.unique(column)) > 1 for column in keyed.columns):
            order = pc.sort_indices(keyed, [(k, "ascending") for k in keys])
            table, keyed = table.take(order), keyed.take(order)
        starts = {0, *range(0, len(table), PIECE_ROWS)}
        for column in keyed.columns:
            column = column.combine_chunks().dictionary_encode("encode").indices.to_numpy()
            starts.update((np.flatnonzero(np.diff(column)) + 1).tolist())
        starts = sorted(starts)
        data = table.select(rows.names).cast(rows).combine_chunks().to_batches()[0]
        pieces = [data.slice(low, high - low).serialize().to_pybytes() for low, high in zip(starts, [*starts[1:], len(table)])]
        first = keyed.take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in first.columns], pa.array(pieces, pa.binary())], [*keys, "piece"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                held += batch.num_rows
            if held >= DEALT_ROWS:
                yield deal(pa.Table.from_batches(waiting))
                waiting, held = [], 0
        if waiting:
            yield deal(pa.Table.from_batches(waiting))

    return pack


def unpacked(frame: pd.DataFrame, rows: pa.Schema) -> pa.Table:
    """The rows of the pieces in a frame, or of a frame of plain rows."""
    if "piece" not in frame.columns:
        return pa.Table.from_pandas(frame[rows.names], rows, preserve_index=False, safe=False)
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), rows) for p in frame["piece"]], rows)


def pieces_of(frame: pd.DataFrame, rows: pa.Schema) -> Iterator[bytes]:
    data = pa.RecordBatch.from_pandas(frame, rows, preserve_index=False)
    for low in range(0, len(frame), PIECE_ROWS):
        yield data.slice(low, PIECE_ROWS).serialize().to_pybytes()


def unpacker(rows: pa.Schema):
    """A function for ``mapInArrow``: the rows of pieces."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0):
                yield pa.ipc.read_record_batch(piece.as_buffer(), rows)

    return unpack


def to_bytes(value: Sequence, kinds: pa.Schema) -> bytes:
    """A state value, arrays of numbers or texts or single numbers, in one piece."""
    arrays = []
    for v, kind in zip(value, kinds.types):
        if pa.types.is_list(kind):
            flat = v if isinstance(v, pa.Array) else pa.array(v, kind.value_type)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        else:
            arrays.append(pa.array([v], kind))
    return pa.RecordBatch.from_arrays(arrays, schema=kinds).serialize().to_pybytes()


def from_bytes(data: bytes, kinds: pa.Schema) -> tuple:
    found = []
    for column in pa.ipc.read_record_batch(pa.py_buffer(data), kinds).columns:
        if pa.types.is_list(column.type):
            flat = column.flatten()
            found.append(flat if flat.type == TEXT else flat.to_numpy())
        else:
            found.append(column[0].as_py())
    return tuple(found)


def plain(values) -> list:
    """A column of a state value as a list."""
    return values.tolist() if isinstance(values, np.ndarray) else values.to_pylist() if isinstance(values, pa.Array) else list(values)


def texts(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, TEXT)


def coded(values, numbers: dict[str | None, int]) -> np.ndarray:
    """The numbers of texts in ``numbers``, where texts that are new get the next ones."""
    if not isinstance(values, pa.Array):
        return np.array([numbers.setdefault(v, len(numbers)) for v in values], np.int32)
    found = values.dictionary_encode("encode")
    here = np.array([numbers.setdefault(v, len(numbers)) for v in found.dictionary.to_pylist()], np.int32)
    return here[found.indices.to_numpy()]
