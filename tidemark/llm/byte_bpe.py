"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Every token of the rank file becomes a piece: its bytes mapped to characters one to one, its score the negative
rank, so that sentencepiece merges in the order of the ranks. Normalisation is the identity and nothing is added to
the text. Texts are cut into pre-tokens by the pattern of the rank file; each is encoded by itself. Pieces map
back to bytes by the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: White space as Unicode defines it; the class ``\s`` of Python also holds four separators of ASCII.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-tokens remembered by a worker, some 50 MB; the memory is emptied when it is full, and at the end of a task.
REMEMBERED = 250_000
#: Pre-tokens of more bytes are encoded each time.
_LONGEST = 64

# Bytes that are printable characters by themselves keep their code; the others take codes from 256 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CODE = {b: b for b in _PLAIN} | {b: 256 + n for n, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
_TO_CHARACTER = {b: chr(c) for b, c in _CODE.items()}
_TO_BYTE = {chr(c): b for b, c in _CODE.items()}


def mapped(token: bytes) -> str:
    return "".join(map(_TO_CHARACTER.__getitem__, token))


def unmapped(piece: str) -> bytes:
    return bytes(map(_TO_BYTE.__getitem__, piece))


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens by rank, of a file whose lines hold a token in base64 and its rank."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


#: Fixed values of the public sentencepiece model format: fields of ModelProto, SentencePiece, TrainerSpec and NormalizerSpec.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_MODEL_TYPE, _VOCAB_SIZE, _UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 3, 4, 40, 41, 42, 43
_NAME, _DUMMY_PREFIX, _EXTRA_BLANKS, _ESCAPE_BLANKS = 1, 3, 4, 5
_BPE, _UNKNOWN = 2, 2
_ABSENT = 2**64 - 1


def model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    out = []
    for rank, token in enumerate(tokens):
        score = _varint(_SCORE << 3 | 5) + np.float32(-rank).tobytes()
        out.append(_block(_PIECES, _block(_PIECE, mapped(token).encode()) + score))
    out.append(_block(_PIECES, _block(_PIECE, b"<unk>") + _number(_TYPE, _UNKNOWN)))
    trainer = _number(_MODEL_TYPE, _BPE) + _number(_VOCAB_SIZE, len(tokens) + 1) + _number(_UNK_ID, len(tokens))
    trainer += b"".join(_number(field, _ABSENT) for field in (_BOS_ID, _EOS_ID, _PAD_ID))
    normalizer = _block(_NAME, b"identity") + b"".join(_number(f, 0) for f in (_DUMMY_PREFIX, _EXTRA_BLANKS, _ESCAPE_BLANKS))
    return b"".join([*out, _block(_TRAINER, trainer), _block(_NORMALIZER, normalizer)])


class Codec:
    """Encodes to ids packed as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model(tokens))
        self.cut = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")).findall
        self.whole = {t: n for n, t in enumerate(tokens)}
        self.known: dict[str, bytes] = {}
        self.bytes_of = [unmapped(self.processor.id_to_piece(n)) for n in range(len(tokens))]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """A pre-token that is a token itself is that token; the rest goes through the merges."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        merged = self.processor.encode([mapped(b) for b in raw], num_threads=1)
        return [
            struct.pack("<I", self.whole[b]) if b in self.whole else struct.pack(f"<{len(ids)}I", *ids)
            for b, ids in zip(raw, merged)
        ]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. New pre-tokens of all of them go to the model in one call."""
        cut = [self.cut(t or "") for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list({p for pieces in cut for p in pieces})
        self.known.update(zip(new, self._ids(new)))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > _LONGEST:
                del self.known[p]
        return out

    def forget(self) -> None:
        self.known = {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """The codec of a worker; ``vocabulary`` is a file that every executor has, or was sent by ``addFile``."""
    with open(vocabulary if "/" in vocabulary else SparkFiles.get(vocabulary), "rb") as file:
        return Codec(read_ranks(file.read()), pattern)


def portions(texts: Iterable[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    """Consecutive texts in lists of about ``chars`` characters, so that their pre-tokens need little memory."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield part
            part, size = [], 0
    yield part


def _coder(vocabulary: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(vocabulary, pattern)
        for batch in batches:
            low = 0
            # A portion at a time leaves, so that a worker never holds the results of a whole batch.
            for part in portions(batch.pop("_text")):
                ids = coder.encode(part)
                yield batch.iloc[low : low + len(part)].assign(ids=ids, decoded=[coder.decode(i) for i in ids])
                low += len(part)
        # The worker may wait for other stages, which need the memory.
        coder.forget()

    return run


def encode_bytes(docs: DataFrame, *, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ids (little-endian unsigned 32-bit integers), decoded (bytes).

    ``vocabulary`` is a path that every executor can open, as an installed package has it, or the bare name of a file sent
    with ``SparkContext.addFile``. Null and empty texts have no ids. Each row is coded by itself, so repeated rows
    and ids make no difference; other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = dict(docs.dtypes)["_id"]
    coded = docs.mapInPandas(_coder(vocabulary, pattern), f"_id {id_type}, ids binary, decoded binary")
    return coded.withColumnRenamed("_id", id_col)
