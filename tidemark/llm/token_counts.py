"""Token counts of a sentencepiece BPE model, huge documents in overlapping chunks that are spliced where both agree.

A BPE encoding is right exactly when every two neighbouring tokens, encoded by themselves, stay those two tokens: merges go by
score and then from left to right, and up to the first merge across a border both sides develop as they do alone. So two
encodings of overlapping stretches may be spliced where they have a token in common: ahead of it stand tokens of the
left chunk, from it on tokens of the right one, and every pair of neighbours comes from one encoding. How far the
token is from the edges does not matter. Chunks are dealt over tasks by (document, chunk) and send back only where their tokens start
inside the overlaps. Documents in which some overlap holds no common token come again with wider overlaps and chunks, at last as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import portions
from tidemark.llm.common import saved

#: Characters of a chunk without its overlap, and of the overlap; both grow by ``WIDER`` where splicing fails.
CHUNK, OVERLAP, WIDER = 16_384, 128, 4

#: Fixed values of the public sentencepiece model format: the field of the normaliser in the model, that of the dummy prefix in it,
#: the number of the BPE model type and those of the piece types normal and byte.
_NORMALIZER, _DUMMY_PREFIX, _BPE, _NORMAL, _BYTE = 3, 3, 2, 1, 6


class Counter:
    """Counts tokens as the library does, and finds where the tokens of a stretch start.

    Only models that leave the text as it is can be cut: BPE, identity normalisation, blanks kept and written ahead of words, no pieces
    that are cut out ahead of the merges. Others raise an error.
    """

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as fields

        told = fields.ModelProto.FromString(content)
        rules = told.normalizer_spec
        kinds = {p.type for p in told.pieces}
        if (
            told.trainer_spec.model_type != _BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces
            or not rules.escape_whitespaces or told.trainer_spec.treat_whitespace_as_suffix or fields.ModelProto.SentencePiece.USER_DEFINED in kinds
        ):
            raise ValueError("texts can be cut for BPE models that keep the text as it is only")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=content)
        #: What the library puts ahead of a text that is not empty.
        self.ahead = " " if rules.add_dummy_prefix else ""
        # A message that comes again in a serialised model is merged into the first: the same model without the prefix.
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=content + bytes([_NORMALIZER << 3 | 2, 2, _DUMMY_PREFIX << 3, 0]))
        # A character without a piece becomes one token per byte; all of them start where the character does.
        byte = np.array([p.type == _BYTE for p in told.pieces])
        follows = np.array([p.type == _BYTE and 0x80 <= int(p.piece[1:-1], 16) < 0xC0 for p in told.pieces])
        self.length = np.where(byte, ~follows, [len(p.piece) if p.type == _NORMAL else 1 for p in told.pieces]).astype(np.int64)
        self.follows = follows.astype(np.int64)

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(ids) for part in portions(texts) for ids in self.whole.encode([t or "" for t in part], num_threads=1)]

    def starts(self, stretch: str) -> np.ndarray:
        """Where each token of ``stretch`` starts, in characters; no prefix is put ahead."""
        ids = np.array(self.inner.encode(stretch, num_threads=1), np.int64)
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids] - self.follows[ids]
        if len(ids) and ends[-1] != len(stretch):
            raise ValueError("the tokens of a stretch do not cover it")
        return starts


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """The counter of a worker; ``model`` is a file that every executor has, or was sent by ``addFile``."""
    with open(model if "/" in model else SparkFiles.get(model), "rb") as file:
        return Counter(file.read())


def common_token(left: np.ndarray, right: np.ndarray) -> int | None:
    """Where the first token starts that both have, by the starts of their tokens in the same stretch; None without one."""
    left, right = np.unique(left), np.unique(right)
    if len(left) < 2 or len(right) < 2:
        return None
    here = np.isin(left[:-1], right[:-1])
    at = left[:-1][here]
    same = at[left[1:][here] == right[np.searchsorted(right, at) + 1]]
    return int(same[0]) if len(same) else None


def _first(model: str, longest: int):
    """Bytes of every text, tokens of those of up to ``longest`` characters."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(model)
        for part in parts:
            texts = [t or "" for t in part]
            short = np.array([len(t) <= longest for t in texts], bool)
            tokens = pd.array([None] * len(texts), dtype="Int64")
            tokens[short] = count.counts([t for t, near in zip(texts, short) if near])
            yield pd.DataFrame({"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens})

    return run


def _cutter(model: str, chunk: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ahead = counter(model).ahead
        for batch in batches:
            for row, i, n_bytes, text in batch[["row", "id", "n_bytes", "text"]].itertuples(index=False):
                text = ahead + text
                # A remainder shorter than the overlap belongs to the last chunk.
                chunks = max(1, -(-(len(text) - overlap) // chunk))
                for k in range(chunks):
                    last = k == chunks - 1
                    piece = text[k * chunk :] if last else text[k * chunk : (k + 1) * chunk + overlap]
                    yield pd.DataFrame({"row": [row], "id": [i], "n_bytes": [n_bytes], "chunk": [k], "last": [last], "piece": [piece]})

    return run


def _summary(model: str, chunk: int, overlap: int):
    """Of each chunk: its tokens, those ahead of its overlap with the next, and where tokens start in both overlaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model)
        for batch in batches:
            found = [count.starts(p) for p in batch.pop("piece")]
            batch["n"] = [len(s) for s in found]
            batch["head"] = [s[s < overlap] for s in found]
            batch["tail"] = [s[:0] if last else s[s >= chunk] - chunk for s, last in zip(found, batch["last"])]
            yield batch

    return run


def _splice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks come by document and in order; the document's count is known at its last chunk, null if a splice failed."""
    row, at, total, tail, failed = None, 0, 0, None, False
    for batch in batches:
        out = []
        for its, i, n_bytes, chunk, last, n, head, end in batch[
            ["row", "id", "n_bytes", "chunk", "last", "n", "head", "tail"]
        ].itertuples(index=False):
            if its != row:
                row, at, total, tail, failed = its, -1, 0, None, False
            if chunk != at + 1:
                raise ValueError(f"chunk {at + 1} of a document is missing")
            at = chunk
            if tail is not None:
                here = common_token(tail, head)
                failed |= here is None
                if here is not None:
                    # Tokens of the left chunk up to the common token, of the right one from it on.
                    total += int(np.searchsorted(tail, here)) - len(tail) - int(np.searchsorted(head, here))
            total, tail = total + n, end
            if last:
                out.append((its, i, n_bytes, None if failed else total))
        yield pd.DataFrame(out, columns=["row", "id", "n_bytes", "n_tokens"]).astype({"n_tokens": "Int64"})


def count_tokens(
    docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes (UTF-8), n_tokens (without begin and end).

    ``model`` is a path that every executor can open, or the bare name of a file sent with ``SparkContext.addFile``. Documents of more than
    two chunks of characters are counted in chunks. Null and empty texts have no bytes and no tokens. Each row is counted by itself, so repeated
    rows and ids make no difference; other columns are not looked at. Long texts are written to the shared folder once, with
    a number of their row, so that a lost task finds them unchanged.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap holds 1 character at least and no more than a chunk")
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    first = F.pandas_udf(_first(model, 2 * chunk), "n_bytes long, n_tokens long")
    # Ids travel as text, so that pandas does not turn whole numbers beside a null into floating ones.
    id_type, key = dict(docs.dtypes)["id"], "row long, id string, n_bytes long"
    first = docs.select("row", F.expr("cast(id AS string) AS id"), "text", first("text").alias("found")).selectExpr(
        "row", "id", "found.n_bytes", "found.n_tokens", "if(found.n_tokens IS NULL, text, null) AS text"
    )
    first = saved(first, "token-counts")
    counted = first.where("n_tokens IS NOT NULL").select("id", "n_bytes", "n_tokens")
    pending = first.where("n_tokens IS NULL").select("row", "id", "n_bytes", "text")
    while not pending.isEmpty():
        pieces = pending.mapInPandas(_cutter(model, chunk, overlap), f"{key}, chunk int, last boolean, piece string")
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        told = pieces.repartition(partitions, "row", "chunk").mapInPandas(
            _summary(model, chunk, overlap), f"{key}, chunk int, last boolean, n long, head array<long>, tail array<long>"
        )
        spliced = told.repartition(partitions, "row").sortWithinPartitions("row", "chunk").mapInPandas(_splice, f"{key}, n_tokens long")
        spliced = saved(spliced, "spliced-counts")
        counted = counted.unionByName(spliced.where("n_tokens IS NOT NULL").select("id", "n_bytes", "n_tokens"))
        failed = spliced.where("n_tokens IS NULL").select("row")
        pending = pending.join(failed, "row", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    return counted.selectExpr(f"cast(id AS {id_type}) AS `{id_col}`", "n_bytes", "n_tokens")
