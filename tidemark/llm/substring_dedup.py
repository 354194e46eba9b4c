"""Removal of repeated word windows with a count-min prefilter.

Documents are dealt into chunks by a hash of the row. Every chunk counts its windows in a count-min sketch of
two rows. A window is counted under its *anchor*, the smallest hash of the short word runs inside it: occurrences of
a window at different places have anchors at different places, so the count of the anchor, and with it the sketch,
is never below the count of the window, while there are some fourteen times fewer anchors than windows.

The merged sketch grows with the corpus, so it is never gathered: it is cut into blocks of cells, each
merged by one task, and a block answers every chunk with those of the chunk's cells whose merged count is
two or more. The second pass hashes only windows for which both rows say "repeated", groups these exactly by a
128-bit digest of their words, again in blocks that answer the chunks, and removes the words they cover.
The estimate is never low, so no repeated window is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, utf8, windows_hash, word_hashes

#: Words of the short runs among which a window's anchor is chosen.
RUN = 8
DEPTH = 2
_ROW_SEED = mix(np.arange(11, 11 + DEPTH, dtype=np.uint64))
#: Cells of a sketch row for each anchor expected in it.
CELLS_EACH = 16
_WORD, _CELL = np.dtype("<u8"), np.dtype("<u4")


@dataclass(frozen=True)
class Layout:
    """How many chunks and blocks the corpus is cut into, from the characters counted in it.

    A chunk sends each block one message. Chunks and blocks grow with the root of the corpus, so that a
    message keeps some hundred cells and a task some hundred megabytes even at 100 TB.
    """

    chunks: int
    blocks: int

    @classmethod
    def of(cls, chars: int) -> Layout:
        chunk = max(2**20, int((200 * chars) ** 0.5))
        anchors = chars // 60 + 1
        return cls(chars // chunk + 16, anchors // max(2**17, 8 * anchors // (chars // chunk + 16)) + 8)


class Windows:
    """The windows of one chunk."""

    def __init__(self, texts: list[str | None], size: int):
        self.size = size
        self.words = [utf8(t).split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.flat = [w for words in self.words for w in words]
        run = min(RUN, size)
        runs = windows_hash(word_hashes(self.flat), run) | np.uint64(1)
        wide = size - run + 1
        least = _sliding(runs, wide, np.minimum)
        valid = np.zeros(len(least), bool)
        for start, n in zip(self.starts, self.counts):
            valid[start : max(start, start + n - size + 1)] = True
        #: Anchor of the window that starts at a word; 0 where no window starts.
        self.anchor = np.where(valid, least, np.uint64(0))
        padded = np.concatenate([np.zeros(wide - 1, np.uint64), self.anchor, np.zeros(wide - 1, np.uint64)])
        # A run is an anchor where some window that holds it has no smaller one. All equal ones count.
        self.anchors = runs[runs == _sliding(padded, wide, np.maximum)] if len(least) else runs[:0]

    def repeated(self, answers: list[np.ndarray], layout: Layout) -> np.ndarray:
        """Starts of the windows whose estimate is two or more, given the repeated cells of each sketch row."""
        names = np.unique(self.anchor[self.anchor > 0])
        for row, cells in enumerate(answers):
            names = names[np.isin(_place(names, row, layout), cells)]
        return np.flatnonzero(np.isin(self.anchor, names))

    def digests(self, at: np.ndarray) -> np.ndarray:
        ends = np.cumsum(np.fromiter(map(len, self.flat), np.int64, len(self.flat)) + 1)
        joined = memoryview(b" ".join(self.flat))
        low = (ends - np.fromiter(map(len, self.flat), np.int64, len(self.flat)) - 1)[at].tolist()
        high = (ends[at + self.size - 1] - 1).tolist()
        return _digests(b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(low, high)]))


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """Minimum or maximum of every ``size`` consecutive values, by doubling."""
    if len(x) < size:
        return x[:0]
    reach, out = 1, x
    while 2 * reach <= size:
        out = best(out[: len(out) - reach], out[reach:])
        reach *= 2
    rest = size - reach
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def _place(names: np.ndarray, row: int, layout: Layout) -> np.ndarray:
    """Block (upper half) and cell (lower half) of an anchor in a sketch row."""
    h = mix(names ^ _ROW_SEED[row])
    block = (h >> np.uint64(32)) % np.uint64(layout.blocks)
    return (block << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _digests(content: bytes) -> np.ndarray:
    """128-bit digests as rows of two numbers."""
    return np.frombuffer(content, _WORD).reshape(-1, 2)


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the class of each key, the first key of each class); classes are numbered in the order of the keys."""
    if keys.ndim == 1:
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        return of, first
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys met once, and those met more often: two is all that matters."""
    of, first = _classes(keys)
    n = np.bincount(of, minlength=len(first))
    return keys[first[n == 1]], keys[first[n > 1]]


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    of, first = _classes(np.concatenate([keys, some]))
    met = np.zeros(len(first), bool)
    met[of[len(keys) :]] = True
    return met[of[: len(keys)]]


def _messages(chunk: int, kind: int, layout: Layout, once: np.ndarray, more: np.ndarray, block_of) -> list[tuple]:
    cut = [np.searchsorted(block_of(keys), np.arange(layout.blocks + 1)) for keys in (once, more)]
    return [
        (kind, b, chunk, once[cut[0][b] : cut[0][b + 1]].tobytes(), more[cut[1][b] : cut[1][b + 1]].tobytes())
        for b in range(layout.blocks)
        if cut[0][b] < cut[0][b + 1] or cut[1][b] < cut[1][b + 1]
    ]


_SENT = "kind int, block int, chunk int, once binary, more binary"
_ANSWER = "chunk int, kind int, keys binary"
_EXACT = DEPTH


def _as_cells(sent: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(sent, columns=[f.split()[0] for f in _SENT.split(", ")])


def _cell_block(places: np.ndarray) -> np.ndarray:
    return (places >> np.uint64(32)).astype(np.int64)


def _sketcher(size: int, layout: Layout):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        windows, sent = Windows(list(group["text"]), size), []
        for row in range(DEPTH):
            places = _counted(_place(windows.anchors, row, layout))
            for kind, block, chunk, *keys in _messages(group["chunk"].iloc[0], row, layout, *places, _cell_block):
                sent.append((kind, block, chunk, *[_low(k) for k in keys]))
        return _as_cells(sent)

    return run


def _low(places: bytes) -> bytes:
    return np.frombuffer(places, np.uint64).astype(np.uint32).tobytes()


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """Sum a block over all chunks and answer each chunk with its keys that were met twice or more."""
    kind = group["kind"].iloc[0]
    read = _digests if kind == _EXACT else lambda content: np.frombuffer(content, _CELL)
    once, more = [read(b) for b in group["once"]], [read(b) for b in group["more"]]
    keys = np.concatenate([*once, *more])
    of, first = _classes(keys)
    met = np.ones(len(keys), np.int64)
    met[sum(map(len, once)) :] = 2
    repeated = (np.bincount(of, weights=met, minlength=len(first)) >= 2)[of]
    ends = np.cumsum([len(a) for a in (*once, *more)])
    parts = [k[r] for k, r in zip(np.split(keys, ends[:-1]), np.split(repeated, ends[:-1]))]
    answers = []
    for n, chunk in enumerate(group["chunk"]):
        content = parts[n].tobytes() + parts[n + len(once)].tobytes()
        if content:
            answers.append((chunk, kind, group["block"].iloc[0], content))
    return pd.DataFrame(
        [(c, k, _named(b, keys) if k != _EXACT else keys) for c, k, b, keys in answers], columns=["chunk", "kind", "keys"]
    )


def _named(block: int, cells: bytes) -> bytes:
    return ((np.uint64(block) << np.uint64(32)) | np.frombuffer(cells, np.uint32).astype(np.uint64)).tobytes()


def _keys(answers: pd.DataFrame, kind: int) -> np.ndarray:
    content = b"".join(answers.loc[answers["kind"] == kind, "keys"])
    return _digests(content) if kind == _EXACT else np.frombuffer(content, _WORD)


def _repeated(group: pd.DataFrame, answers: pd.DataFrame, size: int, layout: Layout) -> tuple[Windows, np.ndarray, np.ndarray]:
    windows = Windows(list(group["text"]), size)
    at = windows.repeated([_keys(answers, row) for row in range(DEPTH)], layout)
    return windows, at, windows.digests(at)


def _exact_sender(size: int, layout: Layout):
    def run(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(answers):
            return _as_cells([])
        found = _counted(_repeated(group, answers, size, layout)[2])

        def block_of(digests: np.ndarray) -> np.ndarray:
            return (((digests[:, 0] >> np.uint64(32)) * np.uint64(layout.blocks)) >> np.uint64(32)).astype(np.int64)

        return _as_cells(_messages(group["chunk"].iloc[0], _EXACT, layout, *found, block_of))

    return run


def _remover(size: int, layout: Layout):
    def run(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"id": [], "n_words": [], "n_removed": [], "kept": []})
        windows, at, digests = _repeated(group, answers, size, layout)
        at = at[_among(digests, _keys(answers, _EXACT))]
        edge = np.zeros(len(windows.flat) + size + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        covered = np.cumsum(edge)[: len(windows.flat)] > 0
        kept, removed = [], []
        for words, start, n in zip(windows.words, windows.starts, windows.counts):
            gone = covered[start : start + n]
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words))
        text = [k.decode("utf-8", "surrogatepass") for k in kept]
        return pd.DataFrame({"id": group["id"], "n_words": windows.counts, "n_removed": removed, "kept": text})

    return run


def remove_repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 35) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, n_removed, kept (the words left, joined by one space).

    A word is removed when a window of ``size`` consecutive words of its document covers it and the same word
    sequence starts anywhere else, in the same document too. All windows are judged on the input.

    Null, empty and blank texts and texts of fewer than ``size`` words lose nothing. Rows that repeat an id, or
    whole rows, are documents of their own, so a repeated long text loses all its words. Rows without an
    id keep their null id. Other columns of ``docs`` are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)["id"]
    layout = Layout.of(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    dealt = docs.withColumn("chunk", F.expr(f"cast(pmod(xxhash64(id, text), {layout.chunks}) AS int)"))
    chunked = dealt.groupBy("chunk")
    # The exchange by chunk is the same in all three passes, and Spark runs it once.
    cells = chunked.applyInPandas(_sketcher(size, layout), _SENT).groupBy("kind", "block").applyInPandas(_merged, _ANSWER)
    sent = chunked.cogroup(cells.groupBy("chunk")).applyInPandas(_exact_sender(size, layout), _SENT)
    exact = sent.groupBy("kind", "block").applyInPandas(_merged, _ANSWER)
    answers = cells.unionByName(exact).groupBy("chunk")
    return chunked.cogroup(answers).applyInPandas(
        _remover(size, layout), f"id {id_type}, n_words long, n_removed long, kept string"
    ).withColumnRenamed("id", id_col)
