"""Pseudo-likelihood scores from a bidirectional window network, trained in numpy inside Spark tasks.

Every token of a document is hidden in turn and predicted from the tokens left and right of it: position-wise embeddings
are added, passed through tanh, and a softmax over the vocabulary gives the conditional probability. A
document's score is the sum of the logarithms of these probabilities.

The vocabulary comes from the word counts of the whole corpus: the most frequent words are tokens, the others fall
into classes by their ending. A word of a class has the probability of the class, times the share that its own count has of the
counts of the class, so every word of the corpus has a probability of its own. No task holds all counts: chunks of scored documents ask for those of the words they
have, by a join. Every task trains on all of its documents, from
the same start; the parameters are averaged, weighted by tokens, in a tree of small groups. A parameter set has a
fixed size, so what reaches the driver does not grow; what is gathered from the tasks grows with the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, utf8

#: Tokens: the edge of a document, the most frequent words, and classes of the other words by a hash of their ending.
TOP_WORDS, ENDINGS = 95, 32
EDGE, VOCABULARY = 0, 1 + TOP_WORDS + ENDINGS
assert VOCABULARY <= 256, "a token is a byte"
#: Words seen on each side, and the width of the hidden layer.
SIDE, WIDTH = 2, 12
#: Tokens between two updates of the parameters, and tokens whose text is held at once.
BATCH, AT_ONCE = 2048, 400_000
#: Distinct words of a chunk, and its words and documents, about.
CHUNK_WORDS, CHUNK_SIZE = 300_000, 4_000_000
RATE = 0.08
#: Parameter sets averaged by one task.
FAN_IN = 64

_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
_SHAPES = ((len(_OFFSETS), VOCABULARY, WIDTH), (WIDTH, VOCABULARY), (VOCABULARY,))
_SIZE = sum(int(np.prod(s)) for s in _SHAPES)


def start() -> np.ndarray:
    """All parameters in one array; the same in every task."""
    return np.random.default_rng(3).normal(0, 0.05, _SIZE).astype(np.float32)


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in _SHAPES])
    return [part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), _SHAPES)]


class _Endings(dict):
    """Tokens of the classes by a word's last three bytes; 0 where these are not its last three characters."""

    def __missing__(self, last: bytes) -> int:
        if not last.isascii():
            return 0
        found = self[last] = 1 + TOP_WORDS + _ending(last)
        return found


@dataclass
class Words:
    """Token numbers of words."""

    top: dict[bytes, int]
    #: Logarithm of what a token's words count together and one more, which the words share that the corpus has not; by token, 0 where it is one word.
    shared: np.ndarray
    #: Counts of all words by hash; stays with the driver.
    counts: DataFrame | None = None
    endings: _Endings = field(default_factory=_Endings)

    def __getstate__(self) -> dict:
        return {"top": self.top, "shared": self.shared, "counts": None, "endings": _Endings()}

    def token(self, word: bytes) -> int:
        return self.top.get(word) or self.endings[word[-3:]] or 1 + TOP_WORDS + _ending(word)

    def tokens(self, text: str | None) -> np.ndarray:
        # Nothing is kept by word: few frequent words and endings stay in the processor's cache, all words would not.
        top, endings, words = self.top.get, self.endings, utf8(text).lower().split()
        found = bytes([top(w) or endings[w[-3:]] or self.token(w) for w in words])
        return np.frombuffer(found, np.uint8).astype(np.int64)


def _ending(word: bytes) -> int:
    return crc32(word.decode("utf-8", "surrogatepass")[-3:].encode("utf-8", "surrogatepass")) % ENDINGS


_ENDING = f"cast(crc32(cast(right(word, 3) AS binary)) % {ENDINGS} AS int)"


def stream(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents with edges between them as one row of tokens, and the places of the words in it."""
    edge = np.full(SIDE, EDGE)
    row = np.concatenate([edge, *[x for tokens in documents for x in (tokens, edge)]])
    counts = np.array([len(d) for d in documents], np.int64)
    starts = SIDE + np.cumsum(counts + SIDE) - counts - SIDE
    return row, np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _largest(logits: np.ndarray) -> np.ndarray:
    """The largest value of each row, as a column; halves of the columns compare faster than a row in itself."""
    while (n := logits.shape[1]) > 1 and n % 2 == 0:
        logits = np.maximum(logits[:, : n // 2], logits[:, n // 2 :])
    return logits.max(axis=1, keepdims=True) if logits.shape[1] > 1 else logits


def _exponents(params: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, hidden layer, probabilities of all tokens up to a factor) at the given places."""
    embeddings, weights, bias = _parts(params)
    # Each offset's tokens lie together.
    contexts = row[np.array(_OFFSETS)[:, None] + at].T
    total = embeddings[0].take(contexts[:, 0], axis=0)
    for k in range(1, len(_OFFSETS)):
        total += embeddings[k].take(contexts[:, k], axis=0)
    hidden = np.tanh(total)
    logits = hidden @ weights
    logits += bias
    logits -= _largest(logits)
    np.exp(logits, out=logits)
    return contexts, hidden, logits


def conditionals(params: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, hidden layer, probabilities of all tokens) at the given places."""
    contexts, hidden, found = _exponents(params, row, at)
    found /= found.sum(axis=1, keepdims=True)
    return contexts, hidden, found


def gradient(params: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gradient of the mean negative log-probability over the given places."""
    _, weights, _ = _parts(params)
    contexts, hidden, error = _exponents(params, row, at)
    error /= error.sum(axis=1, keepdims=True) * len(at)
    error[np.arange(len(at)), row[at]] -= 1 / len(at)
    inner = (error @ weights.T) * (1 - hidden * hidden)
    out = np.empty(_SIZE, np.float32)
    embeddings, by_weights, by_bias = _parts(out)
    cells, inner = np.arange(WIDTH), inner.ravel().astype(np.float64)
    for k in range(len(_OFFSETS)):
        into = (contexts[:, k, None] * WIDTH + cells).ravel()
        embeddings[k] = np.bincount(into, inner, VOCABULARY * WIDTH).reshape(VOCABULARY, WIDTH)
    by_weights[:] = hidden.T @ error
    by_bias[:] = error.sum(axis=0)
    return out


def train(params: np.ndarray, squares: np.ndarray, documents: list[np.ndarray]) -> int:
    """One pass over all words of the documents, in place (Adagrad); returns the number of words."""
    row, at = stream(documents)
    at = np.random.default_rng(len(at)).permutation(at)
    for k in range(0, len(at), BATCH):
        g = gradient(params, row, at[k : k + BATCH])
        squares += g * g
        params -= RATE * g / np.sqrt(squares + 1e-10)
    return len(at)


def log_probabilities(params: np.ndarray, shared: np.ndarray, documents: list[np.ndarray]) -> list[float]:
    """Summed conditional log-probabilities of each document; 0 without words."""
    row, at = stream(documents)
    found = np.zeros(len(at) + 1)
    for k in range(0, len(at), BATCH):
        part = at[k : k + BATCH]
        weighed = _exponents(params, row, part)[2]
        chosen = weighed[np.arange(len(part)), row[part]] / weighed.sum(axis=1)
        found[k + 1 : k + 1 + len(part)] = np.log(np.maximum(chosen, 1e-30)) - shared[row[part]]
    sums = np.cumsum(found)
    ends = np.cumsum([len(d) for d in documents])
    return (sums[ends] - sums[ends - [len(d) for d in documents]]).tolist()


def _gathered(texts, words: Words) -> Iterator[list[np.ndarray]]:
    """Token rows of consecutive texts, about AT_ONCE tokens at a time."""
    found, size = [], 0
    for text in texts:
        found.append(words.tokens(text))
        size += len(found[-1])
        if size >= AT_ONCE:
            yield found
            found, size = [], 0
    if found:
        yield found


def _trainer(words: Words, params: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.frombuffer(params, np.float32).copy()
        squares, n = np.zeros_like(mine), 0
        for batch in batches:
            for documents in _gathered(batch["text"], words):
                n += train(mine, squares, documents)
        if n:
            yield pd.DataFrame({"member": [TaskContext.get().partitionId()], "n": [n], "params": [mine.tobytes()]})

    return run


def _average(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("member")
    total = np.zeros(_SIZE)
    for n, params in zip(group["n"], group["params"]):
        total += n * np.frombuffer(params, np.float32).astype(np.float64)
    n = int(group["n"].sum())
    return pd.DataFrame({"member": [group["team"].iloc[0]], "n": [n], "params": [(total / n).astype(np.float32).tobytes()]})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words, handed on whenever there are ``CHUNK_WORDS`` of them."""
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update(utf8(text).lower().split())
            if len(counts) > CHUNK_WORDS:
                yield pd.DataFrame({"word": list(counts), "count": list(counts.values())})
                counts = Counter()
    if counts:
        yield pd.DataFrame({"word": list(counts), "count": list(counts.values())})


def fit(docs: DataFrame, *, text_col: str = "text", rounds: int = 1) -> tuple[Words, np.ndarray]:
    """(vocabulary, trained parameters), from all documents.

    Ties among frequent words go to the smaller word. A round starts at the average of the one before. Without
    any words the parameters are those of the start.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    partial = texts.mapInPandas(_counted, "word binary, count long").selectExpr("cast(word AS string) AS word", "count")
    counts = saved(partial.groupBy("word").agg(F.sum("count").alias("count")), "word-counts")
    rows = counts.orderBy(F.desc("count"), "word").limit(TOP_WORDS).collect()
    top = {r["word"].encode("utf-8", "surrogatepass"): k + 1 for k, r in enumerate(rows)}
    # One row for each class.
    others = counts.join(F.broadcast(counts.orderBy(F.desc("count"), "word").limit(TOP_WORDS).select("word")), "word", "left_anti")
    sizes = others.groupBy(F.expr(_ENDING).alias("ending")).agg(F.sum("count").alias("count")).collect()
    shared = np.zeros(VOCABULARY)
    for r in sizes:
        shared[1 + TOP_WORDS + r["ending"]] = np.log(r["count"] + 1)
    words, params = Words(top, shared), start()
    for _ in range(rounds):
        trained = saved(texts.mapInPandas(_trainer(words, params.tobytes()), "member long, n long, params binary"), "trained")
        members = trained.selectExpr("max(member)").first()[0]
        while members is not None:
            teams = trained.withColumn("team", F.expr(f"member div {FAN_IN}"))
            trained = teams.groupBy("team").applyInPandas(_average, "member long, n long, params binary")
            members //= FAN_IN
            if not members:
                params = np.frombuffer(trained.first()["params"], np.float32)
                break
    words.counts = counts.selectExpr("xxhash64(word) AS hash", "count").groupBy("hash").agg(F.sum("count").alias("count"))
    return words, params


class _Chunk(dict):
    """Numbers of the words of consecutive documents, from 0 in the order in which they are first asked for."""

    def __init__(self, number: int, words: Words):
        super().__init__()
        self.number, self.size, self.words = number, 0, words
        self.tokens: list[int] = []
        self.asked: list[int] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.tokens)
        self.tokens.append(self.words.token(word))
        # The hash of Spark's xxhash64.
        self.asked.append(xxhash.xxh64_intdigest(word, 42))
        return found

    def take(self, text: str | None) -> np.ndarray:
        """The numbers of the words of a text."""
        found = utf8(text).lower().split()
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def _scorer(words: Words, params: bytes):
    """Rows of documents, and one row of every chunk with the hashes of its words."""
    mine = np.frombuffer(params, np.float32)

    def scored(chunk: _Chunk, batch: pd.DataFrame, numbers: list[np.ndarray]) -> pd.DataFrame:
        tokens = np.array(chunk.tokens, np.int64)
        sums = log_probabilities(mine, words.shared, [tokens[n] for n in numbers])
        places = [n[tokens[n] > TOP_WORDS].tobytes() for n in numbers]
        return batch.assign(chunk=chunk.number, n_tokens=[len(n) for n in numbers], log_probability=sums, places=places, asked=None)

    def asking(chunk: _Chunk) -> pd.DataFrame:
        asked = np.array(chunk.asked, np.uint64).view(np.int64)
        return pd.DataFrame({"id": [None], "chunk": [chunk.number], "n_tokens": [0], "log_probability": [0.0], "places": [None], "asked": [asked]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        chunk = _Chunk(first, words)
        for batch in batches:
            texts, low, numbers, size = batch.pop("text"), 0, [], 0
            for k, text in enumerate(texts):
                numbers.append(chunk.take(text))
                size += len(numbers[-1])
                chunk.size += 1 + len(numbers[-1])
                full = len(chunk.tokens) > CHUNK_WORDS or chunk.size > CHUNK_SIZE
                if full or size >= AT_ONCE or k + 1 == len(texts):
                    yield scored(chunk, batch.iloc[low : k + 1], numbers)
                    low, numbers, size = k + 1, [], 0
                if full:
                    yield asking(chunk)
                    chunk = _Chunk(chunk.number + 1, words)
        if chunk.tokens:
            yield asking(chunk)

    return run


def _with_shares(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Add the logarithms of the counts of a chunk's words to the sums of its documents; a word the corpus has not counts one."""
    places = [np.frombuffer(p, np.int32) for p in docs.pop("places")]
    logs = np.zeros(max([0, *[int(p.max()) + 1 for p in places if len(p)], *(answers["at"] + 1).nlargest(1)]))
    logs[answers["at"].to_numpy()] = np.log(answers["count"].to_numpy())
    added = [logs[p].sum() for p in places]
    return docs.assign(log_probability=docs["log_probability"] + added)[["id", "n_tokens", "log_probability"]]


def score(
    docs: DataFrame, model: tuple[Words, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_tokens, log_probability (summed), mean_log_probability (null without words).

    Null, empty and blank texts have no tokens and the sum 0. Rows are scored one by one, so repeated rows
    and ids make no difference. Other columns are not looked at.
    """
    words, params = model
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(docs.dtypes)["id"]
    kinds = f"id {id_type}, chunk long, n_tokens long, log_probability double, places binary, asked array<bigint>"
    found = saved(docs.mapInPandas(_scorer(words, params.tobytes()), kinds), "scored")
    asked = found.where("asked IS NOT NULL").selectExpr("chunk AS asker", "posexplode(asked) AS (at, hash)")
    answers = asked.join(words.counts, "hash").select("asker", "at", "count")
    scored = (
        found.where("asked IS NULL").drop("asked").groupBy("chunk").cogroup(answers.groupBy("asker"))
        .applyInPandas(_with_shares, f"id {id_type}, n_tokens long, log_probability double")
    )
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "log_probability", F.expr("log_probability / nullif(n_tokens, 0) AS mean_log_probability")
    )
