"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact checks.

A document is its set of distinct five-word shingles. Equal sets are one node. Nodes that share a band
of their signatures are joined to the smallest node of that band (a star, never all pairs), and
the components of these stars are *families*: every banded candidate pair lies inside one family. A
family is cut into blocks of ``BLOCK`` nodes, and each pair of blocks is compared by one small
task: signatures in batches, pruning pairs whose posterior probability of reaching the threshold falls
below ``miss``, then the full sets of the survivors. A block pair returns a spanning forest of its links,
so the rows emitted grow with nodes and blocks, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected, mix, saved, utf8, windows_hash, word_hashes

#: Probability with which the bands may miss a pair at the threshold, and hash functions at most.
BAND_MISS, MOST_HASHES = 2.1e-6, 168
#: Hashes compared between two looks at the posterior.
BATCH = 24
#: Nodes in a block.
BLOCK = 1024
#: Parts, at least, of the rows that share a text with very many copies.
SALTS = 64
#: Shingles hashed at once, so that the hash matrix stays in the processor's cache.
_AT_ONCE = 512

_SEEDS = np.random.default_rng(7)
_MULTIPLY = (_SEEDS.integers(0, 2**32, MOST_HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _SEEDS.integers(0, 2**32, MOST_HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_FOLD = _SEEDS.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix(np.arange(1, MOST_HASHES + 1, dtype=np.uint64))


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows of a band): as many rows, up to 6, as ``MOST_HASHES`` allow for missing ``BAND_MISS`` of the pairs at the threshold."""
    for rows in range(len(_FOLD), 0, -1):
        apart = 1 - (percent / 100) ** rows
        bands = max(1, ceil(log(BAND_MISS) / log(apart))) if apart > 0 else 1
        if bands * rows <= MOST_HASHES:
            return bands, rows
    raise ValueError(f"{percent} percent need more than {MOST_HASHES} hash functions")


BANDS, ROWS = bands_for(85)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole sequence is one when it is shorter."""
    hashes = word_hashes(utf8(text).lower().split())
    if 0 < len(hashes) < words:
        return windows_hash(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(windows_hash(hashes, words))


def signature(found: np.ndarray, hashes: int = BANDS * ROWS) -> np.ndarray:
    """The minima of the first hash functions over a set that is not empty."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, 2**32 - 1, np.uint32)
    for k in range(0, len(low), _AT_ONCE):
        np.minimum(out, (_MULTIPLY[:hashes] * low[None, k : k + _AT_ONCE] + _ADD[:hashes]).min(axis=1), out=out)
    return out


def band_keys(minima: np.ndarray, rows: int = ROWS) -> np.ndarray:
    banded = minima.reshape(-1, rows).astype(np.uint64)
    return mix((banded * _FOLD[:rows]).sum(axis=1, dtype=np.uint64) ^ _BAND[: len(banded)]).view(np.int64)


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * ROWS) -> list[int]:
    """After each batch, the fewest equal minima with which a pair may still be worth checking.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m). Pairs for
    which this is below ``miss`` are pruned.
    """
    least = []
    for n in range(batch, total + 1, batch):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        least.append(m)
    return least


def _described(words: int, bands: int, per_band: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.pop("text")]
            batch["n_shingles"] = [len(s) for s in sets]
            batch["digest"] = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            batch["keys"] = [band_keys(signature(s, bands * per_band), per_band) if len(s) else None for s in sets]
            yield batch

    return run


def _with_sets(words: int, hashes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.pop("text")]
            batch["minima"] = [signature(s, hashes).tobytes() for s in sets]
            batch["members"] = [s.tobytes() for s in sets]
            yield batch

    return run


def _linker(percent: int, miss: float, hashes: int):
    least = least_matches(percent / 100, miss, total=hashes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        nodes, block = group["node"].to_numpy(), group["block"].to_numpy()
        minima = np.frombuffer(b"".join(group["minima"]), np.uint32).reshape(len(group), -1)
        sets = [np.frombuffer(b, np.uint64) for b in group["members"]]
        sizes = np.array([len(s) for s in sets])
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(codes, np.cumsum(sizes)[:-1])
        marked = np.zeros(len(names), bool)
        label = np.arange(len(group))
        across = group["i"].iloc[0] != group["j"].iloc[0]
        for y in range(len(group) - 1):
            # Already connected ones need no further look; pairs inside a block belong to the task (i, i).
            at = np.flatnonzero((label[y + 1 :] != label[y]) & ((block[y + 1 :] != block[y]) | (not across))) + y + 1
            # A set less than `percent` of the other's size can't reach the threshold.
            at = at[100 * np.minimum(sizes[at], sizes[y]) >= percent * np.maximum(sizes[at], sizes[y])]
            same = np.zeros(len(at), np.int64)
            for k, fewest in enumerate(least):
                if not len(at):
                    break
                part = slice(k * BATCH, (k + 1) * BATCH)
                same = same + (minima[at, part] == minima[y, part]).sum(axis=1)
                at, same = at[same >= fewest], same[same >= fewest]
            if not len(at):
                continue
            marked[codes[y]] = True
            ends = np.cumsum(sizes[at])
            shared = np.add.reduceat(marked[np.concatenate([codes[x] for x in at])].astype(np.int64), ends - sizes[at])
            marked[codes[y]] = False
            linked = at[100 * shared >= percent * (sizes[at] + sizes[y] - shared)]
            if len(linked):
                joined = np.unique(np.append(label[linked], label[y]))
                label[np.isin(label, joined)] = joined[0]
        apart = label != np.arange(len(group))
        return pd.DataFrame({"a": nodes[apart], "b": nodes[label[apart]]})

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, miss: float = 1e-7
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Two documents are linked when 100 * shared shingles >= ``percent`` * shingles of either; component_id
    is the smallest id of the documents reachable over links. The bands follow ``percent`` and miss at most one pair
    in 470 000 at that similarity; ``miss`` is the posterior probability below which a pair is pruned unseen.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that repeat an id are
    documents of their own. A row without an id takes the smallest id of its component; alone it
    has a null component_id and is kept. Other columns of ``docs`` are not looked at.
    """
    rooted = _rooted(docs, id_col, text_col, words, percent, miss)
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(named, "root").select(
        F.col("id").alias(id_col),
        "n_shingles",
        "component_id",
        F.expr("coalesce(id = component_id, component_id IS NULL) AS kept"),
    )


def survivors(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, miss: float = 1e-7
) -> DataFrame:
    """One row per group of linked documents, the one that stays: ``id_col`` and text_hash (xxhash64 of its text).

    It has the smallest id, rows without one last; among equal ids the smallest hash. Rows that share id and text are one document.
    """
    rooted = _rooted(docs, id_col, text_col, words, percent, miss)
    first = rooted.groupBy("root").agg(F.expr("min(struct(id IS NULL AS missing, id, text_hash)) AS first"))
    return first.select(F.col("first.id").alias(id_col), "first.text_hash").distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, miss: float) -> DataFrame:
    """Each row's id, text_hash and n_shingles, and the root of its component."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bands, per_band = bands_for(percent)
    id_type = dict(docs.dtypes)["id"]
    described = saved(
        docs.withColumns({"row": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text")}).mapInPandas(
            _described(words, bands, per_band), f"id {id_type}, row long, text_hash long, n_shingles long, digest binary, keys array<long>"
        ),
        "shingled",
    )
    first = described.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row").alias("first_row"), F.count("*").alias("copies"))
    first = saved(first.where("copies > 1").select(F.col("digest").alias("match"), "first_row", "copies"), "copied-texts")
    # Rows without words look for a key of their own, which is longer than any digest.
    own = "cast(format_string('row %020d', row) AS binary)"
    rows = described.withColumn("match", F.expr(f"coalesce(digest, {own})"))
    # A text with very many copies is looked up under several salts first, and no more under its digest.
    most = first.agg(F.max("copies")).first()[0] or 0
    salts = SALTS + most // 2**20
    if most > 16 * salts:
        many = first.where(f"copies > {16 * salts}").selectExpr(
            "match AS its_match", "first_row AS its_row", f"explode(sequence(0L, {salts - 1}L)) AS its_salt"
        )
        rows = rows.join(many, F.expr(f"match = its_match AND pmod(xxhash64(row), {salts}L) = its_salt"), "left")
        rows = rows.withColumn("match", F.expr(f"IF(its_row IS NULL, match, {own})")).drop("its_match", "its_salt")
    else:
        rows = rows.withColumn("its_row", F.lit(None).cast("long"))
    rows = rows.join(first.drop("copies"), "match", "left").withColumn("node", F.expr("coalesce(its_row, first_row, row)"))
    rows = saved(rows.select("id", "row", "text_hash", "n_shingles", "node", F.expr("IF(row = node, keys, null) AS keys")), "nodes")

    banded = rows.where("keys IS NOT NULL").select("node", F.explode("keys").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("star"), F.max("node").alias("last")).where("star < last")
    stars = banded.join(shared.select("band", "star"), "band").where("node <> star").selectExpr("node AS a", "star AS b")
    families = connected(stars)
    blocks = families.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    families = families.join(blocks, "root").selectExpr(
        "node", "root AS family", "blocks", "cast(pmod(xxhash64(node), blocks) AS int) AS block"
    )

    wanted = rows.where("row = node").select("id", "text_hash", "node").join(families, "node")
    wanted = wanted.withColumnRenamed("id", "its_id").withColumnRenamed("text_hash", "its_hash")
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(wanted, F.expr("id <=> its_id AND text_hash = its_hash"))
    with_sets = texts.select("node", "family", "blocks", "block", "text").mapInPandas(
        _with_sets(words, bands * per_band), "node long, family long, blocks int, block int, minima binary, members binary"
    )
    paired = with_sets.withColumn("other", F.expr("explode(sequence(0, blocks - 1))")).selectExpr(
        "family", "least(block, other) AS i", "greatest(block, other) AS j", "block", "node", "minima", "members"
    )
    links = paired.groupBy("family", "i", "j").applyInPandas(_linker(percent, miss, bands * per_band), "a long, b long")
    found = connected(links)

    return rows.join(found, "node", "left").selectExpr("id", "text_hash", "n_shingles", "coalesce(root, node) AS root")
