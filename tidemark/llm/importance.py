"""Resampling towards a target distribution: importance weights of hashed features, and the highest scores of all documents.

Two passes over the texts: the first counts features per bucket, in the documents and in the target; from both counts comes one array
of gains. The second scores each document by that array and adds noise that depends on its id alone; taking the highest scores then draws
without replacement in proportion to the weights. Scores are stored. The cutoff is found on the stored numbers by bisection: each round is one job that
counts the rows above a few thresholds exactly, so nothing is sorted or gathered. Rows that tie with the cutoff are bisected by id, and equal ids
by a stored row number. Only the selected rows are range-partitioned and sorted for their ranks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, utf8

#: Words are runs of ASCII letters and digits and of whatever is not ASCII; on UTF-8 bytes this class says the same.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Thresholds of a counting job.
PROBES = 15
#: Words whose buckets a worker remembers.
REMEMBERED = 500_000


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case."""
    return _WORD.findall(utf8(text).lower())


def features(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    if longest == 1:
        return found
    return [b" ".join(found[k : k + n]) for n in range(1, longest + 1) for k in range(len(found) - n + 1)]


class _Buckets(dict):
    """Buckets by feature, remembered up to a limit."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = crc32(feature) % self.buckets
        return bucket


def _counter(buckets: int, longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket_of, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                counts = Counter(features(words(text), longest))
                np.add.at(total, [bucket_of[f] for f in counts], list(counts.values()))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    return run


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Features per bucket over all texts. Every task sends one row per bucket at most; as many reach the driver."""
    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(_counter(buckets, longest), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Logarithm of the ratio of both shares, smoothed by one per bucket, in thousandths, per bucket."""
    k = len(source)
    s_all, t_all = int(source.sum()), int(target.sum())
    return [
        floor(1000 * log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())
    ]


def noise(seed: int, i: str) -> str:
    """SQL of Gumbel noise in thousandths, from the seed and the id alone; a missing id counts as an empty one."""
    h = f"cast(conv(substr(sha2(concat('{seed}:', coalesce(cast({i} AS string), '')), 256), 1, 8), 16, 10) AS double)"
    return f"floor(-1000 * ln(-ln(({h} + 0.5D) / 4294967296D)))"


def _scorer(gain: list[int], longest: int):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bucket_of = _Buckets(len(gain))
        for part in texts:
            n_words, n_features, weight = [], [], []
            for text in part:
                found = words(text)
                counts = Counter(features(found, longest))
                n = sum(counts.values())
                total = sum([gain[bucket_of[f]] * c for f, c in counts.items()])
                n_words.append(len(found))
                n_features.append(n)
                weight.append(total // n if n else 0)
            yield pd.DataFrame({"n_words": n_words, "n_features": n_features, "weight": weight}, dtype="int64")

    return run


def _cutoff(rows: DataFrame, column: str, wanted: int) -> tuple[int, int]:
    """(c, above): ``above`` < wanted rows have ``column`` > c, with those at c they are ``wanted`` or more.

    ``column`` holds integers without nulls, of at least ``wanted`` > 0 rows. Every job counts the rows above ``PROBES`` thresholds
    that cut the range in equal parts, four halvings at a time.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    low, above = low - 1, 0  # more than enough rows are above low, too few above high
    while high - low > 1:
        probes = sorted({low + (high - low) * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {low, high})
        counts = rows.agg(*[F.count_if(F.col(column) > p).alias(f"c{k}") for k, p in enumerate(probes)]).first()
        for probe, count in zip(probes, counts):
            if count >= wanted:
                low = probe
            else:
                high, above = probe, count
                break
    return high, above


def highest(rows: DataFrame, wanted: int, columns: list[str]) -> F.Column | None:
    """A condition for exactly ``wanted`` rows, the highest by ``columns``, whose last tells all rows apart; None for no rows.

    ``rows`` is a stored table that holds ``wanted`` rows or more, ``columns`` are integers without nulls.
    """
    if wanted <= 0:
        return None
    chosen, tied = F.lit(False), F.lit(True)
    for column in columns:
        cut, above = _cutoff(rows.where(tied), column, wanted)
        chosen = chosen | (tied & (F.col(column) > cut))
        tied, wanted = tied & (F.col(column) == cut), wanted - above
        if rows.where(tied).count() == wanted:
            break
    return chosen | tied


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = 10, min_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_features, weight, score, rank (null for rows that were not drawn).

    Of the documents with ``min_words`` words or more, floor(percent * number / 100) are drawn: the highest scores, ties to smaller
    ids, missing ids last; rows that repeat score and id are drawn in the order in which they were stored. Ids are integers. Null and empty texts have
    no features and weight 0. An empty target or an empty table of documents is nothing special: all gains come from the smoothing. Repeated texts count as
    often as they come. Other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    score = F.pandas_udf(_scorer(gain, longest), "n_words long, n_features long, weight long")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scored = plain.select("id", score("text").alias("found")).selectExpr("id", "found.*").selectExpr("*", f"weight + {noise(seed, 'id')} AS score")
    # Higher is first: ids and row numbers count downwards, a missing id is below all others.
    order = {"score": "score", "down_id": "coalesce(-1 - id, -9223372036854775808)", "down_row": "-1 - monotonically_increasing_id()"}
    scored = saved(scored.selectExpr("*", *[f"{v} AS {k}" for k, v in list(order.items())[1:]]), "scores")
    eligible = scored.where(F.col("n_words") >= min_words)
    drawn = highest(eligible, eligible.count() * percent // 100, list(order))
    columns = ["id", "n_features", "weight", "score"]
    if drawn is None:
        ranked = scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    else:
        drawn = F.coalesce((F.col("n_words") >= min_words) & drawn, F.lit(False))
        ranked = _ranked(scored.where(drawn), list(order), columns).unionByName(scored.where(~drawn).select(*columns), allowMissingColumns=True)
    return ranked.withColumnRenamed("id", id_col)


def _ranked(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``columns`` and the rank by falling ``order``: ranges of the order, sorted each by itself, after the rows of the ranges ahead."""
    falling = [F.col(c).desc() for c in order]
    ranges = rows.repartitionByRange(*falling).sortWithinPartitions(*falling)
    # Bounds of ranges come from a sample, so the ranges are stored before they are counted and read again.
    stored = saved(ranges.select(*columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "drawn")
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).orderBy("part").collect()
    ahead = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    table = [(r["part"], before - r["first"] + 1) for r, before in zip(sizes, ahead)]  # one row per range
    offsets = rows.sparkSession.createDataFrame(table, "part int, add long")
    return stored.join(F.broadcast(offsets), "part").select(*columns, (F.col("place") + F.col("add")).alias("rank"))
