"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_folder

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments separates at the same six.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` below the shared folder and continue from the files.

    It cuts lineage as a reliable checkpoint does, and later reads take only the columns they need.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hash(h: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for every ``size`` consecutive values of ``h``; empty when ``h`` is shorter."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : n + j]
    return mix(out)


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Components of an undirected graph: (node, root), root being the smallest node of the component.

    ``edges`` holds two long columns ``a`` and ``b``. Every round links the neighbours of a node
    to the smallest of them, first the larger ones, then the smaller ones, until nothing changes; the
    number of rounds grows with the logarithm of the graph. Minima combine ahead of the shuffle, and the
    join with them lets adaptive execution split a node that has very many neighbours.
    """
    links = _checked(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    state = None
    for _ in range(rounds):
        links, found = links
        if found == state:
            break
        state = found
        both = links.unionByName(links.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b AS a", "m AS b", "a AS self")
        small = small.where("a <> b").select("a", "b").unionByName(small.selectExpr("self AS a", "b AS b")).distinct()
        links = _checked(small)
    else:
        raise RuntimeError("components did not settle")
    return links.selectExpr("a AS node", "b AS root").unionByName(
        links.selectExpr("b AS node", "b AS root").distinct()
    )


def _checked(links: DataFrame) -> tuple[DataFrame, tuple]:
    stored = saved(links, "links")
    return stored, tuple(stored.selectExpr("count(1)", "bit_xor(xxhash64(a, b))").first())
