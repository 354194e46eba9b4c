"""Tables that streams keep up to date: rows laid out by day and hash bucket, merged by key when read.

A micro-batch appends a part of its own below the folder of its writer, so repeating it replaces that part. A compaction folds parts into one part
of the next level and publishes a list of what is live in one small file; parts that it folded are no longer read from then on and are
deleted. Every level takes ``fan`` parts of the level below, so a row is rewritten as often as the table has levels. Readers name the buckets and the days
they need, and only the folders of these days are listed and only the files of these buckets are read.

How rows of one key merge is up to the table (latest row, sums); merging has to be associative and to keep the columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Iterable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.tables import upsert_latest

#: Parts that a level holds before they are folded.
FAN = 8
#: Hash buckets of a table.
BUCKETS = 32
_LISTS = "_live"


def latest(keys: Sequence[str], order_by: str) -> Callable[[DataFrame], DataFrame]:
    """Merge by keeping the last row per key."""
    return lambda rows: upsert_latest(rows, keys, order_by)


class Folder:
    """The few file operations a table needs, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path_of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._bytes_of = spark._jvm.org.apache.commons.io.IOUtils.toByteArray

    def names(self, below: str) -> list[str]:
        at = self._path_of(f"{self.path}/{below}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path_of(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        source = self.fs.open(self._path_of(f"{self.path}/{name}"))
        try:
            return bytes(self._bytes_of(source)).decode()
        finally:
            source.close()

    def create(self, name: str, content: str) -> bool:
        """Write a file that is not there yet, complete or not at all; False if somebody else has written it."""
        trial = self._path_of(f"{self.path}/{_LISTS}/.{uuid.uuid4().hex}")
        sink = self.fs.create(trial, False)
        sink.write(bytearray(content.encode()))
        sink.close()
        final = self._path_of(f"{self.path}/{name}")
        if self.fs.exists(final):
            done = False
        else:
            try:
                done = self.fs.rename(trial, final)
            except Py4JJavaError:
                done = False
        if not done:
            self.fs.delete(trial, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self._path_of(f"{self.path}/{name}"), True)


@dataclass(frozen=True)
class Part:
    """A folder of rows: a micro-batch of a writer at level 0, else the result of a compaction."""

    folder: str
    level: int = 0


def _batch_folder(writer: str, batch_id: int) -> str:
    return f"writer={writer}/batch={batch_id:010d}"


@dataclass(frozen=True)
class KeyedTable:
    """A table below ``path``. ``key`` decides the bucket, ``day`` (SQL of a day number) the folder; None keeps all days together."""

    path: str
    key: str
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS
    day: str | None = None

    def _placed(self, rows: DataFrame) -> DataFrame:
        day = f"cast({self.day} AS int)" if self.day else "0"
        return rows.selectExpr("*", f"{day} AS _day", f"cast(pmod(xxhash64({self.key}), {self.buckets}) AS int) AS _bucket")

    def bucket_numbers(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys in ``keys``, at most as many as the table has."""
        found = keys.selectExpr(f"cast(pmod(xxhash64({self.key}), {self.buckets}) AS int) AS b").distinct()
        return sorted(r["b"] for r in found.collect())

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = self._placed(rows)
        # One file per day and bucket.
        placed.repartition("_day", "_bucket").write.mode("overwrite").partitionBy("_day", "_bucket").parquet(f"{self.path}/{folder}")

    def append(self, rows: DataFrame, writer: str, batch_id: int) -> None:
        """Write a micro-batch, merged in itself; a repeated one replaces what the failed attempt left."""
        self._write(self.merge(rows), _batch_folder(writer, batch_id))

    def _list(self, spark: SparkSession) -> tuple[int, dict]:
        """(number, content) of the newest list: live folded parts, and the last folded batch of each writer."""
        folder = Folder(spark, self.path)
        numbers = [n for n in folder.names(_LISTS) if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            return 0, {"parts": [], "folded": {}}
        return int(numbers[-1].removesuffix(".json")), json.loads(folder.read(f"{_LISTS}/{numbers[-1]}"))

    def parts(self, spark: SparkSession) -> list[Part]:
        """What is live: folded parts, and micro-batches that were written completely and are not folded yet."""
        folder, (_, content) = Folder(spark, self.path), self._list(spark)
        live = [Part(f, level) for f, level in content["parts"]]
        for writer in folder.names(""):
            if not writer.startswith("writer="):
                continue
            last = content["folded"].get(writer.removeprefix("writer="), -1)
            for batch in folder.names(writer):
                at = f"{writer}/{batch}"
                if int(batch.removeprefix("batch=")) > last and folder.exists(f"{at}/_SUCCESS"):
                    live.append(Part(at))
        return live

    def rows(
        self, spark: SparkSession, parts: Iterable[Part], buckets: Collection[int] | None = None, days: Collection[int] | None = None
    ) -> DataFrame | None:
        """Stored rows of these parts, buckets and days as they are; None where nothing is stored."""
        folder, found = Folder(spark, self.path), []
        for part in parts:
            for name in folder.names(part.folder):
                if name.startswith("_day=") and (days is None or int(name.removeprefix("_day=")) in days):
                    found += [
                        f"{self.path}/{part.folder}/{name}/{b}" for b in folder.names(f"{part.folder}/{name}")
                        if buckets is None or int(b.removeprefix("_bucket=")) in buckets
                    ]
        return spark.read.parquet(*found) if found else None

    def read(
        self, spark: SparkSession, buckets: Collection[int] | None = None, days: Collection[int] | None = None, without: tuple[str, int] | None = None
    ) -> DataFrame | None:
        """One row per key, of some buckets and days; ``without`` (writer, batch) leaves out a micro-batch that may be a repeated one."""
        own = _batch_folder(*without) if without else None
        rows = self.rows(spark, [p for p in self.parts(spark) if p.folder != own], buckets, days)
        return self.merge(rows) if rows is not None else None

    def compact(self, spark: SparkSession, fan: int = FAN) -> list[Part]:
        """Fold levels that hold ``fan`` parts or more; returns the parts that were folded.

        The newest micro-batch of every writer stays as it is, because its stream may repeat it. Of two compactions at the same time
        one publishes its list, the other gives its result up.
        """
        folder = Folder(spark, self.path)
        number, content = self._list(spark)
        live = self.parts(spark)
        newest = {}
        for part in live:
            if part.level == 0:
                newest[part.folder.split("/")[0]] = part
        ready = [p for p in live if p.level or p not in newest.values()]
        taken: list[Part] = []
        for level in range(max((p.level for p in ready), default=-1) + 1):
            here = [p for p in ready if p.level == level]
            # A fold takes the levels below along, so that one pass writes a row once.
            if len(here) + (1 if taken else 0) >= fan:
                taken += here
            else:
                break
        if not taken:
            return []
        result = Part(f"folded/{uuid.uuid4().hex}", max(p.level for p in taken) + 1)
        self._write(self.merge(self.rows(spark, taken)), result.folder)
        folded = dict(content["folded"])
        for part in taken:
            if part.level == 0:
                writer, batch = part.folder.split("/")
                name = writer.removeprefix("writer=")
                folded[name] = max(folded.get(name, -1), int(batch.removeprefix("batch=")))
        kept = [[f, level] for f, level in content["parts"] if Part(f, level) not in taken]
        published = folder.create(
            f"{_LISTS}/{number + 1:010d}.json", json.dumps({"parts": [*kept, [result.folder, result.level]], "folded": folded})
        )
        if not published:
            folder.delete(result.folder)
            return []
        for part in taken:
            folder.delete(part.folder)
        # What an earlier compaction published but did not live to delete.
        for writer, last in folded.items():
            for batch in folder.names(f"writer={writer}"):
                if int(batch.removeprefix("batch=")) <= last:
                    folder.delete(f"writer={writer}/{batch}")
        return taken
