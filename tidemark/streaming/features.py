"""Live features: one row per transaction from keyed state.

Events are taken in order of arrival. A late transaction is accepted and sees ``[t - W, t]`` of what
is still kept; transactions dated after it are not in its windows. Within a micro-batch arrival is
the order of event time and transaction id, so input in time order gives the batch result.

State of a customer is a set of small entries, of which a micro-batch reads and writes those it touches: the transactions of a day, or of an hour of a
busy day with their sums, the visits of a day, a group of markers of transaction ids. Days expire from the oldest one on, visits and markers by their horizon, so
the state is bounded by the windows, not by the length of the stream, and the work of a micro-batch grows with its rows.

Customers are dealt to groups, and a call of the stream's handler takes the rows of a group: what a call costs by itself, frames and their way
between Python and Spark, is paid per group. State stays that of single customers; a micro-batch reads and writes those it has rows of.
Rows come to the handler in pieces of many (``packs``), state goes as arrays, and features are computed on arrays where a customer has many rows of a day.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import timedelta
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.functions.scalars import DAY_MS, HOUR_MS, epoch_ms, is_cross_border, text_or_null, to_cents
from tidemark.operators.visits import check_window
from tidemark.schemas import CUSTOMER_FEATURES, DEFAULT_MODEL, HOME_COUNTRY, TRANSACTION, VISIT_WINDOW_DAYS
from tidemark.streaming.memory import WEEK_MS, Crowd, Standing, rolling_values
from tidemark.streaming.packs import TEXT, coded, columns_of, from_bytes, packer, pieces_of, plain, texts, to_bytes, unpacked, unpacker

# How long state outlives its last write.
STATS_TTL = timedelta(days=8)
VISIT_GRACE_DAYS = 2

#: Transactions of a day that stay in one entry, and ids of a group of markers, about.
DAY_ROWS, MARKERS = 1000, 256
#: Groups of markers from which on their size grows as well as their number.
MANY_GROUPS = 128
#: Characters of state that are held in one piece.
SMALL = 50_000
_MAPS = ("rows", "sums", "visits", "markers")
#: How far arrival times may lie apart within a micro-batch before rows are taken for older than the watermark.
ARRIVAL_DELAY = timedelta(minutes=10)

_CARRIED = "merchant_category string, amount double, country string, requested_model string"
_CARRIED_NAMES = [c.split()[0] for c in _CARRIED.split(", ")]
_OUT_TEXT = ", ".join(
    ["customer_id string, transaction_id string, merchant_id string, event_timestamp timestamp", _CARRIED]
    + [f"{name} {kind}" for name, kind in CUSTOMER_FEATURES.items()]
    + ["beyond_horizon boolean"]
)
_OUT = columns_of(_OUT_TEXT)
_SHOWN = ["customer_id", "transaction_id", "merchant_id", "event_timestamp", *_CARRIED_NAMES, *CUSTOMER_FEATURES, "beyond_horizon"]
_ROW = columns_of(
    f"customer_id string, transaction_id string, merchant_id string, {_CARRIED}, event_timestamp timestamp, "
    "ms bigint, cents bigint, abroad bigint, arrived_ms bigint"
)
_NO_TIME = np.iinfo(np.int64).min
_TEXTS = [c for c in _ROW.names if _ROW.field(c).type == TEXT and c != "transaction_id"]
#: Rows of a customer's micro-batch that are handed out at once.
ROWS_AT_ONCE = 100_000
#: Rows of a customer on a day of a micro-batch, on average, from which on visits are taken many at a time.
CROWD_ROWS = 50
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 16 << 20
#: Groups of customers. A group's rows of a micro-batch are held by one call.
GROUPS = 1024


def transaction_stream(spark: SparkSession, path: str, fmt: str = "json", schema: str = TRANSACTION, **options: str) -> DataFrame:
    """Transactions as they arrive; ``fmt`` may be any streaming source with the transaction columns."""
    stream = spark.readStream.schema(schema).options(**options).format(fmt).load(path)
    return stream.withColumnRenamed("timestamp", "event_timestamp")


def stream_dedupe(stream: DataFrame, keep: timedelta = STATS_TTL) -> DataFrame:
    """First arrival per transaction id, remembered for ``keep`` after it arrived.

    The memory runs by the time of arrival, so a transaction is never dropped for being late.
    """
    return (
        stream.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", f"{int(keep.total_seconds())} seconds")
        .dropDuplicatesWithinWatermark(["transaction_id"])
        .drop("_arrived")
    )


def stream_features(
    stream: DataFrame,
    home: str | Iterable[str] = HOME_COUNTRY,
    window_days: int = VISIT_WINDOW_DAYS,
    expire: bool = True,
    *,
    arrived: str = "current_timestamp()",
    late_rows: bool = False,
    groups: int = GROUPS,
) -> DataFrame:
    """Feature rows of a stream of valid transactions.

    A repeated transaction id gives no row for 8 days; after that, and until the markers of the visit window go, it counts in the rolling windows
    again but not as a visit. The clock of these horizons is the time of arrival, ``arrived`` (SQL), with ``expire``: then rolling
    windows of a customer go 8 days after their last transaction and the visits of a day ``window_days + 2`` days after their last
    one, also where nothing arrives any more, as soon as the stream's arrival time has passed. Without ``expire`` event time is the clock.

    With ``late_rows`` the column ``beyond_horizon`` follows: such a transaction belongs to a day older than all days that are kept, it changes nothing and its
    features are null; ``split_late`` takes both kinds apart. Without it, it gets the features of an empty memory.

    ``groups`` is fixed for the life of the state: a task takes whole groups, and one group's rows of a micro-batch have to fit its memory.
    """
    check_window(window_days)
    asked = "requested_model" if "requested_model" in stream.columns else "cast(null AS string)"
    model = f"coalesce(upper({text_or_null(asked)}), '{DEFAULT_MODEL}') AS requested_model"
    rows = stream.selectExpr(
        "customer_id", "transaction_id", "merchant_id", "merchant_category", "cast(amount AS double) AS amount", "country", model,
        "cast(event_timestamp AS timestamp) AS event_timestamp",
        f"{epoch_ms('event_timestamp')} AS ms",
        f"{to_cents('amount')} AS cents",
        f"cast({is_cross_border('country', home)} AS bigint) AS abroad",
        f"cast({arrived} AS timestamp) AS arrived",
    )
    rows = rows.withColumn("arrived_ms", F.expr("unix_millis(arrived)"))
    rows = rows.withColumn("customer_group", F.expr(f"cast(pmod(xxhash64(customer_id), {groups}) AS int)"))
    # Rows of a piece share their time of arrival, so the watermark takes or leaves them as it would each of them.
    keys = ["customer_group", "arrived"] if expire else ["customer_group"]
    pieces = rows.mapInArrow(packer(keys, _ROW), "customer_group int, arrived timestamp, piece binary" if expire else "customer_group int, piece binary")
    if expire:
        pieces = pieces.withWatermark("arrived", f"{int(ARRIVAL_DELAY.total_seconds())} seconds")
    # Keyed state with many entries per key needs the store that reads single entries.
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # A piece is one record to Spark, so frames are limited by bytes.
    most = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if most is None or not most.isdigit() or int(most) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    found = pieces.groupBy("customer_group").transformWithStateInPandas(
        _PieceMemory(window_days, expire, late_rows), "place bigint, piece binary", "Append", "EventTime" if expire else "None"
    )
    # Whoever reads or writes the rows of a large customer does it in many tasks.
    found = found.repartition("place").select("piece").mapInArrow(unpacker(_OUT), _OUT_TEXT)
    return found if late_rows else found.drop("beyond_horizon")


def split_late(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature rows, late transactions) of a batch of ``stream_features`` with ``late_rows``."""
    late = features.where("beyond_horizon").drop("beyond_horizon", *CUSTOMER_FEATURES)
    return features.where("NOT beyond_horizon").drop("beyond_horizon"), late


class _Entries(dict):
    """A map state of a customer with little state, held with the rest of it."""

    def exists(self) -> bool:
        return bool(self)

    def getValue(self, key: tuple) -> tuple | None:
        return self.get(tuple(key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self[tuple(key)] = value

    def removeKey(self, key: tuple) -> None:
        self.pop(tuple(key), None)

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter(list(self.items()))

    def keys(self) -> Iterator[tuple]:
        return iter(list(super().keys()))


class _CustomerMemory(StatefulProcessor):
    """The state of a customer, in entries of bounded size, or in one piece while there is little of it: ``SMALL`` characters of JSON at most.

    ``rows`` holds the transactions of the last 7 days by day, and by hour (with ``sums``) on days with more than ``DAY_ROWS``; ``visits`` the visits
    per merchant by day; ``markers`` the clock of every id, in groups of ids whose number doubles with them. A marker that is due goes when its
    group is next written, or with the timer.
    """

    def __init__(self, window_days: int, expire: bool, late_rows: bool):
        self.window_days, self.expire, self.late_rows = window_days, expire, late_rows
        self.rolling_ms = int(STATS_TTL.total_seconds() * 1000)
        self.visit_ms = (window_days + VISIT_GRACE_DAYS) * DAY_MS
        self.marker_ms = max(self.rolling_ms, self.visit_ms)

    def init(self, handle) -> None:
        self.handle = handle
        # Clock and newest transaction so far, last write, due time of the timer, marked ids and their groups.
        self.known = handle.getValueState("known", "clock bigint, newest bigint, written bigint, timer bigint, ids bigint, groups bigint, small string")
        entry = "day bigint, hour int"
        self.rows = handle.getMapState("rows", entry, "ms array<bigint>, cents array<bigint>, abroad array<bigint>, merchants array<string>")
        self.sums = handle.getMapState("sums", entry, "n bigint, cents bigint, abroad bigint, largest bigint")
        self.visits = handle.getMapState(
            "visits", "day bigint", "merchants array<string>, visits array<bigint>, first array<bigint>, last array<bigint>, written bigint"
        )
        self.markers = handle.getMapState("markers", "part bigint", "ids array<string>, clocks array<bigint>")
        self.maps = {name: getattr(self, name) for name in _MAPS}

    def _open(self, known: tuple | None) -> None:
        """Work on the entries held in one piece, or on the maps."""
        if known is not None and known[-1] is None:
            vars(self).update(self.maps)
        else:
            held = json.loads(known[-1]) if known is not None else {}
            for name in _MAPS:
                setattr(self, name, _Entries((tuple(k), tuple(v)) for k, v in held.get(name, [])))

    def _close(self, known: tuple) -> None:
        """Store what is known, and the entries held in one piece: as such, or in the maps from the moment they are too much."""
        small = None
        if isinstance(self.rows, _Entries):
            held = {
                name: [[list(k), [x if isinstance(x, int) else plain(x) for x in v]] for k, v in getattr(self, name).items()] for name in _MAPS
            }
            small = json.dumps(held, separators=(",", ":"))
            if len(small) > SMALL:
                small = None
                for name in _MAPS:
                    for k, v in getattr(self, name).items():
                        self.maps[name].updateValue(k, v)
        self.known.update((*known, small))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _, columns, ids in _arranged(rows):
            for piece in self.answers(columns, ids):
                yield _frame([piece])

    def answers(self, columns: dict[str, np.ndarray], ids: pa.Array) -> Iterator[tuple[dict, list | None]]:
        """Pieces of the output for the arranged rows of the customer: (columns of the rows, their features; None beyond the horizon)."""
        known = self.known.get()
        clock, newest, written, timer, marked, groups, _ = known or (-(2**62), -(2**62), -(2**62), -1, 0, 1, None)
        self._open(known)
        if len(ids) > ROWS_AT_ONCE:
            self._spread()
        ms = columns["ms"]
        # The newest transaction ahead of each; also the clock, where event time is the clock.
        ahead = np.maximum(newest, np.concatenate([[newest], ms[:-1]]))
        clocks = columns["arrived_ms"] if self.expire else np.maximum(np.maximum(ahead, ms), clock)
        now = max(clock, int(clocks.max()))
        if self.expire and written + self.rolling_ms <= now:
            self._forget_rolling()

        late = (ms // DAY_MS <= ahead // DAY_MS - self.window_days - VISIT_GRACE_DAYS) & self.late_rows
        if marked + len(ids) > 2 * MARKERS * groups and known is not None:
            groups = self._regroup(groups, marked + len(ids))
        elif known is None:
            groups = _groups(groups, len(ids))
        new, counted, marked = self._mark(ids, columns.get("hash"), clocks, known is None, marked, groups, now)
        del clocks, ahead
        at = np.flatnonzero(new & ~late)
        if len(at):
            newest, written = max(newest, int(ms[at[-1]])), now
            kept = at if len(at) < len(ids) else slice(None)  # all rows are not copied
            merchants = columns["merchant_id"][kept].own()
            rolling = self._rolling(ms[kept], columns["cents"][kept], columns["abroad"][kept], merchants, known is None)
            visits = self._visited(ms[kept], merchants, counted[kept], known is None, newest, now)
            for low in range(0, len(at), ROWS_AT_ONCE):
                part = at[low : low + ROWS_AT_ONCE]
                found = [c[low : low + ROWS_AT_ONCE] for c in rolling] + next(visits)
                yield _picked(columns, ids, part), found
            # The state of the visits is written behind the last one.
            next(visits, None)
        beyond = np.flatnonzero(new & late)
        for low in range(0, len(beyond), ROWS_AT_ONCE):
            yield _picked(columns, ids, beyond[low : low + ROWS_AT_ONCE]), None
        self._close((now, newest, written, self._remind(now, written, timer) if self.expire else timer, marked, groups))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.known.get()
        if known is not None:
            clock, newest, written, _, ids, groups, _ = known
            self._open(known)
            now = max(clock, timerValues.getCurrentWatermarkInMs())
            if written + self.rolling_ms <= now:
                self._forget_rolling()
            for (day,), value in list(self.visits.iterator()) if self.visits.exists() else []:
                if value[4] + self.visit_ms <= now:
                    self.visits.removeKey((day,))
            for part in range(groups) if self.markers.exists() else []:
                value = self.markers.getValue((part,))
                if value:
                    ids += self._write_markers(part, *value, now) - len(value[0])
            if self.rows.exists() or self.visits.exists() or self.markers.exists():
                self._close((clock, newest, written, self._remind(now, written, -1), ids, groups))
            else:
                self.known.clear()
        return iter(())

    def _mark(
        self, ids: pa.Array, hashes: np.ndarray | None, clocks: np.ndarray, fresh: bool, marked: int, groups: int, now: int
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """(not seen within the rolling horizon, not seen within that of the visits either, ids marked by now); marks the first.

        One group of markers is held at a time.
        """
        new, counted = np.ones(len(ids), bool), np.ones(len(ids), bool)
        if groups == 1:
            order, ends = None, [(0, 0, len(ids))]
        else:
            order, ends = _dealt(_hashes(ids) if hashes is None else hashes, groups)
            ids, clocks = ids.take(pa.array(order)), clocks[order]
        for part, low, high in ends:
            mine, at = ids[low:high], clocks[low:high]
            stored = None if fresh else self.markers.getValue((part,))
            if stored:
                before, (marked_ids, marked_at) = len(stored[0]), (texts(stored[0]), np.array(stored[1], np.int64))
                found = pc.fill_null(pc.index_in(mine, value_set=marked_ids), -1).to_numpy()
                again, found = found >= 0, found[found >= 0]
                age = at[again] - marked_at[found]
                places = np.arange(low, high)[again] if order is None else order[low:high][again]
                new[places], counted[places] = age >= self.rolling_ms, age >= self.visit_ms
                marked_at[found] = np.where(age >= self.rolling_ms, at[again], marked_at[found])
                mine = pa.concat_arrays([marked_ids, mine.filter(pa.array(~again))])
                at = np.concatenate([marked_at, at[~again]])
            else:
                before = 0
            # Later micro-batches are not behind this clock.
            marked += self._write_markers(part, mine, at, now) - before
        return new, counted, marked

    def _write_markers(self, part: int, ids, clocks, now: int) -> int:
        """Store the markers of a group that are not due; returns how many."""
        ids, clocks = texts(ids), np.asarray(clocks, np.int64)
        kept = clocks + self.marker_ms > now
        if not kept.all():
            ids, clocks = ids.filter(pa.array(kept)), clocks[kept]
        if len(ids):
            self.markers.updateValue((part,), (ids, clocks))
        else:
            self.markers.removeKey((part,))
        return len(ids)

    def _regroup(self, groups: int, ids: int) -> int:
        """Deal the markers to so many groups that each holds about as many of ``ids`` as it should, one group after the other; returns their number.

        As the number doubles, an id is dealt a few times in all, and a group is dealt to groups that no other is dealt to.
        """
        more = _groups(groups, ids)
        for part in range(groups) if more > groups else []:
            value = self.markers.getValue((part,))
            if not value:
                continue
            order, ends = _dealt(_hashes(texts(value[0])), more)
            held, clocks = texts(value[0]).take(pa.array(order)), np.asarray(value[1], np.int64)[order]
            if all(to != part for to, _, _ in ends):
                self.markers.removeKey((part,))
            for to, low, high in ends:
                self.markers.updateValue((to,), (held[low:high], clocks[low:high]))
        return more

    def _spread(self) -> None:
        """Move entries held in one piece to the maps, ahead of a micro-batch that is too much for one piece."""
        if isinstance(self.rows, _Entries):
            for name in _MAPS:
                for k, v in getattr(self, name).items():
                    self.maps[name].updateValue(k, v)
            vars(self).update(self.maps)

    def _forget_rolling(self) -> None:
        self.rows.clear()
        self.sums.clear()

    def _remind(self, now: int, written: int, timer: int) -> int:
        """Have the timer due when the next horizon ends of a customer who stays silent, on a full hour."""
        ends = written + self.rolling_ms if written + self.rolling_ms > now else now + self.marker_ms + DAY_MS
        due = (ends // HOUR_MS + 1) * HOUR_MS
        if due != timer:
            if timer > now:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return due

    def _rolling(self, ms: np.ndarray, cents: np.ndarray, abroad: np.ndarray, merchants: _Texts, fresh: bool) -> list[np.ndarray]:
        first, last = int(ms[0]), int(ms[-1])
        gone = last - WEEK_MS - 1  # what has left for good after this micro-batch
        entries = sorted(tuple(k) for k in self.rows.keys()) if not fresh and self.rows.exists() else []
        numbers = {m: k for k, m in enumerate(merchants.names)}
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        blocks = []
        for entry in entries:
            start, end = _span(entry)
            if end < first - WEEK_MS or start > last:
                continue
            if entry[1] >= 0 and end < first - DAY_MS and start >= last - WEEK_MS and start > gone:
                n, total, far, largest = self.sums.getValue(entry)
                blocks.append((end, total, far, n, largest))
            else:
                *values, names = self.rows.getValue(entry)
                held[entry] = (*[np.asarray(v, kind) for v, kind in zip(values, (np.int64, np.int64, np.int8))], coded(names, numbers))
        new = (ms, cents, abroad, merchants.codes)
        # Entries follow each other in time, and so do the rows of each.
        old = tuple(np.concatenate([np.zeros(0, new[k].dtype), *[h[k] for h in held.values()]]) for k in range(4))
        found = rolling_values(old, tuple(np.array([b[k] for b in blocks], np.int64) for k in range(5)), new)
        del old

        # The oldest entries leave first; only the entry that is cut and those with new rows are written.
        for entry in entries:
            if _span(entry)[1] <= gone:
                self._remove_rows(entry)
                held.pop(entry, None)
        split = {day for day, hour in entries if hour >= 0}
        # Rows of an entry follow each other.
        added: dict[tuple[int, int], tuple[int, int]] = {}
        low = int(np.searchsorted(ms, gone, "right"))
        while low < len(ms):
            day, hour = int(ms[low]) // DAY_MS, int(ms[low]) % DAY_MS // HOUR_MS
            entry = (day, hour if day in split else -1)
            high = int(np.searchsorted(ms, _span(entry)[1], "right"))
            added[entry] = low, high
            low = high
        names = _names(numbers)
        for entry in {*added, *[e for e in held if _span(e)[0] <= gone]}:
            low, high = added.get(entry, (0, 0))
            kept = [c[low:high] for c in new]
            if entry in held:
                left = held[entry][0] > gone
                kept = [np.concatenate([h[left], c]) for h, c in zip(held[entry], kept)]
                order = np.argsort(kept[0], kind="stable")
                kept = [c[order] for c in kept]
            self._write_rows(entry, *kept[:3], names[kept[3]])
        return found

    def _write_rows(self, entry: tuple[int, int], ms: np.ndarray, cents: np.ndarray, abroad: np.ndarray, merchants: np.ndarray) -> None:
        if not len(ms):
            self._remove_rows(entry)
        elif entry[1] < 0 and len(ms) > DAY_ROWS:
            self._remove_rows(entry)
            hours = ms % DAY_MS // HOUR_MS
            begin = [0, *(np.flatnonzero(np.diff(hours)) + 1).tolist(), len(ms)]
            for low, high in zip(begin, begin[1:]):
                self._write_rows((entry[0], int(hours[low])), *[c[low:high] for c in (ms, cents, abroad, merchants)])
        else:
            self.rows.updateValue(entry, (ms, cents, abroad, merchants))
            if entry[1] >= 0:
                self.sums.updateValue(entry, (len(ms), int(cents.sum()), int(abroad.sum()), int(cents.max())))

    def _remove_rows(self, entry: tuple[int, int]) -> None:
        self.rows.removeKey(entry)
        if entry[1] >= 0:
            self.sums.removeKey(entry)

    def _visited(self, moments: np.ndarray, merchants: _Texts, counted: np.ndarray, fresh: bool, newest: int, now: int) -> Iterator[list]:
        """The visit features of the rows that are handed out at once, in columns; the state is written when the last ones have been taken."""
        kept = {day: value for (day,), value in self.visits.iterator()} if not fresh and self.visits.exists() else {}
        oldest = newest // DAY_MS - self.window_days - VISIT_GRACE_DAYS
        if self.expire:
            for day in [d for d, value in kept.items() if value[4] + self.visit_ms <= now]:
                self.visits.removeKey((day,))
                del kept[day]
        days = moments // DAY_MS
        # A merchant without id has no place in the order of ids.
        many = len(days) >= CROWD_ROWS * (1 + np.count_nonzero(np.diff(days))) and not any(m is None for m in merchants.names)
        many = many and not any(texts(value[0]).null_count for value in kept.values())
        changed: dict[int, tuple] = {}
        yield from (self._crowded if many else self._single)(moments, days, merchants, counted, kept, changed)
        for day, value in changed.items():
            if self.expire or day > oldest:
                self.visits.updateValue((day,), (*value, now))
        if not self.expire:
            for day in kept:
                if day <= oldest:
                    self.visits.removeKey((day,))

    def _single(self, moments: np.ndarray, days: np.ndarray, merchants: _Texts, counted: np.ndarray, kept: dict, changed: dict) -> Iterator[list]:
        """Visits one after the other; leaves the buckets of days with visits in ``changed``."""
        kept = {day: [plain(v) for v in value[:4]] for day, value in kept.items()}
        standing = Standing({(d, m): v for d, value in kept.items() for m, *v in zip(*value)}, self.window_days)
        touched: dict[int, dict[str, list[int]]] = {}
        out = []
        for ms, day, merchant, counts in zip(moments.tolist(), days.tolist(), merchants.shown().tolist(), counted.tolist()):
            standing.move_to(day)
            out.append(standing.features(merchant, ms))
            if counts:
                touched.setdefault(day, {})[merchant] = standing.count(merchant, ms, day)
            if len(out) == ROWS_AT_ONCE:
                yield list(zip(*out))
                out = []
        if out:
            yield list(zip(*out))
        for day, here in touched.items():
            merged = {m: v for m, *v in zip(*kept[day])} if day in kept else {}
            merged.update(here)
            changed[day] = (list(merged), *[list(c) for c in zip(*merged.values())])

    def _crowded(self, moments: np.ndarray, days: np.ndarray, merchants: _Texts, counted: np.ndarray, kept: dict, changed: dict) -> Iterator[list]:
        """The same for many visits of a day at a time."""
        numbers = {m: k for k, m in enumerate(merchants.names)}
        buckets = {day: (coded(value[0], numbers), *[np.asarray(v, np.int64) for v in value[1:4]]) for day, value in kept.items()}
        names = sorted(numbers)
        place = np.empty(len(names), np.int64)
        place[[numbers[m] for m in names]] = np.arange(len(names))
        crowd = Crowd({day: (place[who], *rest) for day, (who, *rest) in buckets.items()}, len(names), self.window_days)
        # Without any visit there is no top merchant; its number is -1.
        shown, who = np.array([*names, ""], object), place[merchants.codes]
        for low in range(0, len(days), ROWS_AT_ONCE):
            high = min(low + ROWS_AT_ONCE, len(days))
            ends = [low, *(np.flatnonzero(np.diff(days[low:high])) + low + 1).tolist(), high]
            found = []
            for a, b in zip(ends, ends[1:]):
                crowd.move_to(int(days[a]))
                found.append(crowd.features(who[a:b], moments[a:b], counted[a:b]))
            *columns, top = [np.concatenate(c) for c in zip(*found)]
            yield [*columns, shown[top]]
        crowd.leave()
        for day in crowd.touched:
            at, *rest = crowd.buckets[day]
            changed[day] = shown[at], *rest


class _Texts:
    """Texts by number, each of them once."""

    def __init__(self, codes: np.ndarray, names: np.ndarray):
        self.codes, self.names = codes, names

    def __getitem__(self, at) -> _Texts:
        return _Texts(self.codes[at], self.names)

    def shown(self) -> np.ndarray:
        return self.names[self.codes]

    def own(self) -> _Texts:
        """With the names of others left out, where there are more names than texts."""
        if len(self.names) <= len(self.codes):
            return self
        used, codes = np.unique(self.codes, return_inverse=True)
        return _Texts(codes.astype(np.int32), self.names[used])


class _Known:
    """The value state of the customer at work, among those of a group."""

    def __init__(self, scope: _Scope, values):
        self.scope, self.values = scope, values

    def get(self) -> tuple | None:
        return self.values.getValue((self.scope.customer,))

    def update(self, value: tuple) -> None:
        self.values.updateValue((self.scope.customer,), value)

    def clear(self) -> None:
        self.values.removeKey((self.scope.customer,))


class _Part:
    """A map state of the customer at work, among those of a group; the keys it has are listed in an entry of their own.

    The list is read only where a customer has more state than fits one piece.
    """

    def __init__(self, scope: _Scope, name: str, width: int, kinds: pa.Schema, entries, lists):
        self.scope, self.name, self.width, self.kinds, self.entries, self.lists = scope, name, width, kinds, entries, lists
        self.listed: dict[tuple, None] | None = None
        self.changed = False

    def _keys(self) -> dict[tuple, None]:
        if self.listed is None:
            stored = self.lists.getValue((self.scope.customer, self.name))
            flat = stored[0] if stored else []
            self.listed = dict.fromkeys(zip(*[iter(flat)] * self.width))
        return self.listed

    def exists(self) -> bool:
        return bool(self._keys())

    def getValue(self, key: tuple) -> tuple | None:
        if tuple(key) not in self._keys():
            return None
        stored = self.entries.getValue((self.scope.customer, *key))
        return from_bytes(stored[0], self.kinds) if stored else None

    def updateValue(self, key: tuple, value: tuple) -> None:
        if tuple(key) not in self._keys():
            self.listed[tuple(key)] = None
            self.changed = True
        self.entries.updateValue((self.scope.customer, *key), (to_bytes(value, self.kinds),))

    def removeKey(self, key: tuple) -> None:
        if tuple(key) in self._keys():
            del self.listed[tuple(key)]
            self.changed = True
            self.entries.removeKey((self.scope.customer, *key))

    def clear(self) -> None:
        for key in list(self._keys()):
            self.removeKey(key)

    def keys(self) -> Iterator[tuple]:
        return iter(list(self._keys()))

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return ((key, self.getValue(key)) for key in self.keys())

    def leave(self) -> None:
        """Store the list of keys where it changed, ahead of the next customer."""
        if self.changed:
            at = (self.scope.customer, self.name)
            if self.listed:
                self.lists.updateValue(at, ([int(k) for key in self.listed for k in key],))
            else:
                self.lists.removeKey(at)
        self.listed, self.changed = None, False


class _Scope:
    """States and timers of one customer after the other, on those of their group."""

    def __init__(self, handle, timers: bool):
        self.handle, self.customer = handle, None
        self.parts: list[_Part] = []
        self.lists = handle.getMapState("lists", "customer string, name string", "entries array<bigint>")
        # Customers by the moment their timer is due; one whose timer has moved on stays listed.
        self.due = handle.getMapState("due", "due bigint", "customers array<string>") if timers else None
        self.asked: dict[int, list[str | None]] = {}

    def getValueState(self, name: str, schema: str) -> _Known:
        return _Known(self, self.handle.getMapState(name, "customer string", schema))

    def getMapState(self, name: str, key: str, value: str) -> _Part:
        entries = self.handle.getMapState(name, f"customer string, {key}", "packed binary")
        self.parts.append(_Part(self, name, len(key.split(",")), columns_of(value), entries, self.lists))
        return self.parts[-1]

    def registerTimer(self, at: int) -> None:
        self.asked.setdefault(at, []).append(self.customer)

    def deleteTimer(self, at: int) -> None:
        """Others may wait for the same moment, so the timer stays, and finds a customer's due time moved on."""

    def leave(self) -> None:
        for part in self.parts:
            part.leave()

    def set_timers(self) -> None:
        for at, customers in self.asked.items():
            waiting = self.due.getValue((at,))
            if not waiting:
                self.handle.registerTimer(at)
            self.due.updateValue((at,), (list(dict.fromkeys([*(waiting[0] if waiting else []), *customers])),))
        self.asked = {}


class _GroupMemory(StatefulProcessor):
    """The customers of a group, one after the other, each with the state of a ``_CustomerMemory``."""

    def __init__(self, window_days: int, expire: bool, late_rows: bool):
        self.expire, self.member = expire, _CustomerMemory(window_days, expire, late_rows)

    def init(self, handle) -> None:
        self.scope = _Scope(handle, self.expire)
        self.member.init(self.scope)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting: dict[bool, list] = {False: [], True: []}
        held = {False: 0, True: 0}
        for self.scope.customer, columns, ids in _arranged(rows):
            for piece in self.member.answers(columns, ids):
                beyond = piece[1] is None
                if held[beyond] and held[beyond] + len(piece[0]["transaction_id"]) > ROWS_AT_ONCE:
                    yield _frame(waiting[beyond])
                    waiting[beyond], held[beyond] = [], 0
                waiting[beyond].append(piece)
                held[beyond] += len(piece[0]["transaction_id"])
            self.scope.leave()
        for pieces in waiting.values():
            if pieces:
                yield _frame(pieces)
        self.scope.set_timers()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        waiting = self.scope.due.getValue((due,))
        for self.scope.customer in waiting[0] if waiting else []:
            known = self.member.known.get()
            if known is not None and known[3] == due:
                yield from self.member.handleExpiredTimer(key, timerValues, expiredTimerInfo)
            self.scope.leave()
        self.scope.due.removeKey((due,))
        self.scope.set_timers()


class _PieceMemory(_GroupMemory):
    """The same with the rows that go out in pieces, each with a number by which it is dealt to a task."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place = key[0] << 32
        for frame in super().handleInputRows(key, rows, timerValues):
            pieces = list(pieces_of(frame, _OUT))
            yield pd.DataFrame({"place": np.arange(place, place + len(pieces)), "piece": pieces})
            place += len(pieces)


def _holds(groups: int) -> int:
    """Ids that so many groups of markers are meant for; of very many ids both the groups and their sizes grow with the square root."""
    return MARKERS * groups * max(1, groups // MANY_GROUPS)


def _groups(groups: int, ids: int) -> int:
    """The number of groups of markers: doubled until so many ids fit."""
    if ids > 2 * _holds(groups):
        while ids > _holds(groups):
            groups *= 2
    return groups


def _hashes(ids: pa.Array) -> np.ndarray:
    found = np.empty(len(ids), np.uint32)
    for low in range(0, len(ids), ROWS_AT_ONCE):
        part = pc.fill_null(ids[low : low + ROWS_AT_ONCE], "").cast(pa.large_binary()).to_pylist()
        found[low : low + len(part)] = np.fromiter(map(crc32, part), np.uint32, len(part))
    return found


def _dealt(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(places of ids, those of a group of markers end to end; group, begin and end of each group there)."""
    found = hashes % np.uint32(groups)
    order = np.argsort(found, kind="stable")
    found = found[order]
    ends = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(found)]
    return order, [(int(found[low]), low, high) for low, high in zip(ends, ends[1:])]


def _repeated(ids: pa.Array, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of ids that came before for the same owner; only those with the hash of another one are compared."""
    order = np.argsort(hashes, kind="stable")
    same = np.diff(hashes[order]) == 0
    places = np.sort(order[np.append(same, False) | np.append(False, same)])
    del order, same
    found = pa.table({"owner": owner[places], "id": ids.take(pa.array(places)), "at": places})
    first = found.group_by(["owner", "id"]).aggregate([("at", "min")])["at_min"].to_numpy()
    return np.setdiff1d(places, first, assume_unique=True)


def _picked(columns: dict, ids: pa.Array, at: np.ndarray) -> dict:
    out = {c: columns[c][at].shown() for c in ("customer_id", "merchant_id")}
    out |= {c: columns[c][at].shown() if c in _TEXTS else columns[c][at] for c in ("event_timestamp", *_CARRIED_NAMES)}
    out["transaction_id"] = ids.take(pa.array(at)).to_pylist()
    return out


def _end_to_end(parts: list):
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else list(chain.from_iterable(parts))


def _frame(pieces: list[tuple[dict, list | None]]) -> pd.DataFrame:
    """Output rows of pieces that all have features, or are all beyond the horizon."""
    rows, found = [p for p, _ in pieces], [f for _, f in pieces]
    out = {c: _end_to_end([p[c] for p in rows]) for c in rows[0]}
    n, beyond = len(out["transaction_id"]), found[0] is None
    if beyond:
        kinds = {"string": "object", "double": "Float64"}
        out |= {c: pd.array([None] * n, dtype=kinds.get(kind, "Int64")) for c, kind in CUSTOMER_FEATURES.items()}
    else:
        out |= {c: _end_to_end([f[k] for f in found]) for k, c in enumerate(CUSTOMER_FEATURES)}
    out["event_timestamp"] = pd.DatetimeIndex(out["event_timestamp"].view("M8[us]")).tz_localize("UTC")
    out["beyond_horizon"] = np.full(n, beyond)
    return pd.DataFrame({c: out[c] for c in _SHOWN})


def _arranged(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, dict, pa.Array]]:
    """(customer, columns, transaction ids) of each customer, in order of event time and id, the first row of each id.

    Of texts that repeat one copy is held, and ids lie end to end, so a row takes about a hundred bytes.
    """
    numbers: dict[str, dict[str | None, int]] = {name: {} for name in _TEXTS}
    parts: dict[str, list[np.ndarray]] = {}
    found = []
    for frame in rows:
        here = unpacked(frame, _ROW)
        # Copies, so that the pieces can go.
        found.append(pa.concat_arrays([*here["transaction_id"].chunks, pa.array([], TEXT)]))
        for name in _ROW.names:
            column = here[name]
            if name in _TEXTS:
                values = np.concatenate([coded(c, numbers[name]) for c in column.chunks])
            elif name == "event_timestamp":
                values = column.cast(pa.int64()).fill_null(_NO_TIME).to_numpy()
            elif name == "amount":
                values = np.array(column.to_numpy(), np.float64)
            elif name == "abroad":
                values = column.fill_null(0).to_numpy().astype(np.int8)
            elif name != "transaction_id":
                if column.null_count:
                    raise ValueError(f"a transaction without {name}")
                values = np.array(column.to_numpy(), np.int64)
            if name != "transaction_id":
                parts.setdefault(name, []).append(values)
        del here
    ids = found[0] if len(found) == 1 else pa.concat_arrays(found)
    del found
    several = len(numbers["customer_id"]) > 1
    ms = np.concatenate(parts.pop("ms"))
    owner = np.concatenate(parts.pop("customer_id"))
    order = np.lexsort((ms, owner)) if several else np.argsort(ms, kind="stable")
    ms, owner = ms[order], owner[order]
    # Of rows at the same moment the id decides.
    tied = ms[1:] == ms[:-1]
    if several:
        tied &= owner[1:] == owner[:-1]
    if tied.any():
        at = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
        run = np.cumsum(~np.append(False, tied))[at]
        order[at] = order[at][pc.sort_indices(pa.table({"run": run, "id": ids.take(pa.array(order[at]))}), [("run", "ascending"), ("id", "ascending")])]
    ids = ids.take(pa.array(order))
    columns: dict = {}
    if len(ids) > ROWS_AT_ONCE:
        columns["hash"] = _hashes(ids)
        again = _repeated(ids, owner, columns["hash"])
    else:
        again, seen = [], set()
        for k, i in enumerate(zip(owner.tolist(), ids.to_pylist()) if several else ids.to_pylist()):
            if i in seen:
                again.append(k)
            seen.add(i)
        del seen
    if len(again):
        first = np.delete(np.arange(len(ids)), again)
        ids, order, ms, owner = ids.take(pa.array(first)), order[first], ms[first], owner[first]
        columns = {name: values[first] for name, values in columns.items()}
    columns["ms"] = ms
    for name in list(parts):
        values = np.concatenate(parts.pop(name))[order]
        columns[name] = _Texts(values, _names(numbers[name])) if name in _TEXTS else values
    customers = _names(numbers["customer_id"])
    ends = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
    for customer, low, high in zip(customers, ends, ends[1:]):
        mine = {name: values[low:high] for name, values in columns.items()}
        mine["customer_id"] = _Texts(np.zeros(high - low, np.int32), np.array([customer, None], object))
        yield customer, mine, ids[low:high]


def _names(numbers: dict[str | None, int]) -> np.ndarray:
    return np.array([*numbers, None], object)[:-1]


def _span(entry: tuple[int, int]) -> tuple[int, int]:
    """First and last millisecond of a day or of one hour of it."""
    day, hour = entry
    start = day * DAY_MS + max(hour, 0) * HOUR_MS
    return start, start + (DAY_MS if hour < 0 else HOUR_MS) - 1
