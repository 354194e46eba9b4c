"""What one customer's micro-batch needs: windows over sorted rows and the standing of merchants.

Inside a micro-batch time does not go back, so every window is a range of the merged rows whose ends only move forward: counts and
sums are differences of running sums, the maximum comes from a table of doubling ranges, and merchants are counted as they enter and
leave. The standing keeps merchants in order of (visits, id) while single visits are added and whole days leave.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np

from tidemark.functions.scalars import DAY_MS, HOUR_MS

WEEK_MS = 7 * DAY_MS


def half_up(numerator: int, denominator: int, digits: int) -> float:
    scale = 10**digits
    return ((2 * scale * numerator + denominator) // (2 * denominator)) / scale


def _range_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Maxima of ``values[low:high]``; no range is empty."""
    width = high - low
    level = np.frexp(width.astype(np.float64))[1] - 1
    out, table = np.empty(len(low), np.int64), values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.maximum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(table[low[at]], table[high[at] - (1 << k)])
    return out


def _distinct(codes: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Distinct codes of ``codes[low:end]`` for ranges whose ends only move forward.

    An entry stands for its code while it is in the range and the next entry with its code is not, so it is counted from the first range that
    it is in to the last ahead of both.
    """
    number = np.int32 if len(codes) < 2**31 - 1 else np.int64
    order = np.argsort(codes, kind="stable").astype(number)
    following = np.full(len(codes), len(codes), number)
    same = codes[order[1:]] == codes[order[:-1]]
    following[order[:-1][same]] = order[1:][same]
    del order, same
    # The first range whose end is behind a place, or whose beginning is.
    enters, leaves = (
        np.cumsum(np.bincount(edge, minlength=len(codes) + 1), dtype=number) for edge in (end, low)
    )
    leaves = np.minimum(leaves[:-1], enters[following])
    enters = enters[:-1]
    counted = leaves > enters
    steps = np.bincount(enters[counted], minlength=len(low) + 1) - np.bincount(leaves[counted], minlength=len(low) + 1)
    return np.cumsum(steps[: len(low)])


def rolling_values(
    old: tuple[np.ndarray, ...], blocks: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...]
) -> list[np.ndarray]:
    """The seven rolling features of all new rows.

    ``old`` and ``new`` are (ms, cents, abroad, numbers of merchants) in order of time, ``blocks`` are whole stretches of older rows as (ms, cents,
    abroad, rows, largest): rows that all new rows see in their week and none in its day. A row sees old rows up to its own millisecond
    and the new rows ahead of it.
    """
    ahead = len(blocks[0]) + len(old[0])
    ms = np.concatenate([blocks[0], old[0], new[0]])
    order = np.argsort(ms, kind="stable")
    ms = ms[order]
    end = np.flatnonzero(order >= ahead) + 1
    hour, day, week = (np.searchsorted(ms, new[0] - width, "left") for width in (HOUR_MS, DAY_MS, WEEK_MS))
    del ms

    def sums(*parts: np.ndarray) -> np.ndarray:
        found = np.zeros(len(order) + 1, np.int64)
        np.cumsum(np.concatenate(parts)[order], out=found[1:])
        return found

    if len(blocks[0]):
        n = sums(blocks[3], np.ones(len(order) - len(blocks[0]), np.int64))
        n1, n24, n7 = n[end] - n[hour], n[end] - n[day], n[end] - n[week]
        del n
    else:
        n1, n24, n7 = end - hour, end - day, end - week
    del hour
    total = sums(blocks[1], old[1], new[1])
    sum24, sum7 = total[end] - total[day], total[end] - total[week]
    total = sums(blocks[2], old[2], new[2])
    far7 = total[end] - total[week]
    del total
    mean = ((2 * sum7 + n7) // (2 * n7)) / 100.0
    del sum7
    top7 = _range_max(np.concatenate([blocks[4], old[1], new[1]])[order], week, end) / 100.0
    del week
    # Blocks have left the day ahead of all new rows.
    distinct = _distinct(np.concatenate([np.full(len(blocks[0]), -1, np.int32), old[3], new[3]])[order], day, end)
    return [n1, n24, sum24 / 100.0, mean, top7, distinct, far7]


class _Ordered:
    """A sorted list in parts, so that inserting and removing move few entries."""

    PART = 1024

    def __init__(self, values: list[str]):
        self.parts = [values[k : k + self.PART] for k in range(0, len(values), self.PART)]
        self.size = len(values)

    def _part(self, value: str) -> int:
        return min(bisect_left([p[-1] for p in self.parts], value), len(self.parts) - 1)

    def add(self, value: str) -> None:
        self.size += 1
        if not self.parts:
            self.parts.append([value])
            return
        k = self._part(value)
        insort(self.parts[k], value)
        if len(self.parts[k]) > 2 * self.PART:
            self.parts[k : k + 1] = [self.parts[k][: self.PART], self.parts[k][self.PART :]]

    def remove(self, value: str) -> None:
        self.size -= 1
        k = self._part(value)
        del self.parts[k][bisect_left(self.parts[k], value)]
        if not self.parts[k]:
            del self.parts[k]

    def ahead_of(self, value: str) -> int:
        k = self._part(value)
        return sum(map(len, self.parts[:k])) + bisect_left(self.parts[k], value)

    def first(self) -> str:
        return self.parts[0][0]


class Standing:
    """Merchants of the window in order of visits, then id; ``buckets`` holds (visits, first, last) by (day, merchant).

    Days enter and leave as ``move_to`` goes forward; each bucket does both once. A visit moves one merchant up by one place in the number of visits,
    so the merchants with so many visits or more are counted by one step per visit.
    """

    def __init__(self, buckets: dict[tuple[int, str], tuple[int, int, int]], window_days: int):
        self.window_days = window_days
        self.waiting: dict[int, list[tuple[str, int, int, int]]] = {}
        for (day, merchant), (visits, first, last) in buckets.items():
            self.waiting.setdefault(day, []).append((merchant, visits, first, last))
        self.days = deque(sorted(self.waiting))
        self.inside: deque[tuple[int, dict[str, list[int]]]] = deque()
        self.spans: dict[str, deque[list[int]]] = {}
        self.visits: dict[str, int] = {}
        self.levels: dict[int, _Ordered] = {}
        self.reached: dict[int, int] = {}
        self.total = self.highest = 0

    def _change(self, merchant: str, by: int) -> None:
        old = self.visits.get(merchant, 0)
        new = old + by
        if old:
            self.levels[old].remove(merchant)
            if not self.levels[old].size:
                del self.levels[old]
        if new:
            self.visits[merchant] = new
            if new in self.levels:
                self.levels[new].add(merchant)
            else:
                self.levels[new] = _Ordered([merchant])
        else:
            del self.visits[merchant]
        for level in range(old + 1, new + 1):
            self.reached[level] = self.reached.get(level, 0) + 1
        for level in range(new + 1, old + 1):
            self.reached[level] -= 1
        self.total += by
        self.highest = max(self.highest, new)
        while self.highest and self.highest not in self.levels:
            self.highest -= 1

    def move_to(self, day: int) -> None:
        """Take in the days up to ``day`` and let go of those out of the window."""
        while self.days and self.days[0] <= day:
            entering = self.days.popleft()
            here = {}
            for merchant, visits, first, last in self.waiting.pop(entering):
                if entering > day - self.window_days:
                    here[merchant] = [visits, first, last]
                    self._change(merchant, visits)
                    self.spans.setdefault(merchant, deque()).append(here[merchant])
            self.inside.append((entering, here))
        while self.inside and self.inside[0][0] <= day - self.window_days:
            for merchant, bucket in self.inside.popleft()[1].items():
                self._change(merchant, -bucket[0])
                self.spans[merchant].popleft()
                if not self.spans[merchant]:
                    del self.spans[merchant]

    def features(self, merchant: str, now: int) -> list:
        """The nine visit features of a transaction ahead of counting it."""
        if not self.total:
            return [0, 0.0, 0, 0, -1.0, -1.0, 0, 1, ""]
        top, mine = self.levels[self.highest].first(), self.visits.get(merchant, 0)
        if not mine:
            return [0, 0.0, 0, 0, -1.0, -1.0, len(self.visits), 1, top]
        rank = 1 + self.reached.get(mine + 1, 0) + self.levels[mine].ahead_of(merchant)
        spans = self.spans[merchant]
        since = [half_up(max(0, now - moment), DAY_MS, 6) for moment in (spans[0][1], spans[-1][2])]
        return [mine, half_up(mine, self.total, 6), rank, int(rank == 1), *since, len(self.visits), 0, top]

    def count(self, merchant: str, now: int, day: int) -> list[int]:
        """Add a visit on ``day``, the day of the last move; returns the bucket of the day."""
        if not self.inside or self.inside[-1][0] != day:
            self.inside.append((day, {}))
        here = self.inside[-1][1]
        bucket = here.get(merchant)
        if bucket is None:
            bucket = here[merchant] = [0, now, now]
            self.spans.setdefault(merchant, deque()).append(bucket)
        bucket[0] += 1
        bucket[1], bucket[2] = min(bucket[1], now), max(bucket[2], now)
        self._change(merchant, 1)
        return bucket


def _first_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _smaller_ahead(groups: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each entry the weights of entries ahead of it in its group with a smaller value; groups lie together.

    Values are compared bit by bit from the highest one on. Entries that are equal so far lie together; of two of them the one with the bit is larger.
    """
    n = len(values)
    found, place = np.zeros(n, np.int64), np.arange(n)
    begin = _first_of(groups)
    length = np.diff(np.append(begin, n))
    start, stop = np.repeat(begin, length), np.repeat(begin + length, length)
    for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
        one = (values >> bit) & 1 == 1
        weight = np.concatenate([[0], np.cumsum(np.where(one, 0, weights))])
        found[place[one]] += (weight[:-1] - weight[start])[one]
        zeros = np.concatenate([[0], np.cumsum(~one)])
        ahead, middle = zeros[:-1] - zeros[start], start + zeros[stop] - zeros[start]
        to = np.where(one, middle + np.arange(n) - start - ahead, start + ahead)
        start, stop = np.where(one, middle, start), np.where(one, stop, middle)
        moved = np.empty(n, np.int64)
        moved[to] = np.arange(n)
        place, values, weights, start, stop = place[moved], values[moved], weights[moved], start[moved], stop[moved]
    return found


_NEVER = 2**62


class Crowd:
    """The features of ``Standing`` for many visits at a time, all of one day, in arrays; merchants are numbers in the order of their ids.

    ``buckets`` holds (merchants, visits, first, last) by day. What changes among the visits at hand follows from the order in which merchants reach a
    number of visits: a merchant is behind those that reached one more than it has, and behind those with as many and a smaller id, which are
    those that reached as many less those that reached one more.
    """

    def __init__(self, buckets: dict[int, tuple[np.ndarray, ...]], merchants: int, window_days: int):
        self.buckets, self.merchants, self.window_days = buckets, merchants, window_days
        self.day: int | None = None
        self.touched: list[int] = []

    def move_to(self, day: int) -> None:
        """Finish the day at hand and take up a later one."""
        if day == self.day:
            return
        self.leave()
        self.day = day
        self.visits = np.zeros(self.merchants, np.int64)
        self.first, self.last = np.full(self.merchants, _NEVER), np.full(self.merchants, -_NEVER)
        for d, (who, visits, first, last) in self.buckets.items():
            if day - self.window_days < d <= day:
                self.visits[who] += visits
                self.first[who] = np.minimum(self.first[who], first)
                self.last[who] = np.maximum(self.last[who], last)
        self.today = np.zeros(self.merchants, np.int64)
        self.today_first, self.today_last = np.full(self.merchants, _NEVER), np.full(self.merchants, -_NEVER)

    def leave(self) -> None:
        """Add the visits of the day at hand to its bucket."""
        if self.day is None or not self.today.any():
            return
        if self.day in self.buckets:
            who, visits, first, last = self.buckets[self.day]
            self.today[who] += visits
            self.today_first[who] = np.minimum(self.today_first[who], first)
            self.today_last[who] = np.maximum(self.today_last[who], last)
        who = np.flatnonzero(self.today)
        self.buckets[self.day] = who, self.today[who], self.today_first[who], self.today_last[who]
        self.touched.append(self.day)

    def features(self, who: np.ndarray, ms: np.ndarray, counted: np.ndarray) -> list[np.ndarray]:
        """The nine visit features of visits in order, each ahead of counting it; the last one is the number of a merchant, -1 for none."""
        n, weight = len(who), counted.astype(np.int64)
        order = np.argsort(who, kind="stable")
        mine, first, last = (np.empty(n, np.int64) for _ in range(3))
        by_merchant, times, weights = who[order], ms[order], weight[order]
        begin = _first_of(by_merchant)
        length = np.diff(np.append(begin, n))
        running = np.cumsum(weights) - weights
        before = running - np.repeat(running[begin], length)
        here = np.full(len(begin), _NEVER)
        earliest, group = (before == 0) & (weights == 1), np.repeat(np.arange(len(begin)), length)
        here[group[earliest]] = times[earliest]
        known = np.where(weights == 1, np.arange(n), -1)
        newest = np.concatenate([[-1], np.maximum.accumulate(known)[:-1]])
        seen = before > 0
        mine[order] = self.visits[by_merchant] + before
        first[order] = np.minimum(self.first[by_merchant], np.where(seen, here[group], _NEVER))
        last[order] = np.maximum(self.last[by_merchant], np.where(seen, times[newest], -_NEVER))

        total = self.visits.sum() + np.cumsum(weight) - weight
        new = counted & (mine == 0)
        distinct = np.count_nonzero(self.visits) + np.cumsum(new) - new
        standing = np.flatnonzero(self.visits)
        places = np.sort(self.visits[standing] * self.merchants + standing)
        # The most visits, then the smallest merchant; numbers of visits only grow.
        best = -(places[-1] // self.merchants) if len(places) else 0
        top = np.searchsorted(places, -best * self.merchants)
        reached = np.where(counted, -(mine + 1) * self.merchants + who, _NEVER)
        best = best * self.merchants + places[top] % self.merchants if len(places) else _NEVER
        best = np.minimum.accumulate(np.concatenate([[best], reached[:-1]]))
        top = np.where(total > 0, best % self.merchants, -1)

        # A visit asks at the number of visits that its merchant has, and stands at the next one.
        level = np.stack([mine, mine + 1], 1).ravel()
        asked = np.argsort(level, kind="stable")
        level, weights = level[asked], np.stack([np.zeros(n, np.int64), weight], 1).ravel()[asked]
        smaller, reached = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
        smaller[asked] = _smaller_ahead(level, np.repeat(who, 2)[asked], weights)
        running = np.cumsum(weights) - weights
        begin = _first_of(level)
        reached[asked] = running - np.repeat(running[begin], np.diff(np.append(begin, 2 * n)))
        above = len(places) - np.searchsorted(places, (mine + 1) * self.merchants) + reached[1::2]
        equal = np.searchsorted(places, mine * self.merchants + who) - np.searchsorted(places, mine * self.merchants)
        rank = 1 + above + equal + smaller[::2] - smaller[1::2]

        known = mine > 0
        since = [np.where(known, _half_up(np.maximum(0, ms - np.where(known, m, ms)), DAY_MS, 6), -1.0) for m in (first, last)]
        share = np.where(known, _half_up(mine, np.maximum(total, 1), 6), 0.0)
        out = [mine, share, np.where(known, rank, 0), (known & (rank == 1)).astype(np.int64), *since, distinct, (~known).astype(np.int64), top]

        # Numbers of merchants are in order, so each group is written once.
        group, visits = by_merchant[_first_of(by_merchant)], np.add.reduceat(weight[order], _first_of(by_merchant))
        latest = np.maximum.reduceat(np.where(weight[order] == 1, times, -_NEVER), _first_of(by_merchant))
        self.visits[group] += visits
        self.today[group] += visits
        for to in (self.first, self.today_first):
            to[group] = np.minimum(to[group], here)
        for to in (self.last, self.today_last):
            to[group] = np.maximum(to[group], latest)
        return out


def _half_up(numerator: np.ndarray, denominator: np.ndarray | int, digits: int) -> np.ndarray:
    """``half_up`` of arrays whose products with twice the scale fit 64 bits."""
    scale = 10**digits
    return ((2 * scale * numerator + denominator) // (2 * denominator)) / scale
