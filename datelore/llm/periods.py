"""Periodic runs in texts: stretches of words that repeat with a smallest period at least twice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from datelore.llm.common import extend, texts_of

#: Groups of occurrences that a window can hold: their gaps are over a quarter of the factor, the window is twice the factor.
GROUPS = 8


class BasicFactors:
    """Names of all repeated factors of power-of-two length of a sequence of numbers.

    ``names[k][i]`` is equal at two places if and only if the ``2**k`` numbers from there on are equal;
    a factor that stands once has no name (-1). Lengths go up to the longest that repeats.
    """

    def __init__(self, numbers: np.ndarray):
        self.size = len(numbers)
        self.names: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        at, keys = np.arange(self.size), numbers.astype(np.int64)
        while True:
            order = np.lexsort((at, keys))
            at, keys = at[order], keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            name = np.cumsum(new) - 1
            twice = np.bincount(name, minlength=1)[name] > 1 if len(name) else np.zeros(0, bool)
            if not twice.any():
                return
            at, name = at[twice], name[twice]
            table = np.full(self.size, -1, np.int64)
            table[at] = name
            self.names.append(table)
            self.places.append(at)
            step = 1 << (len(self.names) - 1)
            within = at + step < self.size
            follow = table[np.where(within, at + step, 0)]
            longer = within & (follow >= 0)
            at, keys = at[longer], name[longer] * np.int64(self.size) + follow[longer]

    def _jump(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step, table = 1 << k, self.names[k]
            while True:  # more than one step is only possible with the longest
                x, y = (a - total - step, b - total - step) if back else (a + total, b + total)
                inside = (x >= 0) & (y < self.size)
                left, right = table[np.where(inside, x, 0)], table[np.where(inside, y, 0)]
                same = inside & (left >= 0) & (left == right)
                total[same] += step
                if k < len(self.names) - 1 or not same.any():
                    break
        return total

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from ``a`` on equal those from ``b`` on; ``a < b``."""
        return self._jump(a, b, False)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before ``a`` equal those before ``b``; ``a < b``."""
        return self._jump(a, b, True)


def _spread(start: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of arithmetic progressions, each with the number of its progression."""
    which = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return start[which] + nth * step[which], which


def proposals(factors: BasicFactors, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods from ``2**k`` to below ``2**(k + 1)`` that repeated factors of that length propose.

    Occurrences closer than a quarter of the length form an arithmetic progression, whose step is a
    shorter period. Two progressions of one factor within twice its length propose the distances from
    the first and the last of the earlier to all of the later, and from all of the earlier to the first of
    the later: a stretch with a longer smallest period leaves one of the two progressions, so its period is among these.
    """
    at, step = factors.places[k], 1 << k
    name = factors.names[k][at]
    gap = np.diff(at)
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (4 * gap > step)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, last, kind = at[first], at[first + count - 1], name[first]
    pace = np.where(count > 1, (last - start) // np.maximum(count - 1, 1), 0)
    places, periods = [], []
    for lag in range(1, GROUPS + 1):
        if len(first) <= lag:
            break
        a = np.flatnonzero((kind[lag:] == kind[:-lag]) & (start[lag:] - last[:-lag] < 2 * step))
        if not len(a):
            break
        b = a + lag
        later, of = _spread(start[b], pace[b], count[b])
        earlier, by = _spread(start[a], pace[a], count[a])
        places += [last[a][of], start[a][of], earlier]
        periods += [later - last[a][of], later - start[a][of], start[b][by] - earlier]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = np.concatenate(places), np.concatenate(periods)
    fit = (period >= step) & (period < 2 * step)
    return place[fit], period[fit]


def maximal_runs(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all maximal runs of at least ``least`` numbers and two periods, by start and period."""
    factors = BasicFactors(numbers)
    found = [proposals(factors, k) for k in range(len(factors.names))]
    none = np.zeros(0, np.int64)
    place, period = np.concatenate([none, *(p for p, _ in found)]), np.concatenate([none, *(q for _, q in found)])
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # Places side by side with one period lie in one run.
    new = np.ones(len(place), bool)
    new[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 1)
    place, period = place[new], period[new]
    left, right = factors.before(place, place + period), factors.after(place, place + period)
    start, length = place - left, period + left + right
    long = (length >= 2 * period) & (length >= least)
    start, length, period = start[long], length[long], period[long]
    # One stretch with several periods has the smallest; the others are its multiples.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of_texts(texts: list[str], least: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[str], list[int]]:
    """For each text its runs, its kept words joined by a blank, and its number of words.

    All texts are searched together. Words are numbered anew in each text and a number of its own
    stands between two texts, so no factor repeats in another text and no run spans two.
    """
    split = [x.encode().split() for x in texts]
    numbers, at, base = [], [], 0
    for words in split:
        at.append(len(numbers))
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, base + len(known)) for w in words]
        base += len(known)
        numbers.append(base)
        base += 1
    start, length, period = maximal_runs(np.array(numbers, np.int64), least)
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    cuts = np.searchsorted(start, np.array([*at, len(numbers)]))
    runs, kept = [], []
    for i, words in enumerate(split):
        here = slice(cuts[i], cuts[i + 1])
        runs.append((start[here] - at[i], length[here], period[here]))
        stay = words if cuts[i] == cuts[i + 1] else [w for w, out in zip(words, dropped[at[i] : at[i] + len(words)].tolist()) if not out]
        kept.append(b" ".join(stay).decode())
    return runs, kept, [len(words) for words in split]


def periodic_runs(df: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``df`` with ``n_words``, ``runs`` and ``collapsed``.

    Words are what stands between blanks (space, tab to carriage return), numbered from 0. A run
    is a stretch of words with smallest period ``period`` and ``length`` of at least two periods
    and at least ``least``, which no neighbouring word extends with that period; runs come by start,
    then period. ``collapsed`` joins by one blank the words that no run holds after its first period.
    Null, empty and blank texts have no words and no runs and collapse to an empty text. Every row is
    searched by itself, repeated rows too; columns with these names are replaced; an empty
    table gives an empty table. A text is worked on as a whole; memory follows the longest text.
    """

    def compute(batch):
        runs, kept, sizes = runs_of_texts(texts_of(batch, text), least)
        ends = np.cumsum([0, *(len(s) for s, _, _ in runs)]).astype(np.int32)
        columns = [np.concatenate([np.zeros(0, np.int64), *(r[i] for r in runs)]) for i in range(3)]
        table = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
        return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), table), pa.array(kept, pa.string())]

    return extend(df, text, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string", compute)
