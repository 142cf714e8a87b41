"""Chart shapes between prominent turning points, all found in one pass over a symbol's bars.

Bars are dealt by symbol and sorted once; a task reads them in turn, and for some
hundred symbols at a time works out means, volume figures and turning points as
columns of numbers. A shape is a condition on neighbouring turning points; what
it measures are ranges of a symbol's columns. So any number of shapes costs one
shuffle by symbol, and nothing is joined back to the bars. Positions count from
0 in the order of dates.

Bars need symbol_id, trade_date, high, low, close and volume; null prices are
passed over by means and extremes and meet no condition. Symbols with fewer than
``least_bars`` bars and empty tables give no rows; further columns are ignored.
Two bars of one symbol and date are two bars, in any order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.signals import BUFFER, LEAST_RATIO, LEAST_Z, RECENT, WAIT

#: Half-width of the centred mean, and the least prominence as a share of its range.
HALF, PROMINENCE = 4, 0.02
LEAST_BARS = 120
#: Fixed limits of the shapes: rise before a left rim, rims, depths, widths and waits in bars.
RISE, RISE_BARS = 0.15, 30
DEPTH, RIM = (0.15, 0.35), 0.08
CUP, HANDLE, HANDLE_DEPTH = (20, 130), (3, 20), 0.12
ROUND, SYMMETRY, NEAR, DWELL = (20, 160), (0.6, 1.4), 0.03, 3
BOTTOMS, SPREAD, NECK = (10, 60), 0.04, 0.08
FLAT, STEP, ASCENDING, SYMMETRICAL = 0.015, 1.005, (15, 90), (15, 80)
BASE, BASE_DEPTH, BASE_RISE = (45, 80), 0.20, 0.02
POLE, POLE_RISE, TIGHT_POLE, TIGHT_RISE, FLAG = (5, 20), 12.0, (5, 40), 90.0, (3, 15)
RETRACED, TIGHT_RETRACED, TIGHT_RANGE, FLAG_SLOPE, FLAG_BUFFER, TIGHT_RATIO = 38.0, 25.0, 15.0, 0.2, 0.02, 2.0
BOX, BOX_DEPTH, BOX_TOUCH = (15, 60), 0.20, 0.02
YOUNG, YOUNG_BASE, YOUNG_DEPTH = (35, 180), (15, 65), 0.30
HEAD, SHOULDERS, BREAK = 1.03, 0.05, 0.99

#: Measures that only some shapes have.
EXTRA = ["depth_pct", "handle_pct", "symmetry", "similarity_pct", "pole_pct", "range_pct", "retraced_pct"]
#: Rows of whole symbols that a task works on at a time.
ROWS = 100_000


# --- turning points ------------------------------------------------------------------------------------------


def prominences(values) -> list[tuple[int, float]]:
    """Position and prominence of each peak; a plateau counts once, in its middle.

    The prominence is the height over the higher one of the lowest values on
    either side, each as far as the next higher value or the end.
    """
    line = np.asarray(values, float)
    if len(line) < 3:
        return []
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))  # plateaus by where they begin
    flat = line[first]
    if len(flat) < 3:
        return []
    up = flat[1:] > flat[:-1]
    # only the ends and where the direction changes matter
    kept = np.concatenate([[0], np.flatnonzero(up[1:] != up[:-1]) + 1, [len(flat) - 1]])
    turns = flat[kept].tolist()

    def lowest(side: list[float]) -> list[float]:
        out, higher = [], []  # falling values so far, each with the lowest since the one before it
        for v in side:
            low = v
            while higher and higher[-1][0] <= v:
                low = min(low, higher.pop()[1])
            higher.append((v, low))
            out.append(low)
        return out

    left, right = lowest(turns), lowest(turns[::-1])[::-1]
    last = np.concatenate([first[1:], [len(line)]]) - 1
    middle = ((first + last) // 2)[kept].tolist()
    return [(middle[k], turns[k] - max(left[k], right[k])) for k in range(1, len(turns) - 1) if turns[k] > turns[k - 1]]


def steps(values) -> list[tuple[int, float]]:
    """Position of each strict peak and its height over the higher neighbour."""
    line = np.asarray(values, float)
    if len(line) < 3:
        return []
    beside = np.maximum(line[:-2], line[2:])
    peaks = np.flatnonzero(line[1:-1] > beside) + 1
    return list(zip(peaks.tolist(), (line[peaks] - beside[peaks - 1]).tolist()))


def turning_points(values: np.ndarray, share: float, beside: bool = False) -> list[tuple[int, bool]]:
    """Peaks (True) and troughs in order whose prominence is at least a share of the range of the known values.

    Prominent peaks and troughs alternate. With ``beside`` a point counts by its
    height over its neighbours alone, and several troughs may lie between two peaks.
    """
    known = np.flatnonzero(values == values)
    line = values[known]
    if len(line) < 3:
        return []
    reach = float(line.max() - line.min())
    if reach <= max(1e-9, abs(float(line.mean())) * 1e-9):
        return []
    least = share if share >= 1 else max(reach * share, 1e-6)
    height = steps if beside else prominences
    at = known.tolist()
    return sorted([(at[k], True) for k, p in height(line) if p >= least] + [(at[k], False) for k, p in height(-line) if p >= least])


# --- columns of numbers --------------------------------------------------------------------------------------


def framed(values: np.ndarray, place: np.ndarray, left: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the known values from ``before`` bars back to ``after`` bars ahead, added in order, within each symbol.

    ``place`` counts the bars of a symbol from 0, ``left`` those that follow.
    """
    known = values == values
    plain, n = np.where(known, values, 0.0), len(values)
    total, count = np.zeros(n), np.zeros(n)
    for k in range(-before, after + 1):
        if abs(k) >= n:
            continue
        to, of = (slice(-k, None), slice(None, n + k)) if k < 0 else (slice(None, n - k), slice(k, None))
        there = (place[to] >= -k) if k < 0 else (left[to] >= k)
        total[to] += np.where(there, plain[of], 0.0)
        count[to] += there & known[of]
    return total, count


def summed(values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of the ``n`` whole numbers before each bar, as far as its symbol has them."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    at = np.arange(len(values))
    return total[at] - total[at - np.minimum(place, n)]


def deviations(volume: np.ndarray, place: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """Volume against mean and population deviation of the ``n`` bars before it, to six digits; NaN without that many."""
    at = np.minimum(place, n)
    if (volume == np.floor(volume)).all() and float((volume * volume).sum()) * n < 2.0**53:
        total, squares, count = summed(volume, place, n), summed(volume * volume, place, n), at.astype(float)
        gap, spread = count * volume - total, np.sqrt(count * squares - total * total)
    else:
        total, count = framed(volume, place, left, n, -1)
        mean = total / count
        squares = np.zeros(len(volume))
        for k in range(1, min(n, len(volume) - 1) + 1):
            gap = volume[: len(volume) - k] - mean[k:]
            squares[k:] += np.where((place[k:] >= k) & (gap == gap), gap * gap, 0.0)
        gap, spread = volume - mean, np.sqrt(squares / count)
    z = gap / np.where(spread == 0, np.nan, spread) * 1e6
    return np.where(place >= n, np.where(z < 0, -np.floor(0.5 - z), np.floor(z + 0.5)) / 1e6, np.nan)


class Line:
    """The bars of one symbol as columns, and its turning points."""

    def __init__(self, columns: dict[str, np.ndarray], points: list[tuple[int, bool]]):
        self.date, self.high, self.low, self.close, self.smooth = (columns[c] for c in ("date", "high", "low", "close", "smooth"))
        self.ratio, self.spike, self.atr = columns["volume_ratio"], columns["spike"], columns["atr_14"]
        self.score = columns["stage2_score"][-1] if "stage2_score" in columns else None
        self.n, self.points = len(self.close), points
        self.peaks, self.troughs = [p for p, top in points if top], [p for p, top in points if not top]
        self.loud: dict[float, list[int]] = {}

    def part(self, of: str, first: int, last: int) -> np.ndarray:
        """The elements at first to last, as far as there are any."""
        return getattr(self, of)[max(first, 0) : max(last + 1, 0)]

    def lowest(self, of: str, first: int, last: int) -> float:
        values = self.part(of, first, last)
        return np.fmin.reduce(values) if len(values) else np.float64(np.nan)

    def highest(self, of: str, first: int, last: int) -> float:
        values = self.part(of, first, last)
        return np.fmax.reduce(values) if len(values) else np.float64(np.nan)

    def mean(self, first: int, last: int) -> float:
        """Mean of the known volume ratios."""
        values = self.part("ratio", first, last)
        values = values[values == values]
        return sum(values.tolist()) / len(values) if len(values) else np.nan

    def louds(self, least_ratio: float) -> list[int]:
        if least_ratio not in self.loud:
            self.loud[least_ratio] = np.flatnonzero(self.spike & (self.ratio >= least_ratio)).tolist()
        return self.loud[least_ratio]

    def breakout(self, after: int, level: float, least_ratio: float = LEAST_RATIO) -> int | None:
        """The first of the WAIT bars after a position that closes above the level on confirmed volume."""
        loud = self.louds(least_ratio)
        for k in range(bisect_right(loud, after), len(loud)):
            if loud[k] > after + WAIT:
                return None
            if self.close[loud[k]] > level:
                return loud[k]
        return None

    def risen(self, left: int, price: float) -> bool:
        """Whether the price is a share above the lowest close of the bars before the position."""
        return price >= (1 + RISE) * (self.lowest("close", left - RISE_BARS, left - 1) if left > 0 else self.close[left])

    def recent(self, position: int) -> bool:
        return position >= max(0, self.n - 1 - RECENT)

    def quiet(self, first: int, last: int) -> bool:
        return bool(self.mean(first, last) < 1)

    def near(self, level: float, buffer: float = BUFFER) -> bool:
        return bool((1 - buffer) * level <= self.close[-1] <= level)

    def dwells(self, first: int, last: int, bottom: float) -> bool:
        return int((self.part("smooth", first, last) <= bottom * (1 + NEAR)).sum()) >= DWELL

    def held(self, since: int, price: float) -> bool:
        return self.lowest("low", since, self.n - 1) > price

    def runs(self, *tops: bool) -> Iterator[list[int]]:
        """Positions of neighbouring turning points of these kinds."""
        kinds = [top for _, top in self.points]
        for i in range(len(kinds) - len(tops) + 1):
            if all(kinds[i + j] == top for j, top in enumerate(tops)):
                yield [self.points[i + j][0] for j in range(len(tops))]


def neighbours(of: list[int], k: int) -> Iterator[list[int]]:
    for i in range(len(of) - k + 1):
        yield of[i : i + k]


def clipped(value: float) -> float:
    return max(0.0, min(100.0, value))


# --- shapes --------------------------------------------------------------------------------------------------
# Each yields candidates with start, end, hit, level, invalidation, quality, width, dry, pivots, whether they are
# watched without a breakout, and some of EXTRA.


def cup_handle(x: Line, latest: bool) -> Iterator[dict]:
    """Peak, trough, peak and trough: a cup of some depth between even rims, and a shallow handle."""
    for left, bottom, right, low in x.runs(True, False, True, False):
        if not (CUP[0] <= right - left <= CUP[1] and HANDLE[0] <= low - right <= HANDLE[1]):
            continue
        a, b, c, e = (x.smooth[k] for k in (left, bottom, right, low))
        rim, uneven = (a + c) / 2, abs(a - c)
        depth, drop = 1 - b / rim, 1 - e / c
        if not (DEPTH[0] <= depth <= DEPTH[1] and uneven <= RIM * max(a, c) and x.risen(left, a) and e >= (b + rim) / 2 and 0 < drop <= HANDLE_DEPTH and x.dwells(left, right, b)):
            continue
        level, stop, dry = x.highest("high", left, right), x.lowest("low", right, low), x.quiet(bottom - 2, bottom + 2)
        quality = 45 + max(0.0, 15 - 100 * uneven / rim) + max(0.0, 18 - 100 * drop) + (8.0 if dry else 0.0)
        watched = x.recent(low) and x.near(level) and x.held(low, stop)
        yield dict(start=left, end=low, hit=x.breakout(low, level), level=level, invalidation=stop, quality=quality, width=right - left, dry=dry, pivots=[left, bottom, right, low], watched=watched, depth_pct=100 * depth, handle_pct=100 * drop, symmetry=(bottom - left) / max(right - bottom, 1))


def round_bottom(x: Line, latest: bool) -> Iterator[dict]:
    """Peak and trough, and as long a way back up to near the peak."""
    for left, bottom in x.runs(True, False):
        a, b = x.smooth[left], x.smooth[bottom]
        back = np.flatnonzero(x.part("smooth", bottom + 1, bottom + ROUND[1]) >= a * (1 - RIM))
        if not len(back):
            continue
        right = bottom + 1 + int(back[0])
        if not ROUND[0] <= right - left <= ROUND[1]:
            continue
        symmetry, rim = (bottom - left) / max(right - bottom, 1), (a + x.smooth[right]) / 2
        depth = 1 - b / rim
        if not (SYMMETRY[0] <= symmetry <= SYMMETRY[1] and DEPTH[0] <= depth <= DEPTH[1] and x.risen(left, a) and x.dwells(left, right, b)):
            continue
        level, dry = x.highest("high", left, right), x.quiet(bottom - 2, bottom + 2)
        hit = x.breakout(right, level)
        stop = x.lowest("low", right + 1, (x.n if hit is None else hit) - 1)
        if stop != stop:
            stop = level - 2 * (float(x.atr[right]) if x.atr[right] == x.atr[right] else 0.0)
        quality = 48 + max(0.0, 14 - 20 * abs(1 - symmetry)) + (8.0 if dry else 0.0)
        watched = x.recent(right) and bool(x.ratio[-1] >= LEAST_RATIO / 2) and x.near(level) and x.held(right, stop)
        yield dict(start=left, end=right, hit=hit, level=level, invalidation=stop, quality=quality, width=right - left, dry=dry, pivots=[left, bottom, right], watched=watched, depth_pct=100 * depth, symmetry=symmetry)


def double_bottom(x: Line, latest: bool) -> Iterator[dict]:
    """Trough, peak and trough: two lows of about one price, well below the neckline between them.

    A peak before the first low makes the same shape once more; the second of equal signals goes.
    """
    for first, neck, second in x.runs(False, True, False):
        if not BOTTOMS[0] <= second - first <= BOTTOMS[1]:
            continue
        a, b, c = (x.smooth[k] for k in (first, neck, second))
        low = (a + c) / 2
        spread = abs(a - c) / low
        if not (spread <= SPREAD and b / low - 1 >= NECK and x.risen(max(0, first - 1), b)):
            continue
        level, stop, dry = x.highest("high", first, second), x.lowest("low", first, second), x.quiet(second - 2, second + 2)
        quality = 50 + max(0.0, 15 - 200 * spread) + (8.0 if dry else 0.0)
        yield dict(start=first, end=second, hit=x.breakout(second, level), level=level, invalidation=stop, quality=quality, width=second - first, dry=dry, pivots=[first, neck, second], watched=x.near(level) and x.held(second, stop), similarity_pct=100 * spread)


def _between_peaks(x: Line, low: int, high: int) -> Iterator[tuple[int, int, float, float, list[int], list[float]]]:
    """Consecutive peaks some bars apart, with the prices of both, the troughs between them and their prices."""
    for first, second in neighbours(x.peaks, 2):
        if second - first > 15 and low <= second - first <= high:
            inner = [t for t in x.troughs if first < t < second]
            if len(inner) >= 2:
                yield first, second, x.smooth[first], x.smooth[second], inner, [x.smooth[t] for t in inner]


def _triangle(x: Line, first: int, second: int, lows: list[float]) -> dict:
    """Level, invalidation, dry volume and breakout of a triangle between two peaks."""
    level, width = x.highest("high", first, second), second - first
    dry = first > 0 and bool(x.mean(second, second + 4) < x.mean(first - 5, first - 1))
    return dict(start=first, end=second, hit=x.breakout(second, level), level=level, invalidation=0.98 * lows[-1], width=width, dry=dry, watched=x.recent(second) and x.near(level))


def ascending_triangle(x: Line, latest: bool) -> Iterator[dict]:
    """Two peaks of one price and rising troughs between them."""
    for first, second, p1, p2, _, lows in _between_peaks(x, *ASCENDING):
        level = (p1 + p2) / 2
        if max(abs(p1 - level), abs(p2 - level)) <= FLAT * level and all(b >= STEP * a for a, b in zip(lows, lows[1:])):
            c = _triangle(x, first, second, lows)
            quality = clipped(45 - min(200 * abs(p2 - p1) / level, 15.0) + min(100 * (lows[-1] / lows[0] - 1), 10.0) + (8.0 if c["dry"] else 0.0) - 0.2 * max(c["width"] - 30, 0))
            yield c | dict(quality=quality, pivots=[first, second])


def symmetrical_triangle(x: Line, latest: bool) -> Iterator[dict]:
    """A falling peak and a rise from the first to the last trough between, not yet met."""
    for first, second, p1, p2, inner, lows in _between_peaks(x, *SYMMETRICAL):
        if p2 < p1 and lows[-1] > lows[0] and p2 > lows[-1]:
            c = _triangle(x, first, second, lows)
            quality = clipped(45 + min(50 * ((1 - p2 / p1) + (lows[-1] / lows[0] - 1)), 15.0) + (8.0 if c["dry"] else 0.0) - 0.2 * max(c["width"] - 40, 0))
            yield c | dict(quality=quality, pivots=[first, inner[0], inner[-1], second])


def ascending_base(x: Line, latest: bool) -> Iterator[dict]:
    """Three troughs in a row, each some per cent higher, in a base of limited depth."""
    for first, second, third in neighbours(x.troughs, 3):
        if not BASE[0] <= third - first <= BASE[1]:
            continue
        a, b, c = (x.smooth[k] for k in (first, second, third))
        if not (b >= (1 + BASE_RISE) * a and c >= (1 + BASE_RISE) * b):
            continue
        level = x.highest("high", first, third)
        if not 1 - x.lowest("low", first, third) / level <= BASE_DEPTH:
            continue
        quality, dry = clipped(58 + min(18.0, 120 * (c / a - 1))), bool(x.mean(second, third) < x.mean(first, second - 1))
        yield dict(start=first, end=third, hit=x.breakout(third, level), level=level, invalidation=0.98 * c, quality=quality, width=third - first, dry=dry, pivots=[first, second, third], watched=False)


def _flag(x: Line, latest: bool, pole: tuple[int, int], rise: float, retraced: float, widest: float | None, least_ratio: float) -> Iterator[dict]:
    """A steep pole and the shortest flag after it that gives little back; poles by length, then by end.

    What a flag looks like depends on its top and length alone, so it is worked
    out once for each; poles then ask for the first length that gives back little.
    """
    tops = x.n - FLAG[0] - 1  # a top has at least FLAG[0] bars and one more after it
    if tops <= pole[0]:
        return
    close = x.close
    feet, ends, heights, climbs = [], [], [], []
    for k in range(pole[0], min(pole[1], x.n - 1) + 1):
        foot, top = close[: max(tops - k, 0)], close[k:tops]
        climb = np.where(foot > 1e-9, 100 * (top / foot - 1), np.nan)
        at = np.flatnonzero(climb >= rise)
        feet.append(at)
        ends.append(at + k)
        climbs.append(climb[at])
    foot, top, climb = np.concatenate(feet), np.concatenate(ends), np.concatenate(climbs)
    if not len(foot):
        return
    used, which = np.unique(top, return_inverse=True)
    span = np.arange(FLAG[1] + 1)
    pad = lambda v: np.concatenate([v, np.full(FLAG[1], np.nan)])[used[:, None] + span]
    low, high, smooth = np.fmin.accumulate(pad(x.low), axis=1), np.fmax.accumulate(pad(x.high), axis=1), pad(x.smooth)
    lengths = span[FLAG[0] :]
    fits = ((smooth[:, FLAG[0] :] - smooth[:, :1]) / lengths <= FLAG_SLOPE) & (used[:, None] + lengths < x.n)
    if widest is not None:
        fits &= 100 * (high[:, FLAG[0] :] / low[:, FLAG[0] :] - 1) <= widest
    height = close[top] - close[foot]
    little = 100 * (close[top][:, None] - low[which, FLAG[0] :]) / height[:, None] <= retraced
    little &= fits[which]
    first = little.argmax(axis=1)
    some = np.flatnonzero(little[np.arange(len(top)), first])
    if not len(some):
        return
    foot, top, which, climb, length = foot[some], top[some], which[some], climb[some], first[some] + FLAG[0]
    level, end = high[which, length], top + length
    loud = np.zeros(x.n + WAIT + 1, bool)
    loud[x.louds(least_ratio)] = True
    after, hit = np.concatenate([close, np.full(WAIT + 1, np.nan)]), np.full(len(end), -1)
    for k in range(1, WAIT + 1):
        hit = np.where((hit < 0) & loud[end + k] & (after[end + k] > level), end + k, hit)
    sure = (hit >= 0) & ((hit >= max(0, x.n - 1 - RECENT)) if latest else True)
    watched = ((1 - FLAG_BUFFER) * level <= close[-1]) & (close[-1] <= level)
    # of candidates with one state and date the first counts
    kind = np.where(sure, hit, np.where(watched, -1, -2))
    _, picked = np.unique(kind, return_index=True)
    for i in sorted(int(i) for i in picked if kind[i] > -2):
        f, t, e = int(foot[i]), int(top[i]), int(end[i])
        top_, bottom = level[i], low[which[i], length[i]]
        back = 100 * (close[t] - bottom) / (close[t] - close[f])
        dry = x.quiet(t, e)
        quality = 50 + min(20.0, float(climb[i]) / (2 if widest is None else 3)) + max(0.0, 20 - back) + (8.0 if dry else 0.0)
        yield dict(start=f, end=e, hit=int(hit[i]) if hit[i] >= 0 else None, level=top_, invalidation=bottom, quality=quality, width=e - f, dry=dry, pivots=[f, t, e], watched=bool(watched[i]), pole_pct=float(climb[i]), range_pct=100 * (top_ / bottom - 1), retraced_pct=back)


def flag(x: Line, latest: bool) -> Iterator[dict]:
    return _flag(x, latest, POLE, POLE_RISE, RETRACED, None, LEAST_RATIO)


def high_tight_flag(x: Line, latest: bool) -> Iterator[dict]:
    return _flag(x, latest, TIGHT_POLE, TIGHT_RISE, TIGHT_RETRACED, TIGHT_RANGE, TIGHT_RATIO)


def _boxes(x: Line, ends: range, spans: tuple[int, int], depth: float, touched: bool, latest: bool) -> Iterator[dict]:
    """For each end, in order, the shortest range of bars that fits and breaks out where no earlier end does."""
    loud, taken = x.louds(LEAST_RATIO), set()
    for end in ends:
        ahead = [k for k in loud[bisect_right(loud, end) :] if k <= end + WAIT]
        if not ahead or end + 1 < spans[0]:
            continue
        back = slice(max(0, end - spans[1] + 1), end + 1)
        high, low, close = x.high[back][::-1], x.low[back][::-1], x.close[back][::-1]
        top, bottom = np.fmax.accumulate(high), np.fmin.accumulate(low)
        hit = np.full(len(top), -1)
        for k in ahead:
            hit = np.where((hit < 0) & (x.close[k] > top), k, hit)
        fits = (hit >= 0) & (bottom > 0) & (1 - bottom / top <= depth)
        fits[: spans[0] - 1] = False
        if latest:
            fits &= hit >= max(0, x.n - 1 - RECENT)
        for i in np.flatnonzero(fits).tolist():
            if int(hit[i]) in taken:
                continue
            touches = int((high[: i + 1] >= top[i] * (1 - BOX_TOUCH)).sum())
            if touched and not (touches >= 2 and np.fmax.reduce(close[: i + 1]) <= top[i] * (1 + BOX_TOUCH)):
                continue
            taken.add(int(hit[i]))
            level, stop, start = float(top[i]), float(bottom[i]), end - i
            yield dict(start=start, end=end, hit=int(hit[i]), level=level, invalidation=stop, width=i + 1, dry=x.quiet(start, end), watched=False, depth_pct=100 * (1 - stop / level), touches=touches)
            break


def _place(x: Line, of: str, c: dict, value: float) -> int:
    """The first position from start to end with the value."""
    return c["start"] + int(np.flatnonzero(x.part(of, c["start"], c["end"]) == value)[0])


def darvas_box(x: Line, latest: bool) -> Iterator[dict]:
    """A box that ends in the last bars, whose top is touched twice and closes stay within, and the breakout from it."""
    ends = range(max(BOX[0], max(0, x.n - BOX[1] - WAIT) + BOX[0]), x.n - 1)
    for c in _boxes(x, ends, BOX, BOX_DEPTH, True, latest):
        quality = clipped(55 + min(12.0, 3.0 * c["touches"]) + max(0.0, 18 - c["depth_pct"]))
        yield c | dict(quality=quality, pivots=[c["start"], _place(x, "high", c, c["level"]), _place(x, "low", c, c["invalidation"]), c["end"]])


def young_base(x: Line, latest: bool) -> Iterator[dict]:
    """A base on a listing of few bars, and the breakout from it."""
    if YOUNG[0] <= x.n <= YOUNG[1]:
        for c in _boxes(x, range(YOUNG_BASE[0], x.n - 1), YOUNG_BASE, YOUNG_DEPTH, False, latest):
            quality = clipped(55 + max(0.0, 20 - c["depth_pct"]) + min(8.0, 0.15 * c["width"]))
            yield c | dict(quality=quality, pivots=[c["start"], _place(x, "low", c, c["invalidation"]), c["end"]])


def head_and_shoulders(x: Line) -> dict | None:
    """The first three peaks with the middle one highest, even shoulders, and a last close below the neckline.

    ``neckline`` is the mean of the troughs next to the head and decides;
    ``sloped`` is the line through them at the last bar.
    """
    for left, head, right in neighbours(x.peaks, 3):
        a, b, c = (x.smooth[k] for k in (left, head, right))
        if not (b > HEAD * max(a, c) and abs(a - c) <= SHOULDERS * a):
            continue
        before, after = [t for t in x.troughs if left < t < head], [t for t in x.troughs if head < t < right]
        if not before or not after:
            continue
        t1, t2 = before[-1], after[0]
        v1, v2 = x.smooth[t1], x.smooth[t2]
        neckline = (v1 + v2) / 2
        if x.close[-1] < BREAK * neckline:
            high = x.highest("high", x.n - 61, x.n - 1)
            return dict(signal_date=x.date[-1], left=left, head=head, right=right, t1=t1, t2=t2, neckline=neckline, sloped=v2 + (v2 - v1) / (t2 - t1) * (x.n - 1 - t2), invalidation=high if high > 0 else 1.05 * neckline)
    return None


SHAPES: dict[str, Callable[[Line, bool], Iterator[dict]]] = {
    "cup_handle": cup_handle,
    "round_bottom": round_bottom,
    "double_bottom": double_bottom,
    "flag": flag,
    "high_tight_flag": high_tight_flag,
    "ascending_triangle": ascending_triangle,
    "symmetrical_triangle": symmetrical_triangle,
    "ascending_base": ascending_base,
    "darvas_box": darvas_box,
    "ipo_base": young_base,
}


def _positive(raw: float, c: dict, x: Line) -> float:
    """The invalidation price, where it is above zero, else one from the lows, the close or the level."""
    if raw > 0:
        return raw
    spare = next((float(v) for v in (x.lowest("low", c["start"], c["end"]), x.close[c["end"]], c["level"], 0.01) if v > 0), 0.01)
    return max(0.01, 0.98 * spare)


def signals_of(x: Line, family: str, latest: bool) -> Iterator[dict]:
    """Signals of a shape: confirmed by a breakout, with ``latest`` only by a recent one, else watched.

    Of candidates with one state and date the first counts.
    """
    seen = set()
    for c in SHAPES[family](x, latest):
        sure = c["hit"] is not None and (x.recent(c["hit"]) if latest else True)
        if not (sure or c["watched"]):
            continue
        at = c["hit"] if sure else x.n - 1
        key = (sure, int(x.date[at]))
        if key in seen:
            continue
        seen.add(key)
        known = lambda v: None if v is None or v != v else float(v)
        yield dict(
            family=family, state="confirmed" if sure else "watchlist", start_date=x.date[c["start"]], end_date=x.date[c["end"]], signal_date=x.date[at], start_at=c["start"], end_at=c["end"], signal_at=at,
            level=known(c["level"]), invalidation=_positive(c["invalidation"], c, x), quality=c["quality"] - (0.0 if sure else 10.0), width=c["width"], dry=c["dry"], volume_ratio=known(x.ratio[at]), **{name: known(c.get(name)) for name in EXTRA}, pivots=c["pivots"],
        )


# --- bars in turn --------------------------------------------------------------------------------------------

FIELDS = {
    "series": [("n", pa.int32()), ("smooth", pa.list_(pa.float64())), ("volume_ratio", pa.list_(pa.float64())), ("spike", pa.list_(pa.bool_()))],
    "points": [("trade_date", pa.date32()), ("at", pa.int32()), ("kind", pa.string()), ("value", pa.float64())],
    "tops": [("signal_date", pa.date32()), ("left", pa.int32()), ("head", pa.int32()), ("right", pa.int32()), ("t1", pa.int32()), ("t2", pa.int32()), ("neckline", pa.float64()), ("sloped", pa.float64()), ("invalidation", pa.float64())],
    "signals": [("family", pa.string()), ("state", pa.string()), ("start_date", pa.date32()), ("end_date", pa.date32()), ("signal_date", pa.date32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("signal_at", pa.int32()), ("level", pa.float64()), ("invalidation", pa.float64()), ("quality", pa.float64()), ("width", pa.int32()), ("dry", pa.bool_()), ("volume_ratio", pa.float64()), *[(name, pa.float64()) for name in EXTRA], ("pivots", pa.list_(pa.int32()))],
}
SQL_TYPES = {pa.date32(): "date", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>", pa.list_(pa.float64()): "array<double>", pa.list_(pa.bool_()): "array<boolean>"}


def codes_of(table: pa.Table) -> np.ndarray:
    """A number for each symbol."""
    coded = table.column("symbol_id").combine_chunks().dictionary_encode(null_encoding="encode")
    return (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices.to_numpy(zero_copy_only=False)


def columns_of(table: pa.Table, half: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of whole symbols in order, and where each symbol begins."""
    number = lambda c: np.asarray(table.column(c).cast(pa.float64()).to_numpy(), float)
    codes = codes_of(table)
    n = len(codes)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - 1 - place
    out = {c: number(c) for c in ("high", "low", "close", "volume", *[c for c in ("stage2_score",) if c in table.column_names])}
    out["date"] = table.column("trade_date").cast(pa.date32()).cast(pa.int32()).to_numpy()
    close, volume = out["close"], out["volume"]
    total, count = framed(close, place, left, half, half)
    out["smooth"] = total / np.where(count == 0, np.nan, count)
    before = np.where(place > 0, np.concatenate([[np.nan], close[:-1]]), np.nan)
    reach = np.fmax(out["high"], before) - np.fmin(out["low"], before)
    total, count = framed(reach, place, left, 13, 0)
    out["atr_14"] = total / np.where(count == 0, np.nan, count)
    total, count = framed(volume, place, left, 20, -1)
    mean = total / np.where(count == 0, np.nan, count)
    out["volume_ratio"] = volume / np.where(mean == 0, np.nan, mean)
    out["spike"] = (deviations(volume, place, left, 20) >= LEAST_Z) | (deviations(volume, place, left, 50) >= LEAST_Z)
    return out, starts


def searched(bars: DataFrame, what: str, each: Callable[[Line], list[dict]], least_bars: int, share: float, beside: bool, half: int = HALF) -> DataFrame:
    """What is found on each symbol's bars, which a task reads sorted and keeps for some symbols at a time."""
    fields, rows = FIELDS[what], ROWS
    names = ["symbol_id", "trade_date", "high", "low", "close", "volume", *[c for c in ("stage2_score",) if c in bars.columns]]
    kind = bars.schema["symbol_id"].dataType.simpleString()

    def whole(table: pa.Table) -> pa.RecordBatch:
        with np.errstate(all="ignore"):
            columns, starts = columns_of(table, half)
            ends = [*starts[1:].tolist(), len(columns["close"])]
            at, found = [], []
            for a, b in zip(starts.tolist(), ends):
                if b - a < least_bars:
                    continue
                own = {c: v[a:b] for c, v in columns.items()}
                for row in each(Line(own, turning_points(own["smooth"], share, beside))):
                    at.append(a)
                    found.append(row)
        made = [table.column("symbol_id").combine_chunks().take(pa.array(at, pa.int64()))]
        for name, type_ in fields:
            values = [r[name] for r in found]
            made.append(pa.array([None if v is None else int(v) for v in values], pa.int32()).cast(type_) if type_ == pa.date32() else pa.array(values, type_))
        return pa.RecordBatch.from_arrays(made, names=["symbol_id", *[name for name, _ in fields]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, room = [], 0, rows
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < room:
                continue
            table = pa.Table.from_batches(waiting)
            codes = codes_of(table)
            # the last symbol may go on; its bars are held whole
            cut = int(np.flatnonzero(np.append(-1, codes[:-1]) != codes)[-1])
            if cut:
                yield whole(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
            waiting, n, room = rest.to_batches(), rest.num_rows, rest.num_rows + rows
        if n:
            yield whole(pa.Table.from_batches(waiting))

    schema = ", ".join([f"symbol_id {kind}", *[f"`{name}` {SQL_TYPES[t]}" for name, t in fields]])
    return bars.select(*names).repartition("symbol_id").sortWithinPartitions("symbol_id", "trade_date").mapInArrow(task, schema)


def series(bars: DataFrame) -> DataFrame:
    """One row per symbol: arrays of the smoothed close, the volume ratio (NaN where unknown) and whether the volume stands out."""
    return searched(bars, "series", lambda x: [dict(n=x.n, smooth=x.smooth, volume_ratio=x.ratio, spike=x.spike)], 1, PROMINENCE, False)


def prominent_points(bars: DataFrame, share: float = PROMINENCE, beside: bool = False) -> DataFrame:
    """symbol_id, trade_date, at, kind and value of each turning point of the smoothed close that is prominent enough."""
    each = lambda x: [dict(trade_date=x.date[k], at=k, kind="peak" if top else "trough", value=x.smooth[k]) for k, top in x.points]
    return searched(bars, "points", each, 1, share, beside)


def _listed(x: Line, families: tuple[str, ...], latest: bool, least_bars: int) -> list[dict]:
    fit = lambda f: f == "ipo_base" or (x.n >= least_bars and not (f == "ascending_triangle" and x.score is not None and not x.score >= 50))
    return [s for f in families or SHAPES if fit(f) for s in signals_of(x, f, latest)]


def shapes(bars: DataFrame, *families: str, latest: bool = False, least_bars: int = LEAST_BARS, share: float = PROMINENCE, beside: bool = False) -> DataFrame:
    """Signals of the named shapes (all by default), one row each; with ``latest`` only those of the last bars.

    Of candidates with one family, state and date the first counts.
    A base on a young listing needs 35 bars only. Triangles need turning points
    counted ``beside`` their neighbours, since two troughs between peaks occur there only. With a column stage2_score in
    the bars, a last score below 50 gives no ascending triangle.
    """
    return searched(bars, "signals", lambda x: _listed(x, families, latest, least_bars), min(least_bars, YOUNG[0]), share, beside)


def broken_tops(bars: DataFrame, least_bars: int = 1) -> DataFrame:
    """One row per symbol whose last close broke the neckline of a head and shoulders top."""
    return searched(bars, "tops", lambda x: [t for t in [head_and_shoulders(x)] if t], least_bars, PROMINENCE, False)


def shapes_or_top(bars: DataFrame, *families: str, latest: bool = False, least_bars: int = LEAST_BARS) -> DataFrame:
    """Signals of the named shapes, but of a symbol whose top is broken only that, as a head_shoulders row; both in one pass."""
    empty = dict.fromkeys(name for name, _ in FIELDS["signals"])

    def each(x: Line) -> list[dict]:
        top = head_and_shoulders(x)
        if top is None:
            return _listed(x, families, latest, least_bars)
        return [empty | dict(family="head_shoulders", state="confirmed", signal_date=top["signal_date"], level=top["neckline"], invalidation=top["invalidation"], quality=50.0, dry=False)]

    return searched(bars, "signals", each, 1, PROMINENCE, False)


def triangle_lines(signals: DataFrame, points: DataFrame) -> DataFrame:
    """Least-squares lines through the peaks and the troughs of each triangle, how many touch, and where the lines meet.

    Signals have symbol_id, family, start_at and end_at; points are those of
    ``prominent_points``. Signals that share no point with others of their symbol
    and place stay apart; a side of fewer than two points has no slope.
    """
    spans = signals.filter(F.col("family").isin("ascending_triangle", "symmetrical_triangle")).select("symbol_id", "family", "start_at", "end_at").distinct()
    met = spans.join(points.select("symbol_id", "at", "kind", "value"), "symbol_id").filter(F.col("at").between(F.col("start_at"), F.col("end_at")))
    y, x = F.col("value"), (F.col("at") - F.col("start_at")).cast("double")
    side = lambda kind, c: F.when(F.col("kind") == kind, c)
    fits = []
    for kind, name in (("peak", "upper"), ("trough", "lower")):
        fits += [F.regr_slope(side(kind, y), side(kind, x)).alias(f"{name}_slope"), F.regr_intercept(side(kind, y), side(kind, x)).alias(f"{name}_start"), F.count_if(F.col("kind") == kind).alias(f"{name}_touches")]
    lines = met.groupBy("symbol_id", "family", "start_at", "end_at").agg(*fits)
    closing = F.col("lower_slope") - F.col("upper_slope")
    return lines.withColumn("apex_at", F.when(closing > 0, F.col("start_at") + (F.col("upper_start") - F.col("lower_start")) / closing))
