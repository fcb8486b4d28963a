"""Numpy kernels over one block of an ordered series (NaN stands for NULL).

Trailing windows cost O(n) whatever their length: the block is cut into strips of
``k`` rows, and a window is the end of one strip plus the start of the next.
Sums are only ever added, never taken back, so nothing cancels; squares are
centred per strip and merged pairwise; a window of equal values has exactly
that mean and no variance.  ``place`` holds the rows' places in their own series, where
several series lie one after the other: strips, windows and lags end at a series' first row.
"""

from __future__ import annotations

import numpy as np


def shifted(x: np.ndarray, j: int, place: np.ndarray | None = None) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if j < len(x):
        out[j:] = x[: len(x) - j]
    if place is not None:
        out[place < j] = np.nan
    return out


class _Strips:
    """Running sums from the start and from the end of every strip of ``k`` rows."""

    def __init__(self, k: int, valid: np.ndarray, place: np.ndarray | None = None):
        place = np.arange(len(valid)) if place is None else place
        self.k = k = min(k, int(place.max(initial=0)) + 1)  # a window never reaches beyond a series
        first = np.flatnonzero(place == 0)
        size = np.diff(np.append(first, len(valid)))
        strips = -(-size // k)
        self.first = np.cumsum(strips) - strips  # the first strip of every series
        self.rows = int(strips.sum())
        self.slot = np.repeat(self.first * k, size) + place
        self.valid = self.cut(valid, False)
        self.n_a, self.n_b = self.halves(self.valid.astype(float))
        self.count = self.n_a + self.n_b

    def cut(self, v: np.ndarray, fill) -> np.ndarray:
        out = np.full(self.rows * self.k, fill, v.dtype)
        out[self.slot] = v
        return out.reshape(self.rows, self.k)

    def halves(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every window: the part in the strip before, and the part in its own strip."""
        own = np.cumsum(z, 1)
        before = np.zeros_like(z)
        if self.rows > 1:
            before[1:, :-1] = np.cumsum(z[:-1, ::-1], 1)[:, ::-1][:, 1:]
            before[self.first] = 0.0
        return before, own

    def centre(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first valid value of every strip (no row depends on later ones), and the deviations from it."""
        v = np.where(self.valid, self.cut(v, 0.0), 0.0)
        c = np.take_along_axis(v, self.valid.argmax(1)[:, None], 1)
        return c, np.where(self.valid, v - c, 0.0)

    def cross(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum of products of deviations from the window's means."""
        cx, zx = self.centre(x)
        cy, zy = (cx, zx) if y is x else self.centre(y)
        na, nb = np.maximum(self.n_a, 1), np.maximum(self.n_b, 1)
        (xa, xb), (ya, yb), (pa, pb) = self.halves(zx), self.halves(zy), self.halves(zx * zy)
        up = lambda c: np.concatenate([c[:1], c[:-1]])  # noqa: E731 - the strip before
        dx = (cx + xb / nb) - (up(cx) + xa / na)
        dy = (cy + yb / nb) - (up(cy) + ya / na)
        both = self.n_a * self.n_b / np.maximum(self.count, 1)
        return (pa - xa * ya / na) + (pb - xb * yb / nb) + dx * dy * both

    def flat(self, v: np.ndarray) -> np.ndarray:
        return v.reshape(-1)[self.slot]


def _differs(x: np.ndarray, valid: np.ndarray, k: int, place: np.ndarray | None = None) -> np.ndarray:
    """True where the trailing ``k`` rows hold two different valid values."""
    at = np.flatnonzero(valid)
    last = np.full(len(x), -1)
    if place is not None:
        last = np.where(place == 0, np.arange(len(x)) - 1, -1)  # what changed in the series before does not count
        series = np.cumsum(place == 0)
        new = (x[at[1:]] != x[at[:-1]]) & (series[at[1:]] == series[at[:-1]])
    else:
        new = x[at[1:]] != x[at[:-1]]
    change = np.flatnonzero(new)
    last[at[change + 1]] = at[change]
    return np.maximum.accumulate(last) > np.arange(len(x)) - k if len(x) else last > 0


def trailing(x: np.ndarray, k: int, min_periods: int | None = None, place: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """``mean``, ``std`` (sample) and ``sum`` of the trailing ``k`` rows."""
    valid = ~np.isnan(x)
    s = _Strips(k, valid, place)
    n = s.flat(s.count)
    total = s.flat(sum(s.halves(np.where(s.valid, s.cut(x, 0.0), 0.0))))
    ok = n >= max(k if min_periods is None else min_periods, 1)
    with np.errstate(all="ignore"):
        var = np.maximum(s.flat(s.cross(x, x)), 0) / np.maximum(n - 1, 1)
        std = np.where(_differs(x, valid, k, place), np.sqrt(var), 0.0)
        return {"mean": np.where(ok, total / n, np.nan), "sum": np.where(ok, total, np.nan),
                "std": np.where(ok & (n > 1), std, np.nan)}


def trailing_corr(x: np.ndarray, y: np.ndarray, k: int, min_periods: int | None = None, place: np.ndarray | None = None) -> np.ndarray:
    """Pearson correlation of the trailing ``k`` rows where both are present."""
    valid = ~np.isnan(x) & ~np.isnan(y)
    x, y = np.where(valid, x, np.nan), np.where(valid, y, np.nan)
    s = _Strips(k, valid, place)
    n = s.flat(s.count)
    with np.errstate(all="ignore"):
        r = s.flat(s.cross(x, y)) / np.sqrt(s.flat(s.cross(x, x))) / np.sqrt(s.flat(s.cross(y, y)))
    ok = (n >= max(k if min_periods is None else min_periods, 2)) & _differs(x, valid, k, place) & _differs(y, valid, k, place)
    return np.where(ok & np.isfinite(r), r, np.nan)


def rate(x: np.ndarray, k: int, place: np.ndarray | None = None) -> np.ndarray:
    """x / lag(x, k) - 1; NaN for a zero or missing base."""
    base = shifted(x, k, place)
    with np.errstate(all="ignore"):
        out = np.where(base != 0, x / base, np.nan) - 1
    out[~np.isfinite(out)] = np.nan
    return out


def affine(c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the maps ``v -> c v + d`` up to every place, by doubling."""
    c, d, step = c.copy(), d.copy(), 1
    while step < len(c):
        d[step:] += c[step:] * d[:-step]
        c[step:] = c[step:] * c[:-step]
        step *= 2
    return c, d


# ------------------------------------------------------------------------ EWM
#
# The state between blocks is (last place with a value, mean, weight); the
# weight is that of all earlier values against a new one (always 1 without
# ``adjust``, as pandas keeps it).


def _means(v: list, w: list, a: float, mean: float) -> list:
    """The mean after every value, ``w`` being the weight of the mean before it."""
    out = []
    for x, g in zip(v, w):
        if mean != x:  # a constant series stays exactly constant
            mean = (g * mean + a * x) / (g + a)
        out.append(mean)
    return out


def _sums(v: list, w: list, num: float, den: float) -> tuple[list, float]:
    """Weighted sum over weights after every value, and the last weight."""
    out = []
    for x, g in zip(v, w):
        num, den = num * g + x, den * g + 1.0
        out.append(num / den)
    return out, den


def ewm(x: np.ndarray, at: np.ndarray, a: float, adjust: bool, state: tuple) -> tuple[np.ndarray, tuple]:
    """Exponentially weighted mean at every row (``at`` are the rows' places), and the state after.

    The recursion runs over the values alone, in the order of pandas, so that
    differences of means that nearly cancel agree with it to the last bits."""
    last, mean, weight = state
    have = np.flatnonzero(~np.isnan(x))
    out = np.full(len(x), np.nan if mean is None else mean)
    if not len(have):
        return out, state
    v, pos = x[have].tolist(), at[have]
    w = ((1.0 - a) ** np.diff(pos, prepend=pos[0] if last is None else last).astype(float)).tolist()
    if adjust:
        m, weight = _sums(v, w, 0.0 if mean is None else mean * weight, weight if mean is not None else 0.0)
    else:
        m, weight = _means(v, w, a, v[0] if mean is None else mean), 1.0
    since = np.cumsum(~np.isnan(x)) - 1
    out[have[0]:] = np.array(m)[since[have[0]:]]
    return out, (int(pos[-1]), m[-1], weight)
