"""Order-dependent statistics as reducers: step(row) updates a reducer and gives the row's output.

A reducer's state is plain Python data, so the same class runs in batch and in a stream. Values may be None."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from typing import Protocol


class Ewma:
    """Exponential mean and variance: both moments start at 0; the variance is n (E[x2] - m2) / (n - 1) from two values on."""

    FIELDS = "mean double, variance double"

    def __init__(self, alpha: float = 0.3):
        self.alpha, self.n, self.m, self.s = alpha, 0, 0.0, 0.0

    def step(self, x: float | None):
        if x is not None:
            self.n += 1
            self.m = (1 - self.alpha) * self.m + self.alpha * x
            self.s = (1 - self.alpha) * self.s + self.alpha * x * x
        return self.m, self.n * (self.s - self.m * self.m) / (self.n - 1) if self.n > 1 else 0.0


class Digest:
    """Sorted centroids; neighbours merge from the left while their weight is within delta of the total."""

    FIELDS = "minimum double, q1 double, median double, q3 double, maximum double"

    def __init__(self, delta: float = 0.1):
        self.delta, self.total = delta, 0
        self.means: list[float] = []
        self.weights: list[int] = []

    def update(self, x: float) -> None:
        k = bisect_left(self.means, x)
        self.means.insert(k, x)
        self.weights.insert(k, 1)
        self.total += 1
        limit = self.delta * self.total
        means, weights = [self.means[0]], [self.weights[0]]
        for m, w in zip(self.means[1:], self.weights[1:], strict=True):
            both = weights[-1] + w
            if both <= limit:
                means[-1] = (means[-1] * weights[-1] + m * w) / both
                weights[-1] = both
            else:
                means.append(m)
                weights.append(w)
        self.means, self.weights = means, weights

    def percentiles(self, qs: list[float]) -> list[float | None]:
        """For each of the ascending qs, the mean of the first centroid at which the cumulative weight reaches q percent; the ends for 0 and 100."""
        if not self.means:
            return [None] * len(qs)
        out, k, seen = [], 0, self.weights[0]
        for q in qs:
            if q <= 0 or q >= 100:
                out.append(self.means[0 if q <= 0 else -1])
                continue
            need = q / 100 * self.total
            while seen < need and k + 1 < len(self.means):
                k += 1
                seen += self.weights[k]
            out.append(self.means[k])
        return out

    def percentile(self, q: float) -> float | None:
        return self.percentiles([q])[0]

    def step(self, x: float | None):
        if x is not None:
            self.update(x)
        return tuple(self.percentiles([0, 25, 50, 75, 100]))


class GlobalOutlier:
    """Whether a novelty is outside the fences of all before it; exact with delta None, else by a digest."""

    FIELDS = "q1 double, q3 double, flag boolean"

    def __init__(self, delta: float | None = 0.1, fence: float = 1.5):
        self.fence, self.digest, self.seen = fence, Digest(delta) if delta else None, []

    def _quartiles(self):
        if self.digest:
            return self.digest.percentiles([25, 75])
        return tuple(linear_quantile(self.seen, q) if self.seen else None for q in (0.25, 0.75))

    def step(self, x: float | None):
        q1, q3 = self._quartiles()
        flag = beyond(x, q1, q3, self.fence)
        if x is not None:
            self.digest.update(x) if self.digest else insort(self.seen, x)
        return q1, q3, flag


class LossyCounting:
    """Counts of values tied within eps_tie, pruned at the end of each bucket of ceil(1 / epsilon) values.

    A count's error bound is the number of full buckets before it was first kept; as long as that is 0, later hits set it anew."""

    FIELDS = "tie long, tie_count long, groups long"

    def __init__(self, epsilon: float = 0.01, eps_tie: float = 1.0):
        self.eps_tie, self.width, self.n = eps_tie, math.ceil(1 / epsilon), 0
        self.kept: dict[int, list[int]] = {}

    def add(self, x: float, eps_tie: float | None = None) -> int:
        self.n += 1
        key, bucket = math.floor(x / (eps_tie or self.eps_tie)), math.ceil(self.n / self.width)
        if key in self.kept:
            kept = self.kept[key]
            kept[0] += 1
            kept[1] = kept[1] or bucket - 1
        else:
            self.kept[key] = [1, bucket - 1]
        if self.n % self.width == 0:
            self.kept = {k: c for k, c in self.kept.items() if sum(c) > bucket}
        return key

    def ties(self) -> list[int]:
        return [c for c, _ in self.kept.values() if c > 1]

    def step(self, x: float | None):
        if x is None:
            return None, None, len(self.ties())
        key = self.add(x)
        return key, self.kept.get(key, [0])[0], len(self.ties())


class MannKendall:
    """Approximate trend: S sums length * (2 cdf(x) - 1) by a digest's quantiles, reset after every `window` values.

    The digest lives on over resets. type is 1, -1 or 0 at the level alpha."""

    FIELDS = "s double, z double, p double, type int"

    def __init__(self, delta: float = 0.06, step: int = 5, window: int = 100, rel_tol: float = 0.01, alpha: float = 0.05):
        self.digest, self.grid = Digest(delta), list(range(step, 100, step))
        self.window, self.rel_tol, self.alpha = window, rel_tol, alpha
        self._reset()

    def _reset(self) -> None:
        self.n, self.s, self.low, self.high = 0, 0.0, math.inf, -math.inf
        self.ties = LossyCounting(0.1)

    def _cdf(self, x: float) -> float:
        q = self.digest.percentiles(self.grid)
        if x <= q[0]:
            return 0.0
        if x >= q[-1]:
            return 1.0
        k = bisect_left(q, x)
        a, b = q[k - 1], q[k]
        share = (x - a) / (b - a) if b > a else 0.0
        return (self.grid[k - 1] + share * (self.grid[k] - self.grid[k - 1])) / 100

    def step(self, x: float | None):
        if x is not None:
            if self.n and self.n % self.window == 0:
                self._reset()
            self.n += 1
            self.low, self.high = min(self.low, x), max(self.high, x)
            self.digest.update(x)
            self.ties.add(x, max((self.high - self.low) * self.rel_tol, 1e-8))
            if self.n > len(self.grid):
                self.s += self.n * (2 * self._cdf(x) - 1)
        n = self.n
        var = (n * (n - 1) * (2 * n + 5) - sum(t * (t - 1) * (2 * t + 5) for t in self.ties.ties())) / 18
        if n <= len(self.grid) or var <= 0:
            return self.s, None, None, 0
        z = (self.s - math.copysign(1, self.s)) / math.sqrt(var) if self.s else 0.0
        p = 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2))))
        return self.s, z, p, (1 if self.s > 0 else -1) if p < self.alpha else 0


class TrendDriver:
    """A topic's exponential statistics, quantiles and trend from one digest; nothing for a missing value.

    compat_sentinel: missing values enter as the sentinel, as in a feed that does not tell them apart."""

    FIELDS = "mean double, variance double, minimum double, q1 double, median double, q3 double, maximum double, s double, type int"

    def __init__(self, delta: float = 0.06, alpha: float = 0.1, compat_sentinel: bool = False, sentinel: float = -200.0):
        self.trend, self.moving, self.missing = MannKendall(delta), Ewma(alpha), sentinel if compat_sentinel else None

    def step(self, x: float | None):
        x = self.missing if x is None else x
        if x is None:
            return (None,) * 9
        s, _, _, kind = self.trend.step(x)
        return *self.moving.step(x), *self.trend.digest.percentiles([0, 25, 50, 75, 100]), s, kind


class Estimator(Protocol):
    """What AnomalyDetector asks of an estimator."""

    def predict(self, train: list[float | None], x: float | None) -> bool:
        """Whether x is an outlier, train being the window's earlier scores."""

    def update(self, x: float | None) -> None:
        """Learns x, after it has been judged."""


class AnomalyDetector:
    """A window's novelty and the three detectors on its last element, one row at a time.

    The estimators can be replaced: `novelty_of` takes the window and gives its scores; `local` and `far` follow Estimator.
    Until `size` rows have been seen they learn but do not flag."""

    FIELDS = "novelty double, missing boolean, local boolean, global boolean"

    def __init__(self, size: int = 8, novelty_of: Callable | None = None, local: Estimator | None = None, far: Estimator | None = None):
        self.size, self.window = size, []
        self.novelty_of, self.local, self.far = novelty_of or novelty_of_window, local or FencedWindow(), far or FencedDigest()

    def step(self, x: float | None):
        self.window = [*self.window, x][-self.size :]
        scores = self.novelty_of(self.window)
        *train, last = scores
        ready = len(self.window) >= self.size
        found = last, ready and last is None, ready and self.local.predict(train, last), ready and self.far.predict(train, last)
        self.local.update(last)
        self.far.update(last)
        return found


def novelty_of_window(window: list[float | None]) -> list[float | None]:
    """First differences with missing values replaced by the window's median and set missing again; the first is 0."""
    present = sorted(x for x in window if x is not None)
    if not present:
        return window
    middle = linear_quantile(present, 0.5)
    filled = [middle if x is None else x for x in window]
    return [None if x is None else 0.0 if not i else x - filled[i - 1] for i, x in enumerate(window)]


def linear_quantile(ordered: list[float], q: float) -> float:
    """Quantile by linear interpolation, rounded as DuckDB does."""
    p = q * (len(ordered) - 1)
    d = p - math.floor(p)
    a, b = ordered[math.floor(p)], ordered[math.ceil(p)]
    return math.fma(a, 1 - d, b * d) if d else a


def beyond(x: float | None, q1: float | None, q3: float | None, fence: float) -> bool:
    return x is not None and q1 is not None and not q1 - fence * (q3 - q1) <= x <= q3 + fence * (q3 - q1)


class FencedWindow:
    """Fences of the window's earlier scores; one missing among them silences it."""

    def __init__(self, fence: float = 1.5):
        self.fence = fence

    def predict(self, train: list[float | None], x: float | None) -> bool:
        if not train or any(v is None for v in train):
            return False
        s = sorted(train)
        return beyond(x, linear_quantile(s, 0.25), linear_quantile(s, 0.75), self.fence)

    def update(self, x: float | None) -> None:
        pass


class FencedDigest:
    """Fences of all scores before, by a digest."""

    def __init__(self, delta: float = 0.1, fence: float = 1.5):
        self.digest, self.fence = Digest(delta), fence

    def predict(self, train: list[float | None], x: float | None) -> bool:
        return beyond(x, *self.digest.percentiles([25, 75]), self.fence)

    def update(self, x: float | None) -> None:
        if x is not None:
            self.digest.update(x)


class FencedHistory:
    """Fences of all scores before, exactly; keeps them all."""

    def __init__(self, fence: float = 1.5):
        self.seen, self.fence = [], fence

    def predict(self, train: list[float | None], x: float | None) -> bool:
        return bool(self.seen) and beyond(x, linear_quantile(self.seen, 0.25), linear_quantile(self.seen, 0.75), self.fence)

    def update(self, x: float | None) -> None:
        if x is not None:
            insort(self.seen, x)


class RecentAnomaly:
    """z among the last rows and quantiles of the last present values, the row's own included.

    A row is flagged if |z| reaches the limit or its value is outside the quantiles. z and the statistics are NULL without
    two present values among the last rows; a missing value is never flagged."""

    FIELDS = "z double, recent_mean double, recent_std double, q_low double, q_high double, flag boolean"

    def __init__(self, last: int = 6, limit: float = 3.5, kept: int = 5000, high: float = 0.995):
        self.last, self.limit, self.kept, self.high = last, limit, kept, high
        self.recent: list[float | None] = []
        self.ordered: list[float] = []
        self.queue: deque[float] = deque()

    def step(self, x: float | None):
        self.recent = [*self.recent, x][-self.last :]
        if x is not None:
            self.queue.append(x)
            insort(self.ordered, x)
            if len(self.queue) > self.kept:
                del self.ordered[bisect_left(self.ordered, self.queue.popleft())]
        present = [v for v in self.recent if v is not None]
        z = mean = std = None
        if len(present) >= 2:
            mean = sum(present) / len(present)
            std = math.sqrt(sum((v - mean) ** 2 for v in present) / len(present))
            z = None if x is None else (x - mean) / std if std > 0 else 0.0
        low, high = (linear_quantile(self.ordered, q) for q in (1 - self.high, self.high)) if self.ordered else (None, None)
        flag = x is not None and mean is not None and (abs(z) >= self.limit or x > high or x < low)
        return z, mean, std, low, high, flag


class OnlineForecast:
    """Linear model by stochastic gradient on scaled features: each row first trains on its value, then is predicted.

    The features are lags, rolling statistics, calendar columns and covariates; missing ones are 0. Without a trained model
    the last present value is the prediction. It is clamped to the recent band, and replaced by the mean of the last five
    if it is over two deviations away. NULL until seven rows have been seen."""

    FIELDS = "online_pred double"
    LAGS, ROLLS, NEEDS = (1, 2, 3, 6), (3, 6), 7

    def __init__(self, others: int = 0, rate: float = 0.05, l2: float = 1e-4):
        k = len(self.LAGS) + 2 * len(self.ROLLS) + others
        self.rate, self.l2 = rate, l2
        self.w, self.b, self.n, self.trained = [0.0] * k, 0.0, 0, 0
        self.mean, self.m2 = [0.0] * k, [0.0] * k
        self.target = [0, 0.0, 0.0]
        self.rows: list[float | None] = []
        self.valid: list[float] = []
        self.pending: list[float] | None = None

    def _scaled(self, x: list[float]) -> list[float]:
        return [(v - m) / (math.sqrt(s / max(self.n, 1)) or 1.0) for v, m, s in zip(x, self.mean, self.m2, strict=True)]

    def _see(self, x: list[float]) -> None:
        self.n += 1
        for i, v in enumerate(x):
            d = v - self.mean[i]
            self.mean[i] += d / self.n
            self.m2[i] += d * (v - self.mean[i])

    def _unit(self) -> float:
        return math.sqrt(self.target[2] / max(self.target[0], 1)) or 1.0

    def _train(self, x: list[float], y: float) -> None:
        self._see(x)
        self.target[0] += 1
        d = y - self.target[1]
        self.target[1] += d / self.target[0]
        self.target[2] += d * (y - self.target[1])
        z = self._scaled(x)
        e = self.b + sum(a * b for a, b in zip(self.w, z, strict=True)) - (y - self.target[1]) / self._unit()
        step, e = self.rate / math.sqrt(1 + 0.01 * self.trained), max(-5.0, min(5.0, e))
        self.w = [w - step * (e * v + self.l2 * w) for w, v in zip(self.w, z, strict=True)]
        self.b -= step * e
        self.trained += 1

    def _features(self, others: tuple) -> list[float]:
        back = self.rows[::-1]
        out = [back[k] for k in self.LAGS]
        for r in self.ROLLS:
            v = [x for x in back[1 : r + 1] if x is not None]
            m = sum(v) / len(v) if v else None
            out += [m, math.sqrt(sum((x - m) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None]
        return [0.0 if v is None else float(v) for v in (*out, *others)]

    def step(self, x: float | None, *others):
        self.rows = [*self.rows, x][-self.NEEDS :]
        if x is not None:
            self.valid = [*self.valid, x][-6:]
        if len(self.rows) < self.NEEDS:
            return (None,)
        if x is not None and self.pending is not None:
            self._train(self.pending, x)
        self.pending = self._features(others)
        if not self.valid:
            return (None,)
        mu = sum(self.valid) / len(self.valid)
        sd = math.sqrt(sum((v - mu) ** 2 for v in self.valid) / len(self.valid))
        p = self.valid[-1]
        if self.trained:
            self._see(self.pending)
            p = (self.b + sum(a * b for a, b in zip(self.w, self._scaled(self.pending), strict=True))) * self._unit() + self.target[1]
            p = min(max(p, min(mu - 3 * sd, min(self.valid))), max(mu + 3 * sd, 1.3 * max(self.valid)))
        five = self.valid[-5:]
        return (sum(five) / len(five),) if abs(p - mu) > (2 * sd if sd > 0 else 0.1 * abs(mu)) else (p,)
