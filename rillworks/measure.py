"""Repeated timings, and a gate that asks whether the slower trials could be chance.

A run counts as slower where every ranking of the two runs' trials that is at least as bad has a
probability of CHANCE or less if both came from one distribution (an exact one-sided rank-sum
test), and the medians differ by NOTICEABLE or more: below that a difference is real but of no use.
"""

from __future__ import annotations

import itertools
import math
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass

CHANCE = 0.05
#: A timer tick, a garbage collection or a page cache miss moves a 100 ms job by some 5 ms.
NOTICEABLE = 0.05


@dataclass(frozen=True)
class Timing:
    name: str
    seconds: tuple[float, ...]
    rows: int = 0

    @property
    def median(self) -> float:
        return statistics.median(self.seconds)

    @property
    def spread(self) -> float:
        """The middle half of the trials over the median (all of them, where there are few)."""
        low, high = min(self.seconds), max(self.seconds)
        if len(self.seconds) >= 4:
            low, _, high = statistics.quantiles(self.seconds, n=4)
        return (high - low) / self.median

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.median


def measure(name: str, action: Callable[[], object], rows: int = 0, warmup: int = 1, trials: int = 3) -> Timing:
    for _ in range(warmup):
        action()
    took = []
    for _ in range(trials):
        began = time.perf_counter()
        action()
        took.append(time.perf_counter() - began)
    return Timing(name, tuple(took), rows)


def chance_of_ranks(new: tuple[float, ...], old: tuple[float, ...]) -> float:
    """The share of all ways to deal the trials' ranks in which the new ones rank as high in total, or higher.

    Equal times share a rank.  Beyond 12 trials a side the normal approximation stands in.
    """
    pooled = sorted((*new, *old))
    rank = {t: pooled.index(t) + (pooled.count(t) + 1) / 2 for t in set(pooled)}
    total, n, m = sum(rank[t] for t in new), len(new), len(old)
    if max(n, m) <= 12 and math.comb(n + m, n) <= 200_000:
        sums = [sum(some) for some in itertools.combinations([rank[t] for t in pooled], n)]
        return sum(s >= total - 1e-9 for s in sums) / len(sums)
    mean, sd = n * (n + m + 1) / 2, math.sqrt(n * m * (n + m + 1) / 12)
    return 0.5 * math.erfc((total - mean - 0.5) / (sd * math.sqrt(2)))


def regressed(new: Timing, old: Timing) -> bool:
    """Whether `new` is slower by a noticeable share that its trials' ranks don't leave to chance."""
    return new.median >= old.median * (1 + NOTICEABLE) and chance_of_ranks(new.seconds, old.seconds) <= CHANCE
