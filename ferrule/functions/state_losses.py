"""Losses that no mean of points gives: mergeable states.

A loss is given by what a state begins as, how it takes in a batch of rows, how two states merge, and the loss of a finished
state; and, for optimisers, by the slope of each row once the state of all rows is known. States are vectors of doubles
of a fixed length. Tasks make one for each formula (or group), and these are merged in a tree, so any data is one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class StateLoss:
    """``update(state, yhat, y, w)`` (w: None without weights), ``merge(a, b)``, ``finish(state)``, and
    ``slope(state, yhat, y, w)``, d loss / d yhat of each row. ``init`` is the state of no rows."""

    name: str
    init: tuple[float, ...]
    update: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float]
    slope: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray] | None = None

    def empty(self) -> np.ndarray:
        return np.array(self.init, float)

    def numpy(self, yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> float:
        with np.errstate(all="ignore"):
            return float(self.finish(self.update(self.empty(), yhat, y, w)))

    def numpy_gradient(self, yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        if self.slope is None:
            raise ValueError(f"{self.name} has no slope")
        with np.errstate(all="ignore"):
            return self.slope(self.update(self.empty(), yhat, y, w), yhat, y, w)


#: Places in the state of centred moments: weight, means of y and yhat, sums of squares and of products about them, and
#: the sum of squared errors.
W, MY, MP, YY, PP, YP, EE = range(7)


def moments(yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    if not len(y):
        return np.zeros(7)
    w = np.ones(len(y)) if w is None else w
    total = float(w.sum())
    if total == 0:
        return np.zeros(7)
    my, mp = float((w * y).sum()) / total, float((w * yhat).sum()) / total
    dy, dp = y - my, yhat - mp
    return np.array([total, my, mp, (w * dy * dy).sum(), (w * dp * dp).sum(), (w * dy * dp).sum(), (w * (yhat - y) ** 2).sum()])


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments about the means of both: they merge without losing digits to a large offset."""
    total = a[W] + b[W]
    if total == 0 or a[W] == 0:
        return b.copy()
    if b[W] == 0:
        return a.copy()
    share, part = b[W] / total, a[W] * b[W] / total
    dy, dp = b[MY] - a[MY], b[MP] - a[MP]
    return np.array([total, a[MY] + dy * share, a[MP] + dp * share, a[YY] + b[YY] + dy * dy * part, a[PP] + b[PP] + dp * dp * part, a[YP] + b[YP] + dy * dp * part, a[EE] + b[EE]])


def _update_moments(state: np.ndarray, yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    return merged_moments(state, moments(yhat, y, w))


def _weight(w: np.ndarray | None) -> np.ndarray | float:
    return 1.0 if w is None else w


def r2_loss() -> StateLoss:
    """1 - R²: squared errors over the squares of y about its mean; 1 where y doesn't vary, 0 without rows."""

    def finish(s: np.ndarray) -> float:
        return 0.0 if s[W] == 0 else float(s[EE] / s[YY]) if s[YY] > 0 else 1.0

    def slope(s: np.ndarray, yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        return 2.0 * _weight(w) * (yhat - y) / s[YY] if s[YY] > 0 else np.zeros(len(y))

    return StateLoss("r2", (0.0,) * 7, _update_moments, merged_moments, finish, slope)


def correlation_loss() -> StateLoss:
    """1 - the (weighted) correlation of yhat and y; 1 where either doesn't vary, 0 without rows."""

    def root(s: np.ndarray) -> float:
        return float(np.sqrt(s[YY]) * np.sqrt(s[PP]))

    def finish(s: np.ndarray) -> float:
        return 0.0 if s[W] == 0 else 1.0 - float(s[YP]) / root(s) if root(s) > 0 else 1.0

    def slope(s: np.ndarray, yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        if root(s) == 0:
            return np.zeros(len(y))
        return -_weight(w) * ((y - s[MY]) - s[YP] / s[PP] * (yhat - s[MP])) / root(s)

    return StateLoss("correlation", (0.0,) * 7, _update_moments, merged_moments, finish, slope)
