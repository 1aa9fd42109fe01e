"""Losses as aggregates: point losses over a residual, weighted or not, with gradients."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions.scalar import NUMPY, SPARK


@dataclass(frozen=True)
class Loss:
    """``point(m, r)`` and ``slope(m, r)`` of the residual r = yhat - y, over the primitives ``m``; ``root`` takes the
    square root of the mean. No rows, or weights that add up to 0, give 0."""

    name: str
    point: Callable
    slope: Callable
    root: bool = False

    def aggregate(self, yhat: Column, y: Column, w: Column | None = None) -> Column:
        return self.finish(*self.parts(yhat, y, w))

    def parts(self, yhat: Column, y: Column, w: Column | None = None) -> tuple[Column, Column]:
        """The two sums of which the loss is made; both can be added up over partitions."""
        point = self.point(SPARK, yhat - y)
        return (F.sum(point), F.count(point).cast("double")) if w is None else (F.sum(point * w), F.sum(w))

    def finish(self, total: Column, weight: Column) -> Column:
        mean = F.when(F.coalesce(weight, F.lit(0.0)) == 0.0, F.lit(0.0)).otherwise(total / F.when(weight == 0.0, F.lit(1.0)).otherwise(weight))
        return F.sqrt(mean) if self.root else mean

    def gradient(self, yhat: Column, y: Column, weight: Column | float, w: Column | None = None, loss: Column | None = None) -> Column:
        """Each row's share in d loss / d yhat, given the sum of weights (and for a root, the loss itself)."""
        own = self.slope(SPARK, yhat - y) if w is None else self.slope(SPARK, yhat - y) * w
        share = SPARK.div(own, weight)
        if not self.root:
            return share
        good = (loss > 0) & ~F.isnan(loss) & (loss < float("inf"))
        return F.when(good, share / (2.0 * F.when(loss > 0, loss).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))

    def whole(self, total: float, weight: float) -> float:
        """As ``finish``, of numbers."""
        mean = total / weight if weight else 0.0
        return float(np.sqrt(mean)) if self.root else mean

    def numpy(self, yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> float:
        with np.errstate(all="ignore"):
            p = self.point(NUMPY, yhat - y)
            weight = float(len(p)) if w is None else float(w.sum())
            mean = float(p.sum() if w is None else (p * w).sum()) / weight if weight else 0.0
            return float(np.sqrt(mean)) if self.root else mean

    def numpy_gradient(self, yhat: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        with np.errstate(all="ignore"):
            own = self.slope(NUMPY, yhat - y) * (1.0 if w is None else w)
            weight = float(len(own)) if w is None else float(w.sum())
            if not weight:
                return np.zeros(len(yhat))
            if not self.root:
                return own / weight
            loss = self.numpy(yhat, y, w)
            return own / (weight * 2.0 * loss) if loss > 0 and np.isfinite(loss) else np.zeros(len(yhat))


def _sgn(m, r):
    return m.where(m.lt(m.num(0.0), r), m.num(1.0), m.where(m.lt(r, m.num(0.0)), m.num(-1.0), r * 0.0))


def mse() -> Loss:
    return Loss("mse", lambda m, r: r * r, lambda m, r: r * 2.0)


def rmse() -> Loss:
    return Loss("rmse", lambda m, r: r * r, lambda m, r: r * 2.0, root=True)


def mae() -> Loss:
    return Loss("mae", lambda m, r: m.abs(r), _sgn)


def huber(delta: float = 1.0) -> Loss:
    inside = lambda m, r: ~m.lt(m.num(delta), m.abs(r))
    return Loss("huber", lambda m, r: m.where(inside(m, r), r * r * 0.5, (m.abs(r) - 0.5 * delta) * delta), lambda m, r: m.where(inside(m, r), r, _sgn(m, r) * delta))


def log_cosh() -> Loss:
    return Loss("log_cosh", lambda m, r: m.log(m.cosh(r)), lambda m, r: m.tanh(r))


def lp(p: float = 2.0) -> Loss:
    return Loss("lp", lambda m, r: m.power(m.abs(r), m.num(p)), lambda m, r: m.where(m.eq(r, m.num(0.0)), m.num(0.0), m.power(m.abs(r), m.num(p - 1.0)) * _sgn(m, r) * p))


def quantile(tau: float = 0.5) -> Loss:
    slope = lambda m, r: m.where(m.lt(r, m.num(0.0)), m.num(-tau), m.where(m.lt(m.num(0.0), r), m.num(1.0 - tau), r * 0.0))
    return Loss("quantile", lambda m, r: m.where(m.lt(m.num(0.0), r), r * (1.0 - tau), r * -tau), slope)


def epsilon_insensitive(epsilon: float = 0.1) -> Loss:
    return Loss("epsilon_insensitive", lambda m, r: m.maximum(m.abs(r) - epsilon, r * 0.0), lambda m, r: m.where(m.lt(m.num(epsilon), m.abs(r)), _sgn(m, r), r * 0.0))


#: The names of losses and their spellings.
_NAMES = {"mse": mse, "mae": mae, "rmse": rmse, "huber": huber, "logcosh": log_cosh, "lp": lp, "quantile": quantile, "epsiloninsensitive": epsilon_insensitive}


def parse_loss(name: str, *parameters: float) -> Loss:
    """A loss by name, in any case, with or without - and _ between words."""
    key = name.strip().lower().replace("-", "").replace("_", "").replace(" ", "")
    if key not in _NAMES:
        raise ValueError(f"unknown loss {name!r}")
    return _NAMES[key](*parameters)


def custom_loss(name: str, point: Callable, slope: Callable) -> Loss:
    return Loss(name, point, slope)


def loss_to_cost(loss: Column, complexity: Column, parsimony: float, baseline: float | Column | None = None, use_baseline: bool = True) -> Column:
    """Loss over the baseline (where that is used, finite and 0.01 or more, else over 0.01), and parsimony per node."""
    scale = F.lit(0.01)
    if use_baseline and baseline is not None:
        b = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
        scale = F.when(~F.isnan(b) & (b < float("inf")) & (b >= 0.01), b).otherwise(F.lit(0.01))
    return loss / scale + complexity * F.lit(float(parsimony))


def cost_of(loss: float, complexity: int, parsimony: float, baseline: float | None) -> float:
    scale = baseline if baseline is not None and np.isfinite(baseline) and baseline >= 0.01 else 0.01
    return loss / scale + parsimony * complexity


def mean_y(y: Column, w: Column | None = None) -> Column:
    """The (weighted) mean; 0 where there are no rows or the weights add up to 0."""
    mean = F.avg(y) if w is None else SPARK.div(F.sum(y * w), F.sum(w))
    empty = F.count(y) == 0 if w is None else F.coalesce(F.sum(w), F.lit(0.0)) == 0
    return F.when(empty, F.lit(0.0)).otherwise(mean)
