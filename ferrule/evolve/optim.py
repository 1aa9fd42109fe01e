"""Optimisers of constants: BFGS, Newton in one dimension, and a backtracking line search.

Each is a generator of trial points: it yields a point, is sent the value and gradient there, and returns the best point
and its value. So one and the same optimiser runs over an objective in memory (``bfgs``, ``newton``) and, with very many
others in step, over objectives that a single scan of all rows answers (``operators.lockstep``).
"""

from __future__ import annotations

from collections.abc import Callable, Generator

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]
Trials = Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float]]


class _Calls:
    """Counts the trials that are left."""

    def __init__(self, limit: int):
        self.left = limit

    def at(self, x: np.ndarray):
        self.left -= 1
        return (yield x)


def line_search(f: _Calls, x: np.ndarray, value: float, slope: float, d: np.ndarray, step: float = 1.0, c1: float = 1e-4):
    """A step that decreases enough (Armijo), shrunk by the minimum of a quadratic, then cubic, model within [0.1, 0.5]
    of the step before; halved first until the value is finite. None if there is no such step."""
    for _ in range(52):
        if f.left <= 0:
            return None
        new, grad = yield from f.at(x + step * d)
        if np.isfinite(new):
            break
        step /= 2
    else:
        return None
    last_step = last_value = None
    for _ in range(60):
        if new <= value + c1 * step * slope:
            return step, new, grad
        if f.left <= 0:
            return None
        if last_step is None:
            to = -slope * step**2 / (2 * (new - value - slope * step))
        else:
            m = np.array([[1 / step**2, -1 / last_step**2], [-last_step / step**2, step / last_step**2]])
            a, b = m @ np.array([new - value - slope * step, last_value - value - slope * last_step]) / (step - last_step)
            root = b * b - 3 * a * slope
            to = -slope / (2 * b) if a == 0 else (-b + np.sqrt(root)) / (3 * a) if root >= 0 else step / 2
        last_step, last_value = step, new
        step = min(max(to if np.isfinite(to) else step / 2, 0.1 * step), 0.5 * step)
        new, grad = yield from f.at(x + step * d)
        if not np.isfinite(new):
            new = np.inf
    return None


def bfgs_trials(start: np.ndarray, iterations: int = 8, f_calls: int = 10_000, g_tol: float = 1e-8) -> Trials:
    """Quasi-Newton descent; the inverse Hessian starts anew where it gives no descent."""
    f = _Calls(f_calls)
    x = np.array(start, float)
    value, g = yield from f.at(x)
    h = np.eye(len(x))
    for _ in range(iterations):
        if not np.isfinite(value) or not np.isfinite(g).all() or np.abs(g).max() <= g_tol or f.left <= 0:
            break
        d = -h @ g
        if d @ g >= 0 or not np.isfinite(d).all():
            h, d = np.eye(len(x)), -g
        found = yield from line_search(f, x, value, float(d @ g), d)
        if found is None:
            break
        step, value, new_g = found
        s, y = step * d, new_g - g
        x, g = x + s, new_g
        sy = float(s @ y)
        if sy > 1e-12:
            r = np.eye(len(x)) - np.outer(s, y) / sy
            h = r @ h @ r.T + np.outer(s, s) / sy
            h = (h + h.T) / 2
        else:
            h = np.eye(len(x))
    return x, value


def newton_trials(start: np.ndarray, iterations: int = 8, f_calls: int = 10_000, g_tol: float = 1e-8) -> Trials:
    """Newton's method for one constant; the second derivative is a difference of gradients."""
    f = _Calls(f_calls)
    x = float(start[0])
    value, g = yield from f.at(np.array([x]))
    for _ in range(iterations):
        g0 = float(g[0])
        if not np.isfinite(value) or not np.isfinite(g0) or abs(g0) <= g_tol or f.left <= 0:
            break
        e = 1e-6 * max(1.0, abs(x))
        _, beside = yield from f.at(np.array([x + e]))
        second = (float(beside[0]) - g0) / e
        if not np.isfinite(second) or abs(second) < 1e-12:
            second = 1e-12
        d = -g0 / second
        if d * g0 >= 0:
            d = -g0
        found = yield from line_search(f, np.array([x]), value, d * g0, np.array([d]))
        if found is None:
            break
        x, value, g = x + found[0] * d, found[1], found[2]
    return np.array([x]), value


def trials_of(start: np.ndarray, iterations: int = 8, f_calls: int = 10_000) -> Trials:
    """Newton's method for one constant, BFGS for more."""
    return (newton_trials if len(start) == 1 else bfgs_trials)(start, iterations, f_calls)


def answered(trials: Trials, objective: Objective) -> tuple[np.ndarray, float]:
    """What the trials end with when each is answered by the objective."""
    try:
        x = next(trials)
        while True:
            x = trials.send(objective(x))
    except StopIteration as end:
        return end.value


def bfgs(objective: Objective, start: np.ndarray, iterations: int = 8, f_calls: int = 10_000, g_tol: float = 1e-8) -> tuple[np.ndarray, float]:
    return answered(bfgs_trials(start, iterations, f_calls, g_tol), objective)


def newton(objective: Objective, start: float, iterations: int = 8, f_calls: int = 10_000, g_tol: float = 1e-8) -> tuple[float, float]:
    x, value = answered(newton_trials(np.array([start]), iterations, f_calls, g_tol), objective)
    return float(x[0]), value
