"""Expressions as DataFrame plans and as NumPy programs.

On a DataFrame, each operator becomes a named column, level by level of the tree. Columns that an operator uses twice
are thus computed once, and the plan grows with the tree and not with the product of such uses. Catalyst merges the
levels where that is cheap, and all of them run in one stage of generated code over a scan of the needed features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.scalar import NUMPY, SPARK, Op
from ferrule.plans.expr import Const, Expr, Var


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


class _Levels:
    """Columns to be added, grouped by the level at which their inputs exist."""

    def __init__(self, prefix: str):
        self.prefix, self.levels, self.n = prefix, [], 0

    def put(self, level: int, column: Column) -> str:
        name = f"{self.prefix}{self.n}"
        self.n += 1
        while len(self.levels) < level:
            self.levels.append({})
        self.levels[level - 1][name] = column
        return name

    def onto(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = df.withColumns(level)
        return df

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]


def _walk(expr: Expr, features: Sequence[str], levels: _Levels, directions: Sequence[tuple[str, int]] = ()):
    """Column, level, derivative columns (None where zero) and the columns to be checked."""
    checked: list[Column] = []

    def leaf(node):
        if isinstance(node, Var):
            value, key = F.col(features[node.feature]).cast("double"), ("var", node.feature)
        else:
            value, key = F.lit(expr.consts[node.slot]), ("const", node.slot)
        return value, 0, [F.lit(1.0) if d == key else None for d in directions]

    def op(node: Op, args):
        level = 1 + max(a[1] for a in args)
        value = F.col(levels.put(level, node.value(SPARK, *(a[0] for a in args))))
        checked.append(value)
        partials: dict[int, Column] = {}
        out = []
        for k in range(len(directions)):
            terms = []
            for i, a in enumerate(args):
                if a[2][k] is not None:  # a zero direction costs nothing
                    if i not in partials:
                        partials[i] = F.col(levels.put(level, node.partial(SPARK, i, *(b[0] for b in args))))
                    terms.append(partials[i] * a[2][k])
            if not terms:
                out.append(None)
                continue
            out.append(F.col(levels.put(level + 1, sum(terms[1:], terms[0]))))
        return value, level + bool(directions), out

    value, _, grads = expr.fold(leaf, op)
    if not checked and isinstance(expr.nodes[0], Const):
        checked.append(value)  # a constant alone is checked, a feature alone is not
    return value, grads, checked


def evaluate(df: DataFrame, expr: Expr, features: Sequence[str], out: str = "yhat", ok: str = "ok", check: bool = True) -> DataFrame:
    """``df`` with the value of ``expr`` and whether each operator's value on the row is finite; true without ``check``."""
    expr.validate(len(features))
    levels = _Levels(f"__{out}_")
    value, _, checked = _walk(expr, features, levels)
    good = F.lit(True)
    for c in checked if check else ():
        good = good & finite(c)
    return levels.onto(df).withColumns({out: value, ok: good}).drop(*levels.names)


def complete(df: DataFrame, ok: str = "ok") -> Column:
    """Whether an expression is finite throughout, as an aggregate of its row flags; true for no rows."""
    return F.coalesce(F.every(ok), F.lit(True))


def differentiate(df: DataFrame, expr: Expr, features: Sequence[str], feature: int, out: str = "yhat", derivative: str = "dyhat", ok: str = "ok") -> DataFrame:
    """The value, its derivative with respect to one feature, and the row's flag."""
    expr.validate(len(features))
    levels = _Levels(f"__{out}_")
    value, grads, checked = _walk(expr, features, levels, [("var", feature)])
    good = F.lit(True)
    for c in checked:
        good = good & finite(c)
    return levels.onto(df).withColumns({out: value, derivative: F.lit(0.0) if grads[0] is None else grads[0], ok: good}).drop(*levels.names)


def gradient(df: DataFrame, expr: Expr, features: Sequence[str], variables: bool = True, out: str = "yhat", grad: str = "grad", ok: str = "ok", fill: bool = False) -> DataFrame:
    """The value, its gradient as an array over all features (or all constants of the pool), and the row's flag. With
    ``fill``, value and gradient are NaN on rows that fail."""
    expr.validate(len(features))
    directions = [("var", i) for i in range(len(features))] if variables else [("const", i) for i in range(len(expr.consts))]
    levels = _Levels(f"__{out}_")
    value, grads, checked = _walk(expr, features, levels, directions)
    good = F.lit(True)
    for c in checked:
        good = good & finite(c)
    array = F.array(*(F.lit(0.0) if g is None else g for g in grads)) if directions else F.array().cast("array<double>")
    shown = levels.onto(df).withColumns({out: value, grad: array, ok: good}).drop(*levels.names)
    if not fill:
        return shown
    nan = F.lit(float("nan"))
    return shown.withColumns({out: F.when(F.col(ok), F.col(out)).otherwise(nan), grad: F.transform(grad, lambda g: F.when(F.col(ok), g).otherwise(nan))})


def numpy_eval(expr: Expr, x: np.ndarray, check: bool = True, early_exit: bool = True, dtype: type = np.float64) -> tuple[np.ndarray, bool]:
    """Value on the columns of ``x`` (features by rows) and whether all operators' values are finite."""
    state = {"ok": True}
    n = x.shape[1]

    def leaf(node):
        return x[node.feature] if isinstance(node, Var) else dtype(expr.consts[node.slot])

    def op(node, args):
        if check and early_exit and not state["ok"]:
            return args[0]
        value = np.asarray(node.value(NUMPY, *args), dtype=dtype)
        if check and state["ok"] and not np.isfinite(value).all():
            state["ok"] = False
        return value

    with np.errstate(all="ignore"):
        value = expr.fold(leaf, op)
    if check and isinstance(expr.nodes[0], Const) and expr.is_leaf:
        state["ok"] = bool(np.isfinite(value))
    return np.broadcast_to(np.asarray(value, dtype=dtype), (n,)).copy(), state["ok"]


def numpy_grad(expr: Expr, x: np.ndarray, variables: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """Value, gradient (directions by rows) over features or constants, and the flag. All NaN where it is false."""
    n, size = x.shape[1], x.shape[0] if variables else len(expr.consts)
    ok = True

    def leaf(node):
        own = node.feature if isinstance(node, Var) and variables else node.slot if isinstance(node, Const) and not variables else None
        return (x[node.feature] if isinstance(node, Var) else np.float64(expr.consts[node.slot])), ({} if own is None else {own: np.float64(1.0)})

    def op(node, args):
        nonlocal ok
        values = [a[0] for a in args]
        value = node.value(NUMPY, *values)
        ok = ok and bool(np.isfinite(value).all())
        grads: dict[int, np.ndarray] = {}
        for i, (_, g) in enumerate(args):
            if g:
                p = node.partial(NUMPY, i, *values)
                for k, v in g.items():
                    grads[k] = grads[k] + p * v if k in grads else p * v
        return value, grads

    with np.errstate(all="ignore"):
        value, grads = expr.fold(leaf, op)
    out = np.zeros((size, n))
    for k, v in grads.items():
        out[k] = v
    if not ok:
        return np.full(n, np.nan), np.full((size, n), np.nan), False
    return np.broadcast_to(np.asarray(value, float), (n,)).copy(), out, True
