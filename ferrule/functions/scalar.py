"""The scalar operators: IEEE-754 values and partial derivatives, on Columns and on NumPy arrays.

Each operator is written once over a small set of primitives, which ``SPARK`` and ``NUMPY`` implement. Spark's own
functions stray from IEEE-754 in several places (logarithms outside their domain and division by zero give null or
raise, NaN compares as the largest value, asinh loses digits); the primitives of ``SPARK`` repair that within whole-stage
code generation. No operator gives null for non-null doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
LN2, LN10 = float(np.log(2.0)), float(np.log(10.0))


class SparkMath:
    """Primitives on Columns of doubles."""

    def __getattr__(self, name: str) -> Callable[[Column], Column]:
        return getattr(F, name)

    def num(self, value: float) -> Column:
        return F.lit(float(value))

    def where(self, condition: Column, yes, no) -> Column:
        return F.when(condition, yes).otherwise(no)

    def isnan(self, x: Column) -> Column:
        return F.isnan(x)

    # NaN is the largest value to Spark; these are false wherever one is NaN
    def lt(self, x, y) -> Column:
        return ~F.isnan(self._column(x)) & ~F.isnan(self._column(y)) & (self._column(x) < self._column(y))

    def eq(self, x, y) -> Column:
        return ~F.isnan(self._column(x)) & ~F.isnan(self._column(y)) & (self._column(x) == self._column(y))

    @staticmethod
    def _column(x) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    def div(self, x, y) -> Column:
        x, y = self._column(x), self._column(y)
        return F.when(y == 0.0, x * F.pow(y, F.lit(-1.0))).otherwise(x / F.when(y == 0.0, F.lit(1.0)).otherwise(y))

    def power(self, x, y) -> Column:
        x, y = self._column(x), self._column(y)
        one = (x == 1.0) | ((x == -1.0) & (F.abs(y) == INF))
        return F.when(one, F.when(x == 1.0, F.lit(1.0)).otherwise(F.lit(1.0))).otherwise(F.pow(x, y))

    def _log(self, function: Callable[[Column], Column], x: Column, pole: float) -> Column:
        return F.when((x > pole) | F.isnan(x), function(x)).when(x == pole, F.lit(-INF)).otherwise(F.lit(NAN))

    def log(self, x: Column) -> Column:
        return self._log(F.ln, x, 0.0)

    def log2(self, x: Column) -> Column:
        return self._log(F.log2, x, 0.0)

    def log10(self, x: Column) -> Column:
        return self._log(F.log10, x, 0.0)

    def log1p(self, x: Column) -> Column:
        return self._log(F.log1p, x, -1.0)

    def asinh(self, x: Column) -> Column:
        size = F.abs(x)
        # log1p of the excess keeps small values' digits; beyond 1e150 the square would overflow
        value = F.when(size > 1e150, F.ln(F.when(size > 0, size).otherwise(F.lit(1.0))) + LN2).otherwise(F.log1p(size + size * size / (1.0 + F.sqrt(size * size + 1.0))))
        return F.when(F.isnan(x), x).when(x < 0, -value).otherwise(value)

    def minimum(self, x: Column, y: Column) -> Column:
        return F.least(x, y)

    def maximum(self, x: Column, y: Column) -> Column:
        return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))

    def atan2(self, x: Column, y: Column) -> Column:
        return F.atan2(x, y)


class NumpyMath:
    """The same primitives on NumPy arrays; callers silence floating point warnings."""

    asin, acos, atan, acosh, atanh, asinh = np.arcsin, np.arccos, np.arctan, np.arccosh, np.arctanh, np.arcsinh
    minimum, maximum, power, atan2 = np.fmin, np.fmax, np.power, np.arctan2
    lt, eq, div = np.less, np.equal, np.divide

    def __getattr__(self, name: str):
        return getattr(np, name)

    def num(self, value: float) -> np.float64:
        return np.float64(value)


SPARK, NUMPY = SparkMath(), NumpyMath()


@dataclass(frozen=True)
class Op:
    """An operator. ``value(m, *args)`` and ``partials[i](m, *args)`` are over the primitives ``m``."""

    name: str
    arity: int
    value: Callable
    partials: Sequence[Callable]
    infix: str | None = None
    display: str | None = None
    commutative: bool = False
    associative: bool = False
    complexity: int = 1

    def __post_init__(self):
        if self.arity < 1 or len(self.partials) != self.arity:
            raise ValueError(f"{self.name}: an operator needs a value and a partial for each argument")

    def __reduce__(self):
        # built-in operators travel by name, custom ones with their functions
        if BUILTIN.get(self.name) is self:
            return _builtin, (self.name,)
        return Op, (self.name, self.arity, self.value, self.partials, self.infix, self.display, self.commutative, self.associative, self.complexity)

    @property
    def shown(self) -> str:
        return self.display or self.infix or self.name

    def partial(self, m, i: int, *args):
        if not 0 <= i < self.arity:
            raise IndexError(f"{self.name} has no argument {i}")
        return self.partials[i](m, *args)


def _sign(m, x):
    negative = m.lt(x, 0.0) if m is not SPARK else m.lt(x, 0.0) | (m.eq(x, 0.0) & m.lt(m.power(x, m.num(-1.0)), 0.0))
    if m is not SPARK:
        return np.where(np.isnan(x), x, np.copysign(1.0, x))
    return m.where(m.isnan(x), x, m.where(negative, m.num(-1.0), m.num(1.0)))


def _clamp(m, x, low, high):
    return m.where(m.isnan(x), x, m.where(m.lt(x, low), low, m.where(m.lt(high, x), high, x)))


def _chosen(first: bool, least: bool) -> Callable:
    """The partial of min or max: 1 for the argument that is chosen, a half on a tie, and NaN is never chosen."""

    def partial(m, x, y):
        own, other = (x, y) if first else (y, x)
        before = m.lt(own, other) if least else m.lt(other, own)
        one, half, none = m.num(1.0), m.num(0.5), m.num(0.0)
        return m.where(m.isnan(own), none, m.where(m.isnan(other), one, m.where(before, one, m.where(m.eq(own, other), half, none))))

    return partial


def _unary(name: str, value: Callable, partial: Callable, **more) -> Op:
    return Op(name, 1, value, (partial,), **more)


def _inverse(m, x):
    return m.div(m.num(1.0), x)


_ALL = (
    _unary("cos", lambda m, x: m.cos(x), lambda m, x: -m.sin(x)),
    _unary("sin", lambda m, x: m.sin(x), lambda m, x: m.cos(x)),
    _unary("tan", lambda m, x: m.tan(x), lambda m, x: _inverse(m, m.cos(x) * m.cos(x))),
    _unary("asin", lambda m, x: m.asin(x), lambda m, x: _inverse(m, m.sqrt(1.0 - x * x))),
    _unary("acos", lambda m, x: m.acos(x), lambda m, x: -_inverse(m, m.sqrt(1.0 - x * x))),
    _unary("atan", lambda m, x: m.atan(x), lambda m, x: _inverse(m, 1.0 + x * x)),
    _unary("sinh", lambda m, x: m.sinh(x), lambda m, x: m.cosh(x)),
    _unary("cosh", lambda m, x: m.cosh(x), lambda m, x: m.sinh(x)),
    _unary("tanh", lambda m, x: m.tanh(x), lambda m, x: _inverse(m, m.cosh(x) * m.cosh(x))),
    _unary("asinh", lambda m, x: m.asinh(x), lambda m, x: _inverse(m, m.sqrt(x * x + 1.0))),
    _unary("acosh", lambda m, x: m.acosh(x), lambda m, x: _inverse(m, m.sqrt(x - 1.0) * m.sqrt(x + 1.0))),
    _unary("atanh", lambda m, x: m.atanh(x), lambda m, x: _inverse(m, 1.0 - x * x)),
    _unary("sec", lambda m, x: _inverse(m, m.cos(x)), lambda m, x: m.div(m.tan(x), m.cos(x))),
    _unary("csc", lambda m, x: _inverse(m, m.sin(x)), lambda m, x: -m.div(_inverse(m, m.tan(x)), m.sin(x))),
    _unary("cot", lambda m, x: _inverse(m, m.tan(x)), lambda m, x: -_inverse(m, m.sin(x) * m.sin(x))),
    _unary("exp", lambda m, x: m.exp(x), lambda m, x: m.exp(x)),
    _unary("log", lambda m, x: m.log(x), lambda m, x: _inverse(m, x)),
    _unary("log2", lambda m, x: m.log2(x), lambda m, x: _inverse(m, x * LN2)),
    _unary("log10", lambda m, x: m.log10(x), lambda m, x: _inverse(m, x * LN10)),
    _unary("log1p", lambda m, x: m.log1p(x), lambda m, x: _inverse(m, 1.0 + x)),
    _unary("exp2", lambda m, x: m.power(m.num(2.0), x), lambda m, x: m.power(m.num(2.0), x) * LN2),
    _unary("expm1", lambda m, x: m.expm1(x), lambda m, x: m.exp(x)),
    _unary("sqrt", lambda m, x: m.sqrt(x), lambda m, x: m.div(m.num(0.5), m.sqrt(x))),
    _unary("cbrt", lambda m, x: m.cbrt(x), lambda m, x: _inverse(m, m.cbrt(x) * m.cbrt(x) * 3.0)),
    _unary("abs", lambda m, x: m.abs(x), lambda m, x: m.where(m.lt(m.num(0.0), x), m.num(1.0), m.where(m.lt(x, m.num(0.0)), m.num(-1.0), m.num(0.0)))),
    _unary("abs2", lambda m, x: x * x, lambda m, x: x * 2.0),
    _unary("inv", _inverse, lambda m, x: -_inverse(m, x * x)),
    _unary("sign", _sign, lambda m, x: m.num(0.0)),
    _unary("identity", lambda m, x: x, lambda m, x: m.num(1.0)),
    _unary("neg", lambda m, x: -x, lambda m, x: m.num(-1.0), infix="-"),
    Op("add", 2, lambda m, x, y: x + y, (lambda m, x, y: m.num(1.0), lambda m, x, y: m.num(1.0)), infix="+", commutative=True, associative=True),
    Op("sub", 2, lambda m, x, y: x - y, (lambda m, x, y: m.num(1.0), lambda m, x, y: m.num(-1.0)), infix="-"),
    Op("mul", 2, lambda m, x, y: x * y, (lambda m, x, y: y, lambda m, x, y: x), infix="*", commutative=True, associative=True),
    Op("div", 2, lambda m, x, y: m.div(x, y), (lambda m, x, y: _inverse(m, y), lambda m, x, y: -m.div(x, y * y)), infix="/"),
    Op("pow", 2, lambda m, x, y: m.power(x, y), (lambda m, x, y: y * m.power(x, y - 1.0), lambda m, x, y: m.power(x, y) * m.log(x))),
    Op("atan2", 2, lambda m, a, b: m.atan2(a, b), (lambda m, a, b: m.div(b, a * a + b * b), lambda m, a, b: -m.div(a, a * a + b * b))),
    Op("min", 2, lambda m, x, y: m.minimum(x, y), (_chosen(True, True), _chosen(False, True)), commutative=True, associative=True),
    Op("max", 2, lambda m, x, y: m.maximum(x, y), (_chosen(True, False), _chosen(False, False)), commutative=True, associative=True),
    Op("fma", 3, lambda m, x, y, z: x * y + z, (lambda m, x, y, z: y, lambda m, x, y, z: x, lambda m, x, y, z: m.num(1.0))),
    Op("clamp", 3, _clamp, (
        lambda m, x, a, b: m.where(m.lt(x, a) | m.lt(b, x), m.num(0.0), m.num(1.0)),
        lambda m, x, a, b: m.where(m.lt(x, a), m.num(1.0), m.num(0.0)),
        lambda m, x, a, b: m.where(~m.lt(x, a) & m.lt(b, x), m.num(1.0), m.num(0.0)),
    )),
)
BUILTIN: dict[str, Op] = {op.name: op for op in _ALL}


def _builtin(name: str) -> Op:
    return BUILTIN[name]


class LookupError_(ValueError):
    """A token that names no operator, or several."""


class UnknownOperator(LookupError_):
    pass


class AmbiguousOperator(LookupError_):
    def __init__(self, text: str, candidates: Sequence[str] = ()):
        super().__init__(text)
        self.candidates = list(candidates)


class OperatorSet:
    """A chosen set of operators, looked up by name, display or infix."""

    def __init__(self, ops: Sequence[Op | str] = (), max_arity: int = 3):
        self.ops: dict[str, Op] = {}
        self.max_arity = max_arity
        for op in ops:
            self.add(BUILTIN[op] if isinstance(op, str) and op in BUILTIN else self._builtin(op))

    @staticmethod
    def _builtin(op: Op | str) -> Op:
        return op if isinstance(op, Op) else OperatorSet(tuple(BUILTIN.values())).lookup(op)

    def add(self, op: Op) -> None:
        if op.arity > self.max_arity:
            raise ValueError(f"{op.name} takes {op.arity} arguments, more than {self.max_arity}")
        if op.name in self.ops:
            raise ValueError(f"{op.name} is in the set already")
        self.ops[op.name] = op

    def lookup(self, token: str, arity: int | None = None) -> Op:
        """By name (any case), exact display, or infix; the arity tells apart what shares a token."""
        token = token.strip()
        hits = [o for o in self.ops.values() if (o.name == token.lower() or token in (o.shown, o.infix)) and arity in (None, o.arity)]
        if not hits:
            raise UnknownOperator(f"{token!r} names no operator")
        if len(hits) > 1:
            raise AmbiguousOperator(f"{token!r} names several operators: {sorted((o.name, o.arity) for o in hits)}", [o.name for o in hits])
        return hits[0]

    def describe(self, name: str, arity: int | None = None) -> dict:
        """Name, display, infix, properties and complexity of an operator by its exact name; of one that the set doesn't
        have, what is shown in its place."""
        op = self.ops.get(name)
        if op is None or arity not in (None, op.arity):
            return {"name": "unknown_op", "display": "unknown_op", "infix": None, "commutative": False, "associative": False, "complexity": 0}
        return {"name": op.name, "display": op.shown, "infix": op.infix, "commutative": op.commutative, "associative": op.associative, "complexity": op.complexity}

    def by_arity(self, arity: int) -> list[Op]:
        return [o for o in self.ops.values() if o.arity == arity]

    @classmethod
    def from_names(cls, names: Sequence[str], max_arity: int = 3) -> OperatorSet:
        """Operators by tokens; one that names several, as - does, is refused: say sub or neg, or give arities."""
        if not names:
            raise ValueError("no operators are given")
        every = cls(tuple(BUILTIN.values()))
        return cls([every.lookup(n) for n in names], max_arity)

    @classmethod
    def from_names_by_arity(cls, unary: Sequence[str] = (), binary: Sequence[str] = (), ternary: Sequence[str] = ()) -> OperatorSet:
        every = cls(tuple(BUILTIN.values()))
        out = cls([every.lookup(n, k) for k, names in ((1, unary), (2, binary), (3, ternary)) for n in names])
        if not out.ops:
            raise ValueError("no operators are given")
        return out

    @classmethod
    def preset(cls, name: str) -> OperatorSet:
        """The presets basic, trig and explog."""
        extra = {"basic": ["cos"], "trig": ["sin", "cos"], "explog": ["cos", "exp", "log"]}[name]
        return cls.from_names([*extra, "+", "sub", "*", "/"])

    @classmethod
    def default(cls) -> OperatorSet:
        return cls.from_names(["+", "sub", "*", "/"])


def register(name: str, arity: int, value: Callable, partials: Sequence[Callable], **more) -> Op:
    """A custom operator; both its value and all its partials are needed."""
    return Op(name, arity, value, tuple(partials), **more)


def registry(spark):
    """A row for each built-in operator."""
    rows = [(o.name, o.arity, o.infix, o.shown, o.commutative, o.associative, o.complexity) for o in _ALL]
    return spark.createDataFrame(rows, "name string, arity int, infix string, display string, commutative boolean, associative boolean, complexity int")
