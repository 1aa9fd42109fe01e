"""Expressions: immutable postfix trees over features, pooled constants and operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np

from ferrule.functions.scalar import BUILTIN, Op

LIMIT = 65_535


@dataclass(frozen=True)
class Var:
    feature: int


@dataclass(frozen=True)
class Const:
    slot: int


Node = Var | Const | Op


class InvalidExpression(ValueError):
    pass


@dataclass(frozen=True)
class Expr:
    """``nodes`` in postfix order; a ``Const`` names a slot of ``consts``, and nodes may share one."""

    nodes: tuple[Node, ...]
    consts: tuple[float, ...] = ()
    names: tuple[str, ...] = ()

    def fold(self, leaf: Callable, op: Callable):
        """Bottom-up: ``leaf(node)`` for variables and constants, ``op(node, children)`` for operators."""
        stack: list = []
        for node in self.nodes:
            if isinstance(node, Op):
                if len(stack) < node.arity:
                    raise InvalidExpression("an operator lacks arguments")
                args = stack[-node.arity :]
                del stack[-node.arity :]
                stack.append(op(node, args))
            else:
                stack.append(leaf(node))
        if len(stack) != 1:
            raise InvalidExpression(f"{len(stack)} values are left")
        return stack[0]

    def validate(self, n_features: int) -> Expr:
        """Itself, when it is a tree over so many features and its own constants."""
        for node in self.nodes:
            if isinstance(node, Var) and not 0 <= node.feature < min(n_features, LIMIT):
                raise InvalidExpression(f"there is no feature {node.feature}")
            if isinstance(node, Const) and not 0 <= node.slot < min(len(self.consts), LIMIT):
                raise InvalidExpression(f"there is no constant {node.slot}")
        self.fold(lambda n: None, lambda n, a: None)
        return self

    # -- what it is made of --
    @property
    def depth(self) -> int:
        return self.fold(lambda n: 1, lambda n, a: 1 + max(a))

    def count(self, kind: type = object) -> int:
        return sum(isinstance(n, kind) for n in self.nodes)

    @property
    def is_valid(self) -> bool:
        try:
            self.fold(lambda n: None, lambda n, a: None)
        except InvalidExpression:
            return False
        return True

    @property
    def is_leaf(self) -> bool:
        return len(self.nodes) == 1

    @property
    def max_arity(self) -> int:
        return max((n.arity for n in self.nodes if isinstance(n, Op)), default=0)

    def sizes(self) -> list[int]:
        """The size of the subtree that ends at each node."""
        out: list[int] = []
        starts: list[int] = []
        for i, node in enumerate(self.nodes):
            first = i
            if isinstance(node, Op):
                first = starts[len(starts) - node.arity]
                del starts[len(starts) - node.arity :]
            starts.append(first)
            out.append(i - first + 1)
        return out

    def span(self, i: int) -> tuple[int, int]:
        """The nodes of the subtree that ends at ``i``, as a half-open range."""
        return i + 1 - self.sizes()[i], i + 1

    def children(self, i: int) -> list[tuple[int, int]]:
        """The ranges of an operator's arguments, the first one first."""
        sizes, out, end = self.sizes(), [], i
        for _ in range(self.nodes[i].arity if isinstance(self.nodes[i], Op) else 0):
            out.append((end - sizes[end - 1], end))
            end -= sizes[end - 1]
        return out[::-1]

    # -- constants --
    def with_constants(self, values: Sequence[float]) -> Expr:
        if len(values) != len(self.consts):
            raise ValueError(f"{len(self.consts)} constants are needed")
        return replace(self, consts=tuple(float(v) for v in values))

    def compressed(self) -> Expr:
        """Constants numbered by first use, sharing kept, unused ones gone."""
        slots: dict[int, int] = {}
        nodes = tuple(Const(slots.setdefault(n.slot, len(slots))) if isinstance(n, Const) else n for n in self.nodes)
        return replace(self, nodes=nodes, consts=tuple(self.consts[s] for s in slots))

    # -- algebra --
    @staticmethod
    def apply(op: Op, *args: Expr | float) -> Expr:
        """``op`` over its arguments; their constant pools are put one after another."""
        if len(args) != op.arity:
            raise ValueError(f"{op.name} takes {op.arity} arguments")
        nodes: list[Node] = []
        consts: list[float] = []
        names: tuple[str, ...] = ()
        for arg in args:
            e = arg if isinstance(arg, Expr) else lit(arg)
            if len(consts) + len(e.consts) > LIMIT:
                raise OverflowError("too many constants")
            nodes += [Const(n.slot + len(consts)) if isinstance(n, Const) else n for n in e.nodes]
            consts += e.consts
            names = names or e.names
        return Expr((*nodes, op), tuple(consts), names)

    def __add__(self, other):
        return Expr.apply(BUILTIN["add"], self, other)

    def __radd__(self, other):
        return Expr.apply(BUILTIN["add"], other, self)

    def __sub__(self, other):
        return Expr.apply(BUILTIN["sub"], self, other)

    def __rsub__(self, other):
        return Expr.apply(BUILTIN["sub"], other, self)

    def __mul__(self, other):
        return Expr.apply(BUILTIN["mul"], self, other)

    def __rmul__(self, other):
        return Expr.apply(BUILTIN["mul"], other, self)

    def __truediv__(self, other):
        return Expr.apply(BUILTIN["div"], self, other)

    def __rtruediv__(self, other):
        return Expr.apply(BUILTIN["div"], other, self)

    def __neg__(self):
        return Expr.apply(BUILTIN["neg"], self)

    # -- text --
    def text(self, pretty: bool = False, constant: Callable[[float], str] | None = None, names: Sequence[str] | None = None) -> str:
        """The formula. Infix operators of several arguments stand between them in parentheses; others are calls, whose
        arguments lose their outer parentheses, as does the whole."""
        names = names or self.names
        shown = constant or show_constant

        def leaf(node):
            if isinstance(node, Const):
                return shown(self.consts[node.slot])
            return names[node.feature] if node.feature < len(names) else f"x{node.feature}"

        def call(op, args):
            if op.infix and op.arity > 1:
                return "(" + f" {op.shown if pretty else op.infix} ".join(args) + ")"
            return f"{op.shown if pretty else op.infix or op.name}({', '.join(map(bare, args))})"

        return bare(self.fold(leaf, call))

    def __str__(self) -> str:
        return self.text()

    # -- rows --
    def to_row(self) -> dict:
        """A record for the struct type ``SCHEMA``."""
        nodes = [{"kind": "op" if isinstance(n, Op) else type(n).__name__.lower(), "arg": n.feature if isinstance(n, Var) else n.slot if isinstance(n, Const) else None, "arity": n.arity if isinstance(n, Op) else 0, "op": n.name if isinstance(n, Op) else None} for n in self.nodes]
        return {"nodes": nodes, "consts": list(self.consts), "names": list(self.names)}

    @staticmethod
    def from_row(row, ops: dict[str, Op] = BUILTIN) -> Expr:
        get = {"op": lambda n: ops[n["op"]], "var": lambda n: Var(n["arg"]), "const": lambda n: Const(n["arg"])}
        return Expr(tuple(get[n["kind"]](n) for n in row["nodes"]), tuple(row["consts"]), tuple(row["names"]))


SCHEMA = "nodes array<struct<kind:string,arg:int,arity:int,op:string>>, consts array<double>, names array<string>"


def bare(text: str) -> str:
    """Without parentheses around the whole, however many."""
    while text.startswith("(") and text.endswith(")"):
        level = 0
        for end, c in enumerate(text):  # noqa: B007
            level += (c == "(") - (c == ")")
            if level == 0:
                break
        if level or end < len(text) - 1:
            break
        text = text[1:-1]
    return text


def show_constant(value: float) -> str:
    """The shortest digits that give the value back, never in exponent form; whole numbers without a point."""
    if np.isnan(value) or np.isinf(value):
        return {True: "NaN"}.get(bool(np.isnan(value)), "inf" if value > 0 else "-inf")
    return np.format_float_positional(value, trim="-")


def var(feature: int, names: Sequence[str] = ()) -> Expr:
    return Expr((Var(feature),), (), tuple(names))


def lit(value: float) -> Expr:
    return Expr((Const(0),), (float(value),))


def zero() -> Expr:
    return lit(0.0)


def build(name: str, *args: Expr | float) -> Expr:
    """A built-in operator by name over its arguments: ``build("cos", x)``."""
    return Expr.apply(BUILTIN[name], *args)
