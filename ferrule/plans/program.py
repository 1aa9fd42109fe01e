"""Many formulas as one program: equal subtrees are computed once a batch, in registers that are used again.

Formulas become nodes of one graph, each different subtree a node: variables by feature, constants by value, operators by
name and arguments (those of commutative operators in either order). The graph is flattened to steps in the order in which
nodes came up; a register is free for others after the last step that reads it. Each formula keeps a flag of its own:
whether all operators' values below it were finite. Nothing is computed that only failed formulas need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from ferrule.functions.scalar import NUMPY, Op
from ferrule.plans.expr import Const, Expr, Var


@dataclass(frozen=True)
class Step:
    """``op`` over registers into a register; a leaf has no operator, but a feature or a value."""

    op: Op | None
    reads: tuple[int, ...]
    into: int
    feature: int | None = None
    value: float | None = None


class Program:
    """``formulas`` compiled; ``run`` hands each formula's value on as soon as it is there."""

    def __init__(self, formulas: Sequence[Expr]):
        self.formulas = list(formulas)
        nodes: dict[tuple, int] = {}
        made: list[tuple] = []
        roots: list[int] = []

        def node(key: tuple, what: tuple) -> int:
            if key not in nodes:
                nodes[key] = len(made)
                made.append(what)
            return nodes[key]

        for e in self.formulas:

            def leaf(n, e=e):
                if isinstance(n, Var):
                    return node(("x", n.feature), (None, (), n.feature, None))
                value = float(e.consts[n.slot])
                return node(("c", np.float64(value).tobytes()), (None, (), None, value))

            def op(n: Op, args):
                named = tuple(sorted(args)) if n.commutative and n.arity == 2 else tuple(args)
                return node((n.name, id(n), named), (n, tuple(args), None, None))

            roots.append(e.fold(leaf, op))
        last = list(range(len(made)))
        for k, what in enumerate(made):
            for a in what[1]:
                last[a] = k
        self.outputs: dict[int, list[int]] = {}
        for k, r in enumerate(roots):
            self.outputs.setdefault(r, []).append(k)
        free: list[int] = []
        register: dict[int, int] = {}
        self.registers, self.steps = 0, []
        for k, (o, args, feature, value) in enumerate(made):
            if free:
                register[k] = free.pop()
            else:
                register[k] = self.registers
                self.registers += 1
            self.steps.append(Step(o, tuple(register[a] for a in args), register[k], feature, value))
            for a in {*args, k}:
                if last[a] == k:  # nothing later reads it; an output is handed on at once
                    free.append(register[a])
        # a formula that is a constant alone is checked, one that is a feature alone is not
        self.lone = {r for r in self.outputs if made[r][0] is None and made[r][2] is None}
        self.kernels = sum(s.op is not None for s in self.steps)

    def run(self, x: np.ndarray, take: Callable[[int, np.ndarray], None], check: bool = True) -> np.ndarray:
        """``take(formula, value)`` for each formula that is finite throughout on the columns of ``x`` (features by rows);
        the result says which those are. A value is only good until ``take`` returns."""
        good, held = np.ones(len(self.formulas), bool), [None] * self.registers
        n, calls = x.shape[1], 0
        with np.errstate(all="ignore"):
            for k, s in enumerate(self.steps):
                if s.op is None:
                    value = x[s.feature] if s.feature is not None else np.float64(s.value)
                    if check and k in self.lone and not np.isfinite(value):
                        value_out = None
                    else:
                        value_out = value
                else:
                    args = [held[r] for r in s.reads]
                    if any(a is None for a in args):
                        value = None  # what is below it failed
                    else:
                        calls += 1
                        value = np.asarray(s.op.value(NUMPY, *args), dtype=np.float64)
                        if check and not np.isfinite(value).all():
                            value = None
                    value_out = value
                held[s.into] = value
                for f in self.outputs.get(k, ()):
                    if value_out is None:
                        good[f] = False
                    else:
                        take(f, np.broadcast_to(value_out, (n,)))
        self.calls = calls
        return good


class Survivors:
    """A program over batches: formulas that have failed on one are left out of the later ones."""

    def __init__(self, formulas: Sequence[Expr]):
        self.good = np.ones(len(formulas), bool)
        self.formulas = list(formulas)
        self.there = list(range(len(formulas)))
        self.program = Program(self.formulas)

    def run(self, x: np.ndarray, take: Callable[[int, np.ndarray], None]) -> None:
        there = self.there
        good = self.program.run(x, lambda k, v: take(there[k], v))
        if not good.all():
            self.good[[there[k] for k in np.flatnonzero(~good)]] = False
            self.there = [k for k in there if self.good[k]]
            self.program = Program([self.formulas[k] for k in self.there])


def without_constants(formulas: Sequence[Expr], n_x: int) -> tuple[list[Expr], list[Expr]]:
    """The formulas with their largest subtrees that have operators but no constants as further features ``n_x``, ...; and
    these subtrees. While constants change, subtrees keep their values."""
    shared: dict[tuple, int] = {}
    subtrees: list[Expr] = []
    out = []
    for e in formulas:
        sizes = e.sizes()
        free = [not any(isinstance(n, Const) for n in e.nodes[i + 1 - s : i + 1]) for i, s in enumerate(sizes)]
        nodes: list = []
        i = len(e.nodes) - 1
        while i >= 0:  # from the root down, so that the largest come first
            if free[i] and isinstance(e.nodes[i], Op):
                tree = e.nodes[i + 1 - sizes[i] : i + 1]
                if tree not in shared:
                    shared[tree] = n_x + len(subtrees)
                    subtrees.append(Expr(tree))
                nodes.append(Var(shared[tree]))
                i -= sizes[i]
            else:
                nodes.append(e.nodes[i])
                i -= 1
        out.append(Expr(tuple(nodes[::-1]), e.consts))
    return out, subtrees
