"""Algebraic rewriting of expressions: constant folding and merging of constants along chains.

Catalyst folds literals as well, but it folds to NaN too and never merges ``(x + 1) + 2`` for doubles; and the size of the
tree, which a search pays for, must shrink on the driver.
"""

from __future__ import annotations

import math

import numpy as np

from ferrule.functions.scalar import BUILTIN, NUMPY, Op
from ferrule.plans.expr import Const, Expr, lit

Tree = tuple  # (node, children, value): value for a constant leaf


def _tree(expr: Expr) -> Tree:
    return expr.fold(lambda n: (n, (), expr.consts[n.slot] if isinstance(n, Const) else None), lambda n, a: (n, tuple(a), None))


def _constant(tree: Tree) -> float | None:
    return tree[2] if isinstance(tree[0], Const) else None


def _leaf(value: float) -> Tree:
    return (Const(-1), (), float(value))


def _evaluate(op: Op, values: list[float]) -> float:
    with np.errstate(all="ignore"):
        return float(op.value(NUMPY, *map(np.float64, values)))


def fold_constants(tree: Tree) -> Tree:
    """Operators of finite constants become constants where the result is finite."""
    node, children, value = tree
    if not isinstance(node, Op):
        return tree
    children = tuple(map(fold_constants, children))
    values = [_constant(c) for c in children]
    if all(v is not None and math.isfinite(v) for v in values):
        result = _evaluate(node, values)
        if math.isfinite(result):
            return _leaf(result)
    return (node, children, value)


def _merged(op: Op, a: float, b: float) -> float | None:
    result = _evaluate(op, [a, b])
    return result if math.isfinite(result) else None


def combine(tree: Tree) -> Tree:
    """Constants along a chain of one operator meet: sums and products, with the constant on the right, and the four
    shapes in which differences nest."""
    node, children, value = tree
    if not isinstance(node, Op):
        return tree
    children = tuple(map(combine, children))
    if node.name in ("add", "mul"):
        left, right = children
        if _constant(left) is not None and _constant(right) is None:
            left, right = right, left
        outer = _constant(right)
        if outer is not None and isinstance(left[0], Op) and left[0].name == node.name and _constant(left[1][1]) is not None:
            both = _merged(node, _constant(left[1][1]), outer)
            if both is not None:
                return (node, (left[1][0], _leaf(both)), None)
        return (node, (left, right), None)
    if node.name == "sub":
        left, right = children
        sub, add = node, BUILTIN["add"]
        a, b = _constant(left), _constant(right)
        if a is not None and isinstance(right[0], Op) and right[0].name == "sub":
            first, second = right[1]
            if (c := _constant(first)) is not None and (m := _merged(sub, c, a)) is not None:
                return (sub, (second, _leaf(m)), None)
            if (c := _constant(second)) is not None and (m := _merged(add, a, c)) is not None:
                return (sub, (_leaf(m), first), None)
        if b is not None and isinstance(left[0], Op) and left[0].name == "sub":
            first, second = left[1]
            if (c := _constant(first)) is not None and (m := _merged(sub, c, b)) is not None:
                return (sub, (_leaf(m), second), None)
            if (c := _constant(second)) is not None and (m := _merged(add, c, b)) is not None:
                return (sub, (first, _leaf(m)), None)
    return (node, children, value)


def _postfix(tree: Tree, expr: Expr) -> Expr:
    nodes, consts = [], []
    slots: dict[int, int] = {}

    def walk(t: Tree) -> None:
        node, children, value = t
        for c in children:
            walk(c)
        if isinstance(node, Const):
            # a slot that is shared stays shared; merged constants get their own
            slot = slots.get(node.slot) if node.slot >= 0 else None
            if slot is None:
                slot = len(consts)
                consts.append(value)
                if node.slot >= 0:
                    slots[node.slot] = slot
            node = Const(slot)
        nodes.append(node)

    walk(tree)
    return Expr(tuple(nodes), tuple(consts), expr.names)


def simplify(expr: Expr) -> tuple[Expr, bool]:
    """The folded, combined and compressed expression, and whether it differs."""
    out = _postfix(combine(fold_constants(_tree(expr))), expr)
    return out, out != expr.compressed()


__all__ = ["combine", "fold_constants", "lit", "simplify"]
