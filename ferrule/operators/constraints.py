"""Complexity of expressions and the constraints on them."""

from __future__ import annotations

from ferrule.functions.scalar import Op
from ferrule.operators.options import Options
from ferrule.plans.expr import Expr, Var

MOST = 2**16 - 1


def complexity(expr: Expr, options: Options | None = None) -> int:
    """The number of nodes, or with weights of its own for variables, constants or operators the sum of those."""
    if options is None or not weighed(options):
        return len(expr.nodes)
    return min(MOST, sum(_own(n, options) for n in expr.nodes))


def weighed(o: Options) -> bool:
    """Whether the options give weights of their own to variables, constants or operators."""
    return not o.complexity_of_constants == 1 == o.complexity_of_variables or bool(o.variable_complexities) or bool(o.operator_complexity_overrides)


def _own(node, o: Options) -> int:
    if isinstance(node, Op):
        return o.operator_complexity_overrides.get(node.name, 1)
    if isinstance(node, Var):
        return o.variable_complexities.get(node.feature, o.complexity_of_variables)
    return o.complexity_of_constants


def satisfies(expr: Expr, options: Options, maxsize: int | None = None) -> bool:
    """Size first, then depth, then the limits on operators' arguments and on nesting."""
    maxsize = options.maxsize if maxsize is None else maxsize
    if complexity(expr, options) > maxsize:
        return False
    if (options.maxdepth < maxsize or weighed(options)) and expr.depth > options.maxdepth:
        return False
    for i, node in enumerate(expr.nodes):
        if not isinstance(node, Op):
            continue
        limits = options.op_constraints.get(node.name)
        if limits:
            for (a, z), most in zip(expr.children(i), limits, strict=False):
                if most is not None and sum(_own(n, options) for n in expr.nodes[a:z]) > most:
                    return False
        for inner, most in options.nested_constraints.get(node.name, {}).items():
            if _nested(expr, i, inner) > most:
                return False
    return True


def _nested(expr: Expr, i: int, inner: str) -> int:
    """The most ``inner`` operators on a path below node ``i``, itself not counted."""
    a, z = expr.span(i)
    depth = Expr(expr.nodes[a : z - 1] + (expr.nodes[z - 1],), expr.consts).fold(lambda n: 0, lambda n, args: max(args) + (n.name == inner))
    return depth - (expr.nodes[i].name == inner)


def size_limit(maxsize: int, warmup: float, fraction: float) -> int:
    """The largest size allowed after a fraction of the search."""
    return 3 + int((maxsize - 3) * fraction / warmup) if warmup > 0 and fraction <= warmup else maxsize
