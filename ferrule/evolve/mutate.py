"""Random expressions, mutations and crossover. Each takes a NumPy generator and returns a new expression, or None."""

from __future__ import annotations

import numpy as np

from ferrule.functions.scalar import Op, OperatorSet
from ferrule.operators.constraints import complexity
from ferrule.operators.options import MutationWeights, Options
from ferrule.plans.expr import Const, Expr, Var


def splice(expr: Expr, a: int, z: int, other: Expr) -> Expr:
    """``expr`` with its nodes from ``a`` to ``z`` replaced by another expression."""
    shift = len(expr.consts)
    moved = tuple(Const(n.slot + shift) if isinstance(n, Const) else n for n in other.nodes)
    return Expr(expr.nodes[:a] + moved + expr.nodes[z:], expr.consts + other.consts, expr.names).compressed()


def part(expr: Expr, a: int, z: int) -> Expr:
    return Expr(expr.nodes[a:z], expr.consts, expr.names).compressed()


def pick(rng: np.random.Generator, items):
    return items[int(rng.integers(len(items)))]


def random_op(rng: np.random.Generator, ops: OperatorSet, most: int | None = None) -> Op | None:
    """An operator, each as likely as another, of at most so many arguments."""
    fitting = [o for o in ops.ops.values() if most is None or o.arity <= most]
    return pick(rng, fitting) if fitting else None


def random_leaf(rng: np.random.Generator, n_features: int) -> Expr:
    if rng.random() < 0.5 or n_features == 0:
        return Expr((Const(0),), (float(rng.standard_normal()),))
    return Expr((Var(int(rng.integers(n_features))),))


def expand_leaf(rng: np.random.Generator, expr: Expr, ops: OperatorSet, n_features: int, most: int | None = None) -> Expr | None:
    """A random leaf becomes an operator over new leaves."""
    op = random_op(rng, ops, most)
    if op is None:
        return None
    i = pick(rng, [i for i, n in enumerate(expr.nodes) if not isinstance(n, Op)])
    return splice(expr, i, i + 1, Expr.apply(op, *(random_leaf(rng, n_features) for _ in range(op.arity))))


def random_expr(rng: np.random.Generator, ops: OperatorSet, n_features: int, size: int) -> Expr:
    expr = random_leaf(rng, n_features)
    while len(expr.nodes) < size:
        grown = expand_leaf(rng, expr, ops, n_features, size - len(expr.nodes))
        if grown is None:
            break
        expr = grown
    return expr


def first_expr(rng: np.random.Generator, ops: OperatorSet, n_features: int, maxsize: int, expansions: int = 3) -> Expr:
    expr = Expr((Const(0),), (0.0,))
    for _ in range(expansions):
        grown = expand_leaf(rng, expr, ops, n_features, maxsize - len(expr.nodes))
        expr = grown or expr
    return expr


# -- mutations --
def mutate_constant(rng, expr: Expr, options: Options, temperature: float) -> Expr | None:
    slots = [n.slot for n in expr.nodes if isinstance(n, Const)]
    if not slots:
        return None
    factor = (options.perturbation_factor * max(temperature, 0.0) + 1.1) ** rng.random()
    factor = 1 / factor if rng.random() < 0.5 else factor
    # the sign turns unless the draw falls below the probability, which is how the search has been tuned
    factor = -factor if rng.random() > options.probability_negate_constant else factor
    values = list(expr.consts)
    values[pick(rng, slots)] *= factor
    return expr.with_constants(values)


def mutate_operator(rng, expr: Expr, ops: OperatorSet) -> Expr | None:
    places = [i for i, n in enumerate(expr.nodes) if isinstance(n, Op)]
    if not places:
        return None
    i = pick(rng, places)
    same = ops.by_arity(expr.nodes[i].arity)
    return Expr(expr.nodes[:i] + (pick(rng, same),) + expr.nodes[i + 1 :], expr.consts, expr.names) if same else None


def mutate_feature(rng, expr: Expr, n_features: int) -> Expr | None:
    places = [i for i, n in enumerate(expr.nodes) if isinstance(n, Var)]
    if not places or n_features < 2:
        return None
    i = pick(rng, places)
    others = [f for f in range(n_features) if f != expr.nodes[i].feature]
    return Expr(expr.nodes[:i] + (Var(pick(rng, others)),) + expr.nodes[i + 1 :], expr.consts, expr.names)


def swap_operands(rng, expr: Expr) -> Expr | None:
    places = [i for i, n in enumerate(expr.nodes) if isinstance(n, Op) and n.arity == 2]
    if not places:
        return None
    i = pick(rng, places)
    (a, m), (_, z) = expr.children(i)
    return Expr(expr.nodes[:a] + expr.nodes[m:z] + expr.nodes[a:m] + expr.nodes[z:], expr.consts, expr.names)


def rotate_tree(rng, expr: Expr) -> Expr | None:
    """A child that is an operator rises above its parent; one of its own children takes its old place."""
    places = [(i, k) for i, n in enumerate(expr.nodes) if isinstance(n, Op) for k, (a, z) in enumerate(expr.children(i)) if isinstance(expr.nodes[z - 1], Op)]
    if not places:
        return None
    root = pick(rng, sorted({i for i, _ in places}))
    k = pick(rng, [k for i, k in places if i == root])
    arguments = expr.children(root)
    pivot = arguments[k][1] - 1
    inner = expr.children(pivot)
    j = int(rng.integers(len(inner)))
    cut = lambda s: expr.nodes[s[0] : s[1]]
    lowered = tuple(n for q, s in enumerate(arguments) for n in (cut(inner[j]) if q == k else cut(s))) + (expr.nodes[root],)
    raised = tuple(n for q, s in enumerate(inner) for n in (lowered if q == j else cut(s))) + (expr.nodes[pivot],)
    a, z = expr.span(root)
    return Expr(expr.nodes[:a] + raised + expr.nodes[z:], expr.consts, expr.names)


def prepend_op(rng, expr: Expr, ops: OperatorSet, n_features: int) -> Expr | None:
    return wrap(rng, expr, 0, len(expr.nodes), ops, n_features)


def wrap(rng, expr: Expr, a: int, z: int, ops: OperatorSet, n_features: int) -> Expr | None:
    """An operator over a subtree, at a random one of its arguments, and over new leaves."""
    op = random_op(rng, ops)
    if op is None:
        return None
    own, at = part(expr, a, z), int(rng.integers(op.arity))
    return splice(expr, a, z, Expr.apply(op, *(own if q == at else random_leaf(rng, n_features) for q in range(op.arity))))


def add_node(rng, expr: Expr, ops: OperatorSet, n_features: int) -> Expr | None:
    return expand_leaf(rng, expr, ops, n_features) if rng.random() < 0.5 else prepend_op(rng, expr, ops, n_features)


def insert_node(rng, expr: Expr, ops: OperatorSet, n_features: int) -> Expr | None:
    return wrap(rng, expr, *expr.span(int(rng.integers(len(expr.nodes)))), ops, n_features)


def delete_node(rng, expr: Expr) -> Expr | None:
    places = [i for i, n in enumerate(expr.nodes) if isinstance(n, Op)]
    if not places:
        return None
    i = pick(rng, places)
    return splice(expr, *expr.span(i), part(expr, *pick(rng, expr.children(i))))


def crossover(rng, left: Expr, right: Expr) -> tuple[Expr, Expr]:
    """Two random subtrees change places."""
    a, b = left.span(int(rng.integers(len(left.nodes)))), right.span(int(rng.integers(len(right.nodes))))
    return splice(left, *a, part(right, *b)), splice(right, *b, part(left, *a))


def conditioned(weights: MutationWeights, expr: Expr, options: Options, n_features: int, maxsize: int) -> dict[str, float]:
    """The weights of those mutations that make sense for the expression."""
    w = dict(vars(weights))
    constants = expr.count(Const)
    if expr.is_leaf:
        for k in ("mutate_operator", "swap_operands", "delete_node", "simplify"):
            w[k] = 0.0
        for k in ("mutate_feature",) if constants else ("optimize", "mutate_constant"):
            w[k] = 0.0
        return w
    if not any(isinstance(n, Op) and n.arity == 2 for n in expr.nodes):
        w["swap_operands"] = 0.0
    w["mutate_constant"] *= min(8, constants) / 8
    if n_features < 2:
        w["mutate_feature"] = 0.0
    if complexity(expr, options) >= maxsize:
        w["add_node"] = w["insert_node"] = 0.0
    if not options.should_simplify:
        w["simplify"] = 0.0
    if not options.should_optimize_constants or not constants:
        w["optimize"] = 0.0
    return w


def weighted_choice(rng: np.random.Generator, names: list[str], weights: list[float]) -> str:
    if not names or any(not np.isfinite(x) or x < 0 for x in weights) or sum(weights) <= 0:
        raise ValueError("weights must be finite, not negative, and not all 0")
    at = rng.random() * sum(weights)
    for name, x in zip(names, weights, strict=True):
        at -= x
        if at < 0:
            return name
    return next(n for n, x in zip(reversed(names), reversed(weights), strict=True) if x > 0)
