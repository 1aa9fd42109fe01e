import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.evolve import mutate as mu
from ferrule.functions.scalar import BUILTIN, OperatorSet, register
from ferrule.plans.compile import complete, differentiate, evaluate, gradient, numpy_eval, numpy_grad
from ferrule.plans.expr import Const, Expr, InvalidExpression, Var, bare, build, lit, show_constant, var
from ferrule.plans.simplify import simplify

X, Y = var(0), var(1)
OPS = OperatorSet.from_names(["cos", "exp", "+", "sub", "*", "/", "fma"])


def test_strings():
    assert str(X * build("cos", Y - 3.2)) == "x0 * cos(x1 - 3.2)"
    assert str(-(X + 1.0)) == "-(x0 + 1)"
    assert (X + Y).text(names=["a", "b"]) == "a + b"
    assert str((X + Y) * (X - Y)) == "(x0 + x1) * (x0 - x1)"
    assert str(build("fma", X, Y, lit(2.0))) == "fma(x0, x1, 2)"
    assert [show_constant(v) for v in (3.2, 1.0, 1e-7, float("inf"), float("nan"))] == ["3.2", "1", "0.0000001", "inf", "NaN"]


def test_tree_utilities():
    e = X * build("cos", Y - 3.2)
    assert (e.depth, len(e.nodes), e.count(Const), e.count(Var), e.max_arity) == (4, 6, 1, 2, 2)
    assert e.sizes() == [1, 1, 1, 3, 4, 6] and e.span(4) == (1, 5) and e.children(5) == [(0, 1), (1, 5)]
    assert not Expr((BUILTIN["add"],)).is_valid and not Expr((Var(0), Var(0))).is_valid
    with pytest.raises(InvalidExpression):
        X.validate(0)
    with pytest.raises(InvalidExpression):
        Expr((Const(1),), (1.0,)).validate(1)
    assert Expr.from_row(e.to_row()) == e


def test_constants_are_shared_and_compressed():
    e = Expr((Const(3), Const(1), BUILTIN["add"], Const(3), BUILTIN["mul"]), (0.0, 1.0, 2.0, 3.0)).compressed()
    assert e.consts == (3.0, 1.0) and e.nodes[0] == e.nodes[3] == Const(0)


def test_simplify():
    assert str(simplify((X + 1.0) + 2.0)[0]) == "x0 + 3"
    assert str(simplify(2.0 * (X * 3.0))[0]) == "x0 * 6"
    assert str(simplify(1.0 - (2.0 - X))[0]) == "x0 - 1"
    assert str(simplify(1.0 - (X - 2.0))[0]) == "3 - x0"
    assert str(simplify((5.0 - X) - 2.0)[0]) == "3 - x0"
    assert str(simplify((X - 5.0) - 2.0)[0]) == "x0 - 7"
    assert str(simplify(build("log", lit(-1.0)) + X)[0]) == "x0 + log(-1)" or "log(-1)" in str(simplify(build("log", lit(-1.0)) + X)[0])
    assert simplify(build("exp", lit(0.0)))[0] == lit(1.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 18))
def test_random_trees(seed, size):
    """Validity, simplification, gradients and mutations on random trees."""
    rng = np.random.default_rng(seed)
    e = mu.random_expr(rng, OPS, 2, size)
    assert e.is_valid and len(e.nodes) <= max(size, 1)
    x = rng.uniform(0.5, 1.5, (2, 7))
    value, ok = numpy_eval(e, x)
    small, _ = simplify(e)
    assert small.is_valid and len(small.nodes) <= len(e.nodes)
    if ok:
        again, good = numpy_eval(small, x)
        assert not good or np.allclose(value, again, rtol=1e-6, atol=1e-6 * (1 + np.abs(value).max()))
    for change in (lambda: mu.rotate_tree(rng, e), lambda: mu.swap_operands(rng, e), lambda: mu.delete_node(rng, e), lambda: mu.insert_node(rng, e, OPS, 2), lambda: mu.add_node(rng, e, OPS, 2), lambda: mu.mutate_feature(rng, e, 2), lambda: mu.mutate_operator(rng, e, OPS)):
        out = change()
        assert out is None or out.is_valid
    turned = mu.rotate_tree(rng, e)
    assert turned is None or sorted(map(str, turned.nodes)) == sorted(map(str, e.nodes))
    a, b = mu.crossover(rng, e, mu.random_expr(rng, OPS, 2, 5))
    assert a.is_valid and b.is_valid
    g, grad, ok = numpy_grad(e, x, variables=True)
    if ok and np.abs(g).max() < 1e3 and np.abs(grad).max() < 1e3:
        h = 1e-6
        up, down = x.copy(), x.copy()
        up[0] += h
        down[0] -= h
        want = (numpy_eval(e, up)[0] - numpy_eval(e, down)[0]) / (2 * h)
        assert np.allclose(grad[0], want, rtol=1e-3, atol=1e-3)


def test_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 40))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x.T], "a double, b double")
    for seed in range(4):
        e = mu.random_expr(np.random.default_rng(seed), OPS, 2, 9)
        rows = gradient(df, e, ["a", "b"]).toPandas()
        value, ok = numpy_eval(e, x, early_exit=False)
        assert np.allclose(rows.yhat, value, rtol=1e-9, equal_nan=True) and bool(rows.ok.all()) == ok
        if ok:
            _, grad, _ = numpy_grad(e, x, variables=True)
            assert np.allclose(np.stack(rows.grad), grad.T, rtol=1e-8, atol=1e-12)
            d = differentiate(df, e, ["a", "b"], 1).toPandas()
            assert np.allclose(d.dyhat, grad[1], rtol=1e-8, atol=1e-12)


def test_completeness(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (float("nan"),)], "a double")
    e = lit(1.0) / (lit(1.0) / X)
    out = evaluate(df.where("a = 0"), e, ["a"])
    assert out.select("yhat", "ok").first() == (0.0, False)
    assert out.agg(complete(out)).first()[0] is False
    assert evaluate(df, X, ["a"]).where("NOT ok").count() == 0  # inputs aren't checked
    assert evaluate(df.limit(1), lit(float("nan")), ["a"]).first().ok is False


def test_deep_plans_stay_small(spark):
    """Operators that use an argument often don't multiply the plan."""
    e = X
    for _ in range(15):
        e = build("log", build("max", e, lit(2.0)) + 3.0)
    row = evaluate(spark.createDataFrame([(1.0,)], "a double"), e, ["a"]).first()
    assert row.ok and abs(row.yhat - numpy_eval(e, np.array([[1.0]]))[0][0]) < 1e-12


def test_displays_and_parentheses():
    """An infix operator shows its display when pretty, and its infix when not; all outer parentheses go."""
    plus = register("plus", 2, lambda m, a, b: a + b, [lambda m, a, b: m.num(1.0)] * 2, infix="+", display="plus")
    e = Expr.apply(plus, var(0), var(1))
    assert e.text() == "x0 + x1" and e.text(pretty=True) == "x0 plus x1"
    once = register("once", 1, lambda m, a: a, [lambda m, a: m.num(1.0)], display="1x")
    assert Expr.apply(once, e).text() == "once(x0 + x1)" and Expr.apply(once, e).text(pretty=True) == "1x(x0 plus x1)"
    assert bare("((a))") == "a" and bare("(a) + (b)") == "(a) + (b)"
