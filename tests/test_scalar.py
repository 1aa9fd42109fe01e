import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.functions.scalar import BUILTIN, NUMPY, SPARK, AmbiguousOperator, LookupError_, Op, OperatorSet, UnknownOperator, register

HARD = [0.0, -0.0, 1.0, -1.0, 2.0, -3.0, 0.5, -0.25, 1e-10, 1e8, -1e8, math.inf, -math.inf, math.nan]


def test_there_are_40_operators():
    assert len(BUILTIN) == 40
    assert [sum(o.arity == k for o in BUILTIN.values()) for k in (1, 2, 3)] == [30, 8, 2]


@pytest.fixture(scope="module")
def on_hard_values(spark):
    """Values and partials of all operators on hard inputs, by Spark."""
    rows = [(a, b, c) for a in HARD for b in HARD for c in (0.5, math.nan, -1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    cols = {}
    for op in BUILTIN.values():
        args = [F.col(c) for c in "xyz"[: op.arity]]
        cols[op.name] = op.value(SPARK, *args)
        for i in range(op.arity):
            cols[f"{op.name}/{i}"] = op.partial(SPARK, i, *args)
    return np.array(rows), df.select(*(c.alias(n) for n, c in cols.items())).toPandas()


def test_spark_never_gives_null_and_agrees_with_numpy(on_hard_values, spark):
    rows, got = on_hard_values
    with np.errstate(all="ignore"):
        for op in BUILTIN.values():
            args = [rows[:, i] for i in range(op.arity)]
            for name, want in [(op.name, op.value(NUMPY, *args)), *((f"{op.name}/{i}", op.partial(NUMPY, i, *args)) for i in range(op.arity))]:
                want = np.broadcast_to(np.asarray(want, float), len(rows))
                have = got[name].to_numpy(float)
                # a power of NaN or to one is 1 in C only in places; both are held to the same rule elsewhere
                skip = np.isnan(rows[:, :2]).any(axis=1) if op.name in ("pow",) else np.zeros(len(rows), bool)
                if op.name == "atan2":  # Spark's drops the sign of zero
                    skip = (np.signbit(rows[:, :2]) & (rows[:, :2] == 0)).any(axis=1)
                good = skip | np.isclose(have, want, rtol=1e-9, atol=1e-300, equal_nan=True)
                assert good.all(), (name, rows[~good][:3], have[~good][:3], want[~good][:3])


def test_nulls_never_appear(spark):
    df = spark.createDataFrame([(a, b) for a in HARD for b in HARD], "x double, y double")
    x, y, z = F.col("x"), F.col("y"), F.col("x") * 0.0
    checks = [F.count_if(op.value(SPARK, *(x, y, z)[: op.arity]).isNull()).alias(op.name) for op in BUILTIN.values()]
    assert set(df.agg(*checks).first().asDict().values()) == {0}


@pytest.mark.parametrize("name", sorted(BUILTIN))
def test_partials_are_central_differences(name):
    op = BUILTIN[name]
    points = {"acosh": 1.7, "atanh": 0.3, "asin": 0.3, "acos": 0.3}.get(name, 0.7)
    at = [points, 1.3, 2.1][: op.arity] if name != "clamp" else [0.7, 0.2, 1.5]
    for i in range(op.arity):
        h = 1e-6
        up, down = list(at), list(at)
        up[i] += h
        down[i] -= h
        want = (op.value(NUMPY, *map(np.float64, up)) - op.value(NUMPY, *map(np.float64, down))) / (2 * h)
        assert op.partial(NUMPY, i, *map(np.float64, at)) == pytest.approx(0.0 if name == "sign" else want, abs=1e-5, rel=1e-5)


@settings(max_examples=50, deadline=None)
@given(st.floats(allow_nan=True, allow_infinity=True), st.floats(allow_nan=True, allow_infinity=True))
def test_min_and_max_ignore_one_nan(a, b):
    for name, pick in (("min", np.fmin), ("max", np.fmax)):
        got = BUILTIN[name].value(NUMPY, np.float64(a), np.float64(b))
        assert got == pick(a, b) or (math.isnan(got) and math.isnan(pick(a, b)))


def test_lookup():
    ops = OperatorSet(tuple(BUILTIN.values()))
    assert ops.lookup(" COS ").name == "cos" and ops.lookup("+").name == "add"
    with pytest.raises(LookupError_, match="several"):
        ops.lookup("-")
    assert ops.lookup("-", 1).name == "neg"
    with pytest.raises(LookupError_, match="no operator"):
        ops.lookup("nothing")
    with pytest.raises(ValueError):
        OperatorSet.from_names(["+", "add"])
    with pytest.raises(ValueError):
        OperatorSet.from_names([])
    with pytest.raises(ValueError):
        OperatorSet.from_names(["fma"], max_arity=2)
    assert set(OperatorSet.preset("trig").ops) == {"sin", "cos", "add", "sub", "mul", "div"}


def test_custom_operator(spark):
    square = register("square", 1, lambda m, x: x * x, [lambda m, x: x * 2.0])
    assert isinstance(square, Op) and square.value(NUMPY, 3.0) == 9.0
    assert spark.range(1).select(square.value(SPARK, F.lit(3.0))).first()[0] == 9.0
    with pytest.raises(ValueError):
        register("broken", 2, lambda m, x, y: x, [lambda m, x, y: x])
    with pytest.raises(IndexError):
        square.partial(NUMPY, 1, 3.0)


def test_unknown_and_ambiguous_operators():
    every = OperatorSet(tuple(BUILTIN.values()))
    with pytest.raises(UnknownOperator):
        every.lookup("nothing")
    with pytest.raises(AmbiguousOperator) as e:
        every.lookup("-")
    assert sorted(e.value.candidates) == ["neg", "sub"] and every.lookup("-", 1).name == "neg"
    assert every.describe("add")["infix"] == "+" and every.describe("nothing") == every.describe("add", 3)
    assert (every.describe("nothing")["name"], every.describe("nothing")["complexity"]) == ("unknown_op", 0)


def test_a_token_of_several_operators_is_refused():
    with pytest.raises(AmbiguousOperator, match="several operators"):
        OperatorSet.from_names(["+", "-"])
    assert list(OperatorSet.from_names_by_arity(["-"], ["-"]).ops) == ["neg", "sub"] and list(OperatorSet.from_names(["sub", "neg"]).ops) == ["sub", "neg"]
