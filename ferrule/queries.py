"""The registered queries of the expression engine, over whole tables.

Inputs of the operator queries are signed, hold zeros and leave the operators' domains:
x = (l_quantity - 25) / 8, y = (l_discount - 0.05) * 40, z = l_tax * 10.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.evolve.mutate import random_expr
from ferrule.functions import losses as ls
from ferrule.functions.scalar import BUILTIN, SPARK, Op, OperatorSet
from ferrule.operators import front
from ferrule.operators.metrics import column_summary, metrics
from ferrule.operators.options import Options
from ferrule.operators.scoring import constant_gradient, differing, loss_of, optimised_constants, score_many
from ferrule.operators.search import SearchEngine
from ferrule.plans.compile import complete, differentiate, evaluate, finite, gradient
from ferrule.plans.expr import Expr, build, lit, var
from ferrule.plans.simplify import simplify
from ferrule.plans.store import place
from ferrule.sources import dataset as ds
from ferrule.streaming.scorer import windowed_loss

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inputs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x = (F.col("l_quantity").cast("double") - 25.0) / 8.0
    y = (F.col("l_discount").cast("double") - 0.05) * 40.0
    return li.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), (F.col("l_tax").cast("double") * 10.0).alias("z"), *more)


def shown(value: Column, name: str = "v") -> list[Column]:
    """A double as three columns that engines agree on: rounded where it is finite, and what it is where it isn't."""
    good = finite(value)
    return [(F.round(F.when(good, value).otherwise(F.lit(0.0)), 6) + 0.0).alias(name), F.isnan(value).alias(f"{name}_nan"), (F.when(F.isnan(value), F.lit(0)).when(value == float("inf"), F.lit(1)).when(value == float("-inf"), F.lit(-1)).otherwise(F.lit(0))).alias(f"{name}_inf")]


def _operator(op: Op) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        args = [F.col(c) for c in ("x", "y", "z")[: op.arity]]
        rows = inputs(spark, sf_dir).withColumn("value", op.value(SPARK, *args))
        return rows.select("l_orderkey", "l_linenumber", *shown(F.col("value")))

    return query


def _partials(op: Op) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        args = [F.col(c) for c in ("x", "y", "z")[: op.arity]]
        rows = inputs(spark, sf_dir).withColumns({f"p{i}": op.partial(SPARK, i, *args) + F.col("x") * 0.0 for i in range(op.arity)})
        return rows.select("l_orderkey", "l_linenumber", *(c for i in range(op.arity) for c in shown(F.col(f"p{i}"), f"d{i}")))

    return query


#: x0 = l_quantity, x1 = l_discount: the readme's formula, and others for the semantics of gradients and flags.
X0, X1 = var(0, ("l_quantity", "l_discount", "l_tax")), var(1)
README = X0 * build("cos", X1 - 3.2)
FORMULAS = {
    "eval_readme": README,
    "eval_fma": build("fma", X0, X1, var(2)) / 2.5,
    "eval_nested": build("exp", -(X1 * X1)) + build("max", build("sin", X0), X1) * 0.5,
}
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *(F.col(c).cast("double").alias(c) for c in (*FEATURES, "l_extendedprice")))


def _evaluated(expr: Expr) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(lines(spark, sf_dir), expr, FEATURES).select("l_orderkey", "l_linenumber", F.round("yhat", 6).alias("yhat"), "ok")

    return query


def eval_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intermediate infinity fails the formula although its value is finite; a bare feature isn't checked."""
    rows = inputs(spark, sf_dir)
    one = lit(1.0)
    cases = {"through_infinity": one / (one / var(0)), "log_of_signed": build("log", var(0)), "bare_feature": var(1), "swallowed": build("max", build("sqrt", var(0)), var(1))}
    for name, e in cases.items():
        rows = evaluate(rows, e, ["x", "y", "z"], f"v_{name}", f"ok_{name}")
    return rows.agg(*(complete(rows, f"ok_{n}").alias(n) for n in cases), *(F.count_if(~F.col(f"ok_{n}")).alias(f"bad_{n}") for n in cases))


def diff_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = differentiate(lines(spark, sf_dir), README, FEATURES, 1)
    return d.select("l_orderkey", "l_linenumber", F.round("yhat", 6).alias("yhat"), F.round("dyhat", 6).alias("dyhat"), "ok")


def grad_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gradient(lines(spark, sf_dir), README, FEATURES)
    return g.select("l_orderkey", "l_linenumber", *(F.round(F.get("grad", F.lit(i)), 6).alias(f"g{i}") for i in range(3)))


#: A constant that two nodes share: its slope is the sum over both.
SHARED = Expr((X0 * 2.0 + X1 * 2.0).nodes, (2.0, 2.0)).with_constants((2.0, 2.0))


def grad_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.plans.expr import Const

    shared = Expr(tuple(Const(0) if isinstance(n, Const) else n for n in SHARED.nodes), (2.0,))
    a = gradient(lines(spark, sf_dir), README, FEATURES, variables=False, grad="g")
    b = gradient(a.drop("yhat", "ok"), shared, FEATURES, variables=False, grad="h")
    return b.select("l_orderkey", "l_linenumber", F.round(F.get("g", F.lit(0)), 6).alias("g0"), F.round(F.get("h", F.lit(0)), 6).alias("h0"))


#: y and yhat of the loss queries, and weights that are 0 for some rows.
LOSSES = {"mse": ls.mse(), "mae": ls.mae(), "rmse": ls.rmse(), "huber": ls.huber(1.0), "logcosh": ls.log_cosh(), "lp": ls.lp(3.0), "quantile": ls.quantile(0.3), "epsins": ls.epsilon_insensitive(0.1)}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir, "l_returnflag", "l_linestatus")
    return rows.withColumns({"yhat": F.col("x") * F.cos("y"), "w": F.pmod(F.col("l_linenumber"), F.lit(4)).cast("double")})


def _loss(loss: ls.Loss, weighted: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = F.col("w") if weighted else None
        return predictions(spark, sf_dir).groupBy("l_returnflag").agg(F.round(loss.aggregate(F.col("yhat"), F.col("z"), w), 6).alias("loss"), F.count("*").alias("n"))

    return query


def _dloss(loss: ls.Loss) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = predictions(spark, sf_dir)
        whole = rows.agg(F.sum("w").alias("n"), loss.aggregate(F.col("yhat"), F.col("z"), F.col("w")).alias("l"))
        slope = loss.gradient(F.col("yhat"), F.col("z"), F.col("n"), F.col("w"), F.col("l"))
        # scaled by the sum of weights, so that rounding leaves digits
        return rows.join(F.broadcast(whole)).select("l_orderkey", "l_linenumber", (F.round(slope * F.col("n"), 6) + 0.0).alias("slope"))

    return query


def avg_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return rows.groupBy("l_returnflag").agg(F.round(ls.mean_y(F.col("z")), 9).alias("avg_y"), F.round(ls.mean_y(F.col("z"), F.col("w")), 9).alias("avg_y_w"))


def baseline_and_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = ds.with_roles(lines(spark, sf_dir).select(*FEATURES, "l_extendedprice"))
    df = evaluate(data.project(), README, data.x)
    y = F.col(data.y)
    both = df.agg(F.round(ls.mse().aggregate(F.col("yhat") / 1000, y / 1000), 6).alias("loss"), F.round(ls.mse().aggregate(F.lit(0.0), y / 1000), 6).alias("baseline"))
    return both.select("loss", "baseline", F.round(ls.loss_to_cost(F.col("loss"), F.lit(6), 0.001, F.col("baseline")), 6).alias("cost"), F.round(ls.loss_to_cost(F.col("loss") / 100, F.lit(6), 0.001), 6).alias("cost_without"))


def _metrics(weighted: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = metrics(predictions(spark, sf_dir), "yhat", "z", "w" if weighted else None)
        return m.select("n", *(F.round(c, 6).alias(c) for c in m.columns if c != "n"))

    return query


def metrics_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(predictions(spark, sf_dir), "yhat", "z", None, ["l_returnflag", "l_linestatus"])
    return m.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 6).alias(c) for c in m.columns[3:]))


def loss_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(ls.mse().aggregate(F.col("yhat"), F.col("z")), 6).alias("mse"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir).withColumn("lx", SPARK.log(F.col("x")))
    s = column_summary(rows, ["x", "y", "z", "lx"])
    return s.select("name", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-members from part: sizes as complexities, and losses and costs that scatter, with ties."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("long")
    return part.select(
        (key % 31).alias("pop"), key.alias("id"), key.alias("arrival"), ((key * 7919) % 1000).alias("birth"), F.col("p_size").cast("int").alias("complexity"),
        ((key * 48271) % 997).cast("double").alias("loss"), ((key * 16807) % 499).cast("double").alias("cost"),
    )


def hof_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front.best_by_complexity(members(spark, sf_dir), 30)


def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front.pareto_front(hof_best(spark, sf_dir))


def pareto_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front.front_tail(pareto(spark, sf_dir), 3)


def best_sub_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front.top_members(members(spark, sf_dir), 12)


def migrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir)
    pool = front.migrants_pool(front.top_members(rows, 2), rows.select("pop").distinct())
    return pool.groupBy("target").agg(F.count("*").alias("n"), F.min("cost").alias("least"))


def replaced_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir)
    children = front.top_members(rows, 2).withColumns({"birth": F.lit(10_000).cast("long"), "id": -F.col("id")})
    return front.replace_oldest(rows, children)


def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir)
    scored = front.tournament_score(rows, front.normalised(front.size_histogram(rows, 30)), 20.0)
    return scored.select("id", F.round("score", 6).alias("score"))


def asof_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pareto(spark, sf_dir)
    out = [front.nearest_lower(rows, k).withColumn("wanted", F.lit(k)) for k in (0, 3, 17, 30)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).select("wanted", "id", "complexity")


def member_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = members(spark, sf_dir).where("id = 7").withColumn("pop", F.lit(-1).cast("long"))
    return front.by_id(first, members(spark, sf_dir), 7).unionByName(front.by_id(first, members(spark, sf_dir), 8))


def mutation_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir)
    return front.normalised(front.size_histogram(rows, 30)).select("size", F.round("share", 9).alias("share"))


def column_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.preview(table(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_extendedprice"))


def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir).withColumn("lx", SPARK.log(F.col("x")))
    return ds.finite_pairs(rows, "lx", "y").groupBy(F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).agg(F.count("*").alias("n"))


def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return ds.split(orders, 0.2, "o_orderkey", 7, ds.arithmetic).groupBy("is_val", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, "o_orderkey", 7, ds.arithmetic).where("is_val").select("o_orderkey")


def gather_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = ds.split(orders, 0.1, "o_orderkey", 3, ds.arithmetic).where("is_val").select("o_orderkey")
    return ds.gather(orders.select("o_orderkey", "o_custkey"), rows, "o_orderkey")


def curve_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir).withColumn("s", F.sqrt("x"))
    pairs = ds.weight_before(ds.finite_pairs(rows, "s", "y").distinct().withColumn("n", F.lit(1).cast("long")), ["x", "y"], "n")
    return pairs.select((F.col("before") + 1).alias("place"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def curve_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole curve: what curve_sorted lists once a pair, here row for row."""
    rows = inputs(spark, sf_dir).withColumn("s", F.sqrt("x"))
    return ds.curve_places(rows, "s", "y").select("place", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


TREES = {"leaf": var(0), "readme": README, "fma": FORMULAS["eval_fma"], "nested": FORMULAS["eval_nested"], "sum": (X0 + 1.0) + 2.0, "difference": 1.0 - (2.0 - X0)}


def _scored(many: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = ds.with_roles(predictions(spark, sf_dir).select("x", "y", "z"), "z")
        exprs = [var(0), build("cos", var(1)) * 0.5, build("log", var(0)), var(0) * var(1) + 1.0, build("tanh", var(0)) * 0.3 + 0.4]
        if many:
            return score_many(data, exprs, ls.mse()).select(F.col("k").cast("int").alias("k"), F.round("loss", 6).alias("loss"), "ok")
        return loss_of(data, exprs, ls.mse()).select(F.col("name").cast("int").alias("k"), F.round("loss", 6).alias("loss"), "ok")

    return query


def loss_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = ds.with_roles(predictions(spark, sf_dir).select("x", "y", "z", "w"), "z", w="w")
    return constant_gradient(data, var(0) * 0.5 + build("cos", var(1) * 0.7), ls.mse()).select("slot", F.round("slope", 6).alias("slope"))


def metrics_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose key is null, with and without weights."""
    rows = predictions(spark, sf_dir).withColumn("key", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    out = [metrics(rows, "yhat", "z", w, ["key"]).withColumn("weighted", F.lit(w is not None)) for w in (None, "w")]
    both = out[0].unionByName(out[1])
    return both.select("key", "weighted", "n", *(F.round(c, 6).alias(c) for c in ("mse", "mae", "r2", "corr")))


def split_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders in five have no key: they are for training, and the fraction is of the others."""
    keyed = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 < 2, F.col("o_orderkey")).alias("k"))
    return ds.exact_split(keyed, 0.5, "k", 7, ds.arithmetic).groupBy(F.col("k").isNull().alias("no_key"), "is_val").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def csv_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read by roles: x but y and the weights, in the file's order."""
    path = place(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.csv(path, header=True)
    data = ds.with_roles(ds.read_csv(spark, path), y="s_nationkey", w="s_suppkey")
    return data.project().select(F.lit(",".join(data.x)).alias("x"), F.lit(data.y).alias("y"), F.lit(data.w).alias("w"), F.round(data.x[0], 2).alias("x0"), F.col(data.y).alias("value"), F.col(data.w).alias("weight"))


#: Options with weights of their own for nodes, and with limits.


def optimize_constants_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants of c0 * x + c1 over all rows: least squares has a closed form."""
    data = ds.with_roles(predictions(spark, sf_dir).select("x", "y", "z"), "z")
    found, loss = optimised_constants(data, var(0) * lit(1.0) + lit(0.0), ls.mse(), 30)
    return spark.createDataFrame([(round(found.consts[0], 4), round(found.consts[1], 4), round(loss, 4))], "slope double, intercept double, loss double")


def engine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a search is after each step, and whether its front is one: losses fall as complexity rises."""
    engine = _search(spark, sf_dir, F.col("x") + F.col("y"), populations=4, population_size=10, ncycles_per_iteration=20, niterations=2)
    rows = []
    for k in range(4):
        shot = engine.snapshot()
        front_rows = shot["front"]
        falls = all(a["loss"] > b["loss"] and a["complexity"] < b["complexity"] for a, b in zip(front_rows, front_rows[1:], strict=False))
        rows.append((k, shot["cycles"], shot["total_cycles"], shot["finished"], falls, bool(front_rows)))
        engine.step()
    return spark.createDataFrame(rows, "step int, cycles int, total_cycles int, finished boolean, falls boolean, has_front boolean")


def simplified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated trees and their simplified forms over all rows: how many values differ, and whether any tree grew."""
    ops, rng = OperatorSet.from_names(["+", "sub", "*", "cos", "abs", "max"]), np.random.default_rng(9)
    trees = [random_expr(rng, ops, 3, size) for size in range(2, 32)]
    short = [simplify(e)[0] for e in trees]
    grew = F.array(*(F.lit(len(b.nodes) > len(a.nodes)) for a, b in zip(trees, short, strict=True)))
    rows = differing(inputs(spark, sf_dir), list(zip(trees, short, strict=True)), ["x", "y", "z"])
    return rows.select(F.col("k").alias("tree"), "differ", F.get(grew, F.col("k")).alias("grew"))


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of windows of five days, of which those with a row at which the formula fails have none."""
    rows = predictions(spark, sf_dir).withColumn("t", F.timestamp_seconds(F.col("l_orderkey") * 86_400))
    return windowed_loss(rows, build("sqrt", var(0) + 2.75), ["x"], "z", ls.mse(), "t", "5 days").select(F.col("start").cast("long").alias("start"), "rows", F.round("loss", 6).alias("loss"), "ok")


def _search(spark: SparkSession, sf_dir: str, y: Column, **more) -> SearchEngine:
    data = ds.with_roles(inputs(spark, sf_dir).select("x", "y", y.alias("t")), "t")
    o = {"operators": OperatorSet.from_names(["cos", "+", "sub", "*"]), "populations": 8, "population_size": 27, "niterations": 3, "ncycles_per_iteration": 300, "maxsize": 12, "seed": 3} | more
    return SearchEngine(data, Options(**o))


def search_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, F.col("x") * F.cos("y") + 1.0).run().pareto_front()


def search_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, F.col("x") * F.col("x")).run().pareto_front()


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out |= {f"op_{op.name}": _operator(op) for op in BUILTIN.values()}
    out |= {f"d_{op.name}": _partials(op) for op in BUILTIN.values()}
    out |= {name: _evaluated(e) for name, e in FORMULAS.items()}
    out |= {f"loss_{n}{s}": _loss(loss, bool(s)) for n, loss in LOSSES.items() for s in ("", "_w")}
    out |= {f"dloss_{n}": _dloss(loss) for n, loss in LOSSES.items()}
    out |= {
        "eval_completeness": eval_completeness, "diff_readme": diff_readme, "grad_features": grad_features, "grad_constants": grad_constants,
        "avg_y": avg_y, "baseline_and_cost": baseline_and_cost, "metrics": _metrics(False), "metrics_w": _metrics(True), "metrics_by_flag": metrics_by_flag,
        "loss_rollup": loss_rollup, "column_summary": summary, "hof_best_by_complexity": hof_best, "pareto_front": pareto, "pareto_tail_k": pareto_tail,
        "best_sub_pop": best_sub_pop, "global_best": lambda s, d: front.global_best(members(s, d)), "two_oldest": lambda s, d: front.oldest(members(s, d), 2),
        "replace_oldest": replaced_oldest, "size_histogram": lambda s, d: front.size_histogram(members(s, d), 30), "freq_normalised": mutation_shares,
        "asof_lower_complexity": asof_lower, "tournament_score": tournament, "migrants_pool": migrants, "member_by_id": member_by_id,
        "column_preview": column_preview, "finite_filter": finite_filter, "split_hash": split_hash, "split_exact": split_exact, "gather_val": gather_val,
        "curve_sorted": curve_sorted, "curve_places": curve_places, "metrics_null_keys": metrics_null_keys, "split_null_keys": split_null_keys, "csv_roles": csv_roles, "optimize_constants_linear": optimize_constants_linear, "engine_steps": engine_steps, "simplified_values": simplified_values, "windowed_loss": windowed,
        "score_columns": _scored(False), "score_many": _scored(True), "loss_slopes": loss_slopes, "search_front": search_front, "search_square_recovery": search_square,
    }
    return out
