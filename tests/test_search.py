import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.evolve import mutate as mu
from ferrule.evolve.island import Island, Sample, decayed
from ferrule.evolve.optim import bfgs, newton
from ferrule.functions import losses as ls
from ferrule.functions.scalar import OperatorSet, register
from ferrule.operators import front
from ferrule.operators.constraints import complexity, satisfies, size_limit
from ferrule.operators.metrics import column_summary, metrics
from ferrule.operators.options import MutationWeights, Options
from ferrule.operators.scoring import baseline_loss, constant_gradient, loss_of, optimised_constants, score_many
from ferrule.operators.search import SearchEngine, Speed, show_front
from ferrule.operators.session import SearchSession, selected
from ferrule.plans import store
from ferrule.plans.compile import evaluate, gradient
from ferrule.plans.expr import Expr, build, lit, var
from ferrule.sources import dataset as ds
from ferrule.streaming.scorer import scored, windowed_loss

X, Y = var(0), var(1)


@pytest.mark.parametrize("name", ["mse", "mae", "rmse", "huber", "log-cosh", "lp", "quantile", "epsilon_insensitive"])
def test_losses_agree_and_slope_is_a_difference(spark, name):
    loss = ls.parse_loss(name)
    rng = np.random.default_rng(0)
    p, y, w = rng.normal(size=50), rng.normal(size=50), rng.uniform(0, 2, 50)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(p, y, w)], "p double, y double, w double")
    row = df.agg(loss.aggregate(F.col("p"), F.col("y")), loss.aggregate(F.col("p"), F.col("y"), F.col("w"))).first()
    assert row[0] == pytest.approx(loss.numpy(p, y)) and row[1] == pytest.approx(loss.numpy(p, y, w))
    g = loss.numpy_gradient(p, y, w)
    for i in range(3):
        d = np.zeros(50)
        d[i] = 1e-6
        assert g[i] == pytest.approx((loss.numpy(p + d, y, w) - loss.numpy(p - d, y, w)) / 2e-6, abs=1e-6)
    assert df.where("p > 99").agg(loss.aggregate(F.col("p"), F.col("y"))).first()[0] == 0.0
    with pytest.raises(ValueError):
        ls.parse_loss("nothing")


def test_cost_floor():
    assert ls.cost_of(1.0, 3, 0.5, None) == pytest.approx(101.5) and ls.cost_of(1.0, 3, 0.0, 2.0) == 0.5 and ls.cost_of(1.0, 0, 0.0, 0.001) == pytest.approx(100)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 3.0, 2.0), (4.0, 5.0, 0.0)], "yhat double, y double, w double")
    m = metrics(df).first()
    assert (m.n, m.mse, m.min_abs_err, m.max_abs_err) == (3, pytest.approx(2 / 3), 0.0, 1.0)
    assert m["corr"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 3, 5])[0, 1])
    assert metrics(df, w="w").first().mse == pytest.approx(2 / 3)
    none = metrics(df.where("y > 9")).first()
    assert none.n == 0 and math.isnan(none.mse) and none.min_abs_err == 0.0
    s = column_summary(spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "a double"), ["a"]).first()
    assert (s.n, s["mean"], s["std"], s["min"], s["max"]) == (2, 2.0, 1.0, 1.0, 3.0)


def members(spark):
    rows = [(0, 1, 1, 5, 1, 9.0, 9.0), (0, 2, 2, 3, 1, 8.0, 9.0), (0, 3, 3, 3, 2, 9.5, 1.0), (1, 4, 4, 1, 3, 2.0, 2.0), (1, 5, 5, 2, 3, 1.0, float("nan")), (1, 6, 6, 2, 40, 0.0, 0.0)]
    return spark.createDataFrame(rows, "pop long, id long, arrival long, birth long, complexity int, loss double, cost double")


def test_front(spark):
    m = members(spark)
    best = front.best_by_complexity(m, 30)
    assert {(r.complexity, r.id) for r in best.collect()} == {(1, 1), (2, 3), (3, 4)}  # the first of ties; NaN replaces nothing
    assert [r.id for r in front.pareto_front(best).orderBy("complexity").collect()] == [1, 4]  # by loss, not by cost
    assert front.nearest_lower(best, 2).first().id == 3 and front.nearest_lower(best, 0).first().id == 1
    assert {(r.pop, r.id) for r in front.oldest(m).collect()} == {(0, 2), (1, 4)}
    assert front.size_histogram(m, 4).orderBy("size").collect()[0].freq == 3.0
    child = m.where("id = 1").withColumn("id", F.lit(99).cast("long"))
    assert {r.id for r in front.replace_oldest(m, child).where("pop = 0").collect()} == {1, 3, 99}
    assert front.global_best(m).first().id == 6


def test_constraints():
    e = build("cos", build("cos", X)) + 1.0
    o = Options(operators=OperatorSet.from_names(["cos", "+"]), nested_constraints={"cos": {"cos": 0}})
    assert complexity(e) == 5 and not satisfies(e, o) and satisfies(build("cos", X) + 1.0, o)
    assert not satisfies(e, Options(maxsize=4)) and not satisfies(e, Options(maxdepth=2, maxsize=30))
    assert not satisfies(X * (Y + 1.0), Options(op_constraints={"mul": (None, 1)}))
    assert complexity(e, Options(complexity_of_constants=3)) == 7
    assert size_limit(30, 0.5, 0.25) == 16 and size_limit(30, 0.0, 0.5) == 30


def test_optimisers():
    target = np.arange(1.0, 6.0)
    x, value = bfgs(lambda c: (float(((c - target) ** 2).sum()), 2 * (c - target)), np.zeros(5), 30)
    assert np.allclose(x, target, atol=1e-6) and value < 1e-10
    x, value = newton(lambda c: (float((c[0] - 3) ** 4), np.array([4 * (c[0] - 3) ** 3])), 0.0, 60)
    assert abs(x - 3) < 1e-2
    rosen = lambda c: (float(100 * (c[1] - c[0] ** 2) ** 2 + (1 - c[0]) ** 2), np.array([-400 * c[0] * (c[1] - c[0] ** 2) - 2 * (1 - c[0]), 200 * (c[1] - c[0] ** 2)]))
    assert np.allclose(bfgs(rosen, np.array([-1.2, 1.0]), 200)[0], 1.0, atol=1e-4)


def test_mutation_conditions():
    w = mu.conditioned(MutationWeights(), X, Options(), 1, 30)
    assert w["swap_operands"] == w["delete_node"] == w["mutate_constant"] == 0.0 and w["mutate_feature"] > 0
    w = mu.conditioned(MutationWeights(), X + 1.0, Options(), 1, 3)
    assert w["add_node"] == w["insert_node"] == w["mutate_feature"] == 0.0
    rng = np.random.default_rng(0)
    values = [mu.mutate_constant(rng, lit(1.0), Options(), 1.0).consts[0] for _ in range(300)]
    assert sum(v < 0 for v in values) > 280
    for bad in ([], [0.0], [-1.0], [float("nan")]):
        with pytest.raises(ValueError):
            mu.weighted_choice(rng, ["a"] * len(bad), bad)


def test_island_optimises_and_keeps_births():
    x = np.linspace(-1, 1, 50)[None]
    o = Options(operators=OperatorSet.from_names(["+", "*"]), population_size=5)
    island = Island(o, Sample(x, 3 * x[0] + 2, None, 1.0), 0, 0, [], np.ones(30) / 30)
    m = island.member(X * 1.0 + 1.0, None)
    better = island.optimised(m)
    assert better.loss < 1e-10 and better.birth > m.birth
    assert decayed(np.full(3, 100_000.0)).sum() <= 100_000.001


def test_search_recovers_a_square_by_a_custom_operator(spark):
    square = register("square", 1, lambda m, v: v * v, [lambda m, v: v * 2.0])
    rows = [(float(a), float(b), float(a * a)) for a, b in np.random.default_rng(0).normal(size=(80, 2))]
    data = ds.with_roles(spark.createDataFrame(rows, "a double, b double, t double"))
    o = Options(operators=OperatorSet([square, "add", "mul"]), populations=2, population_size=15, niterations=2, ncycles_per_iteration=60, maxsize=8)
    engine = SearchEngine(data, o).step(1)
    assert not engine.is_finished and engine.snapshot()["cycles"] == 2
    engine.run()
    rows = engine.pareto_front().orderBy("loss").collect()
    assert rows[0].loss <= 1e-12 and engine.is_finished
    assert engine.evaluate_member(rows[0].id).first().r2 == pytest.approx(1.0)
    with pytest.raises(ValueError):
        engine.evaluate_member(rows[0].id, "val")
    assert "Equation" in show_front([r.asDict() for r in rows])


def test_split_and_snapshot(spark):
    rows = spark.range(60).select("id", F.randn(1).alias("a"), F.randn(2).alias("b")).withColumn("t", F.col("a") + F.col("b"))
    data = ds.Dataset(spark.createDataFrame(rows.toPandas()), ("a", "b"), "t")
    o = Options(operators=OperatorSet.from_names(["+", "*"]), populations=2, population_size=10, niterations=1, ncycles_per_iteration=30, maxsize=7, batching=True, batch_size=20)
    engine = SearchEngine(data, o, validation_fraction=0.25, key="id").run()
    assert engine.split().where("is_val").count() == 15 and engine.split().count() == 60
    shot = engine.snapshot(k=1)
    assert len(shot["front"]) == 1 and shot["evals_per_second"] > 0 and shot["finished"]
    assert engine.evaluate_member(shot["front"][0]["id"], "val").first().n == 15
    again = SearchEngine(data, o, validation_fraction=0.25, key="id").run()
    assert again.snapshot()["front"] == engine.snapshot()["front"]  # the same seed gives the same members


def test_speed():
    s = Speed()
    for k in range(30):
        s.add(float(k))
    assert s.mean == np.mean(range(10, 30)) and 0 < s.smooth < 29


def test_scoring_modes_agree(spark):
    rows = [(float(a), float(b), float(a + b)) for a, b in np.random.default_rng(1).normal(size=(60, 2))]
    data = ds.with_roles(spark.createDataFrame(rows, "a double, b double, t double"))
    exprs = [X, X + Y, build("log", X), X * 2.0]
    a = {int(r.name): (r.loss, r.ok) for r in loss_of(data, exprs, ls.mse()).collect()}
    b = {r.k: (r.loss, r.ok) for r in score_many(data, exprs, ls.mse()).collect()}
    assert a.keys() == b.keys() and a[2] == b[2] == (None, False) and all(a[k][0] == pytest.approx(b[k][0]) for k in (0, 1, 3))
    assert baseline_loss(data, ls.mse()) == pytest.approx(np.mean([r[2] ** 2 for r in rows]))
    slope = constant_gradient(data, X * 2.0, ls.mse()).first().slope
    assert slope == pytest.approx(np.mean([2 * (2 * r[0] - r[2]) * r[0] for r in rows]))


def test_dataset(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b,c\n 1, 2 ,3\n4,5,6\n")
    df = ds.read_csv(spark, str(path), ["a", "b", "c"])
    assert df.collect() == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    bad = tmp_path / "b.csv"
    bad.write_text("a,b\n1,2\nx,3\nNaN,1\n")
    assert ds.read_csv(spark, str(bad), ["a", "b"], on_bad_rows="drop").collect() == [(1.0, 2.0)]
    with pytest.raises(Exception):
        ds.read_csv(spark, str(bad), ["a", "b"]).collect()
    assert ds.with_roles(df).x == ("a", "b") and ds.with_roles(df, y="a", w="b").x == ("c",)
    for wrong in ({"y": "q"}, {"y": "a", "w": "a"}, {"y": "a", "x": ["a"]}, {"y": "a", "w": "b", "x": ["b"]}, {"y": "c", "x": []}):
        with pytest.raises(ds.DatasetError):
            ds.with_roles(df, **wrong)
    with pytest.raises(ds.DatasetError):
        ds.with_roles(df.where("a > 9"))
    rows = spark.range(1000).withColumn("v", F.col("id").cast("double"))
    assert ds.exact_split(rows, 0.25, "id").where("is_val").count() == 250
    assert 150 < ds.split(rows, 0.2, "id").where("is_val").count() < 250
    assert ds.exact_split(rows, 0.0, "id").where("is_val").count() == 0


def test_stream_scores_like_a_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2).cast("double").alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_loss(stream, X * 2.0 + 1.0, ["a"], "t", ls.mse(), "ts").writeStream.format("memory").queryName("losses").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM losses").collect()
    assert got and all(r.loss == pytest.approx(1.0) and r.rows == 60 for r in got)
    assert scored(rows, X * 2.0, ["a"]).where("abs(yhat - t) > 0").count() == 0


def test_sample_comes_from_all_partitions(spark):
    data = ds.Dataset(spark.range(10_000, numPartitions=10).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("t")), ("a",), "t")
    taken = np.concatenate([ds.bounded_sample(data, 50, seed)[0][0] for seed in range(10)])
    assert len(taken) == 500  # each draw is full
    assert (taken >= 9000).sum() > 20  # the last partition has its tenth


def test_front_goes_by_all_rows_with_runners_up(spark):
    """On the sample log(a) is the best of complexity 2; on all rows it isn't finite, and the runner-up takes its place."""
    rows = spark.range(2000, numPartitions=4).select((1.0 + F.col("id") / 500.0).alias("a"))
    rows = rows.withColumn("t", F.log("a")).unionByName(spark.createDataFrame([(-1.0, 0.0)], "a double, t double"))
    o = Options(operators=OperatorSet.from_names(["log", "cos", "sin", "+"]), populations=2, population_size=20, niterations=2, ncycles_per_iteration=40, maxsize=5, sample_rows=100, seed=1)
    data = ds.with_roles(rows, "t")
    assert ds.bounded_sample(data, 100, 1)[0].min() > 0
    engine = SearchEngine(data, o).run()
    hof = engine.hof.collect()
    exprs = [Expr.from_row(json.loads(r.expr), engine.ops) for r in hof]
    full = {int(r.name): r.loss for r in loss_of(data, exprs, o.loss).collect()}
    assert all(r.loss == pytest.approx(full[k]) for k, r in enumerate(hof))
    assert any(r.complexity == 2 for r in hof)


def test_island_keeps_runners_up():
    x = np.linspace(1, 2, 20)[None]
    island = Island(Options(operators=OperatorSet.from_names(["log", "cos", "sin"])), Sample(x, np.log(x[0]), None, 1.0), 0, 0, [], np.ones(30) / 30)
    island.note([island.member(build(n, X), None) for n in ("cos", "log", "sin", "log")])
    few = island.best[2]
    assert [str(m.expr)[:3] for m in few] == ["log", "cos", "sin"] and few[0].cost < few[1].cost < few[2].cost


def test_registered_searches_train_on_the_default_sample(spark, sf):
    from ferrule import queries

    assert queries._search(spark, sf, F.col("x")).options.sample_rows == Options().sample_rows


def test_curve_keeps_repeated_pairs_in_order(spark):
    values = [(float(k % 7), float(k % 3)) for k in range(200)] + [(1.0, 2.0)] * (ds.RUN + 5) + [(float("nan"), 0.0), (0.0, float("inf"))]
    df = spark.createDataFrame(values, "a double, b double").repartition(5)
    got = [(r.x, r.y) for r in ds.curve_places(df, "a", "b").orderBy("place").collect()]
    assert got == sorted(values[:-2])
    assert [r.place for r in ds.curve_places(df, "a", "b").orderBy("place").collect()] == list(range(1, len(got) + 1))
    plan = ds.curve_places(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert ds.curve_places(df.where("a > 99"), "a", "b").count() == 0


def test_each_island_is_a_task_of_its_own(spark):
    """In later iterations too: each partition of islands writes a file of its own."""
    rows = spark.range(40).select(F.randn(1).alias("a"), F.randn(2).alias("t"))
    o = Options(operators=OperatorSet.from_names(["+", "*"]), populations=6, population_size=5, niterations=3, ncycles_per_iteration=5, maxsize=7)
    engine = SearchEngine(ds.Dataset(spark.createDataFrame(rows.toPandas()), ("a",), "t"), o)
    for _ in range(3):
        engine.step()
        files = engine.members.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("pop").alias("pops")).collect()
        assert len(files) == 6 and all(r.pops == 1 for r in files)
        assert engine.members.groupBy("pop").count().where("count = 5").count() == 6


@pytest.mark.parametrize("some, fraction", [(5, 0.2), (15, 0.5), (20, 0.5), (0, 0.5)])
def test_exact_split_with_null_keys(spark, some, fraction):
    df = spark.createDataFrame([(k, None if k < some else k) for k in range(20)], "row long, key long")
    for scatter in (ds.hashed, ds.arithmetic):
        out = ds.exact_split(df, fraction, "key", 3, scatter)
        assert out.columns == ["row", "key", "is_val"] and out.count() == 20
        assert out.where("is_val").count() == round(fraction * (20 - some)) and out.where("key IS NULL AND is_val").count() == 0
        assert ds.split(df, fraction, "key", 3, scatter).where("is_val IS NULL OR (key IS NULL AND is_val)").count() == 0


def test_splits_by_string_keys_and_seeds(spark):
    df = spark.range(2000).select(F.format_string("k%s", F.col("id")).alias("key"))
    one, two = (ds.exact_split(df, 0.25, "key", seed).where("is_val").select("key") for seed in (1, 2))
    assert one.count() == two.count() == 500 and 80 < one.join(two, "key").count() < 170  # a quarter of them, by chance
    assert ds.exact_split(df.limit(0), 0.5, "key").count() == 0


def test_metrics_of_null_groups(spark):
    rows = [("a", 1.0, 1.5, 1.0), ("a", 2.0, 2.0, 2.0), (None, 3.0, 1.0, 1.0), (None, 4.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, yhat double, y double, w double")
    for w in (None, "w"):
        got = {r.g: r for r in metrics(df, w=w, by=["g"]).collect()}
        for g in ("a", None):
            alone = metrics(df.where(F.col("g").eqNullSafe(g)), w=w).first()
            assert got[g].n == 2 and all(got[g][c] == pytest.approx(alone[c]) for c in ("mse", "mae", "rmse", "r2", "corr"))


def test_a_null_in_a_dataset_is_an_error(spark):
    data = ds.with_roles(spark.createDataFrame([(1.0, 2.0), (2.0, None)], "a double, t double"))
    for act in (lambda: loss_of(data, [X], ls.mse()).collect(), lambda: score_many(data, [X], ls.mse()).collect()):
        with pytest.raises(Exception, match="t is null"):
            act()


def test_a_window_with_a_failing_row_has_no_loss(spark):
    df = spark.createDataFrame([(0, 4.0, 2.0), (10, -1.0, 0.0), (7200, 9.0, 3.0)], "s long, x double, y double").withColumn("t", F.timestamp_seconds("s"))
    got = {r.rows: r for r in windowed_loss(df, build("sqrt", X), ["x"], "y", ls.mse(), "t").collect()}
    assert got[2].loss is None and not got[2].ok and got[1].loss == 0.0 and got[1].ok


def test_depth_counts_where_complexities_are_custom():
    """Also where the weights add up to the number of nodes by chance."""
    e = build("cos", build("cos", build("cos", X)))
    o = Options(maxdepth=3, maxsize=3, variable_complexities={0: 0}, operator_complexity_overrides={"cos": 1})
    assert complexity(e, o) == 3 and not satisfies(e, o) and satisfies(build("cos", X), o)


def test_constants_over_all_rows(spark):
    df = spark.range(500).select((F.col("id") / 100.0).alias("a")).withColumn("t", 2.5 * F.cos("a") - 0.75)
    found, loss = optimised_constants(ds.with_roles(df), build("cos", X) * 1.0 + 0.0, ls.mse(), 20)
    assert np.allclose(found.consts, (2.5, -0.75), atol=1e-5) and loss < 1e-10
    failing = build("log", X) * 1.0
    assert optimised_constants(ds.with_roles(df), failing, ls.mse())[0] is failing


def test_an_optimisation_without_gain_is_a_new_member():
    x = np.linspace(-1, 1, 50)[None]
    island = Island(Options(operators=OperatorSet.from_names(["+"]), weights=MutationWeights(optimize=1e9), population_size=5), Sample(x, x[0], None, 1.0), 0, 0, [], np.ones(30) / 30)
    m = island.member(X, None)
    child, _ = island.next_generation(m, 1.0)
    assert child.id != m.id and child.parent == m.id


def test_csv_columns(spark, tmp_path):
    for name, text, header, want in (("a", "x, y\n\n1,2\n", True, ["x", "y"]), ("b", "x\n1,2\n3,4\n", True, ["col_0", "col_1"]), ("c", "1,2,3\n", False, ["col_0", "col_1", "col_2"])):
        (tmp_path / name).write_text(text)
        assert ds.csv_columns(spark, str(tmp_path / name), header) == want
    assert [tuple(r) for r in ds.read_csv(spark, str(tmp_path / "a"), on_bad_rows="drop").collect()] == [(1.0, 2.0)]
    with pytest.raises(ds.DatasetError):
        ds.csv_columns(spark, str(tmp_path / "c"), True)


def test_where_tables_are_stored(spark, tmp_path):
    """In the folder that the session names; one of this machine's only where driver and executors are one process."""

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext, self.values = type("Context", (), {"master": master}), {"spark.checkpoint.dir": named}
            self.conf = type("Conf", (), {"get": lambda _, k, d: self.values[k] or d, "set": lambda _, k, v: self.values.update({k: v})})()

    assert store.folder(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    local = Session("local[4]")
    assert store.folder(local) == local.values["spark.checkpoint.dir"]
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match=r"checkpoint\.dir"):
            store.folder(Session(master))


def test_a_session_answers_requests(spark):
    rows = [(float(a), float(a * a)) for a in np.random.default_rng(0).normal(size=40)]
    df = spark.createDataFrame(rows, "a double, t double")

    def make(**more):
        return SearchEngine(ds.with_roles(df), Options(operators=OperatorSet.from_names(["+", "*"]), populations=2, population_size=8, niterations=3, ncycles_per_iteration=10, maxsize=7, **more))

    ticks = iter(range(100))
    s = SearchSession(make, clock=lambda: next(ticks))
    ask = lambda **r: list(s.answer(r))
    assert ask(type="start")[0]["type"] == "error" and ask(type="nothing")[0]["type"] == "error"
    assert ask(type="init", options={"seed": 2}) == [{"type": "ready", "split": {"train": 40, "val": 0}}]
    snapshot, front_rows = ask(type="step", iterations=1)
    assert snapshot["snapshot"]["cycles"] == 2 and front_rows["front"]
    first = front_rows["front"][0]
    result = ask(type="evaluate", member=first["id"], request="r1")[0]
    assert result["type"] == "eval_result" and result["request"] == "r1" and result["result"]["mse"] == pytest.approx(first["loss"])
    run = s.answer({"type": "start"})
    assert next(run)["type"] == "snapshot" and ask(type="pause") == [{"type": "paused"}]
    assert [e["type"] for e in run] == ["front_update", "paused"] and not s.engine.is_finished
    assert [e["type"] for e in ask(type="start")][-3:] == ["snapshot", "front_update", "done"] and s.engine.is_finished
    assert json.loads(s.engine.snapshot_json())["finished"] is True
    refined = {r.complexity: r.loss for r in s.engine.refined_front(3).collect()}
    assert all(any(loss <= r.loss + 1e-9 for k, loss in refined.items() if k <= r.complexity) for r in s.engine.pareto_front().collect())
    assert ask(type="reset") == [{"type": "reset_done"}] and ask(type="step")[0]["type"] == "error"
    assert selected([first], None, first["id"]) == first and selected([], first, None) == first and selected([], first, first["id"]) == first and selected([], first, -5) is None


def test_rows_that_fail_are_filled(spark):
    df = spark.createDataFrame([(4.0,), (-1.0,)], "a double")
    rows = gradient(df, build("sqrt", X), ["a"], fill=True).orderBy(F.desc("a")).collect()
    assert rows[0].grad == [0.25] and math.isnan(rows[1].grad[0]) and math.isnan(rows[1].yhat) and not rows[1].ok
    assert evaluate(df, build("sqrt", X), ["a"], check=False).where("ok").count() == 2
