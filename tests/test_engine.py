"""Programs with shared subtrees, mergeable losses, constants in step, searches that resume, and steps over tables of any size."""

import json
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule import queries
from ferrule.evolve import mutate as mu
from ferrule.evolve.island import Island, Sample
from ferrule.evolve.optim import answered, trials_of
from ferrule.functions import losses as ls
from ferrule.functions.scalar import OperatorSet
from ferrule.functions.state_losses import StateLoss, correlation_loss, r2_loss
from ferrule.operators import front, scoring, search
from ferrule.operators.metrics import metrics
from ferrule.operators.options import Options
from ferrule.operators.scoring import differing, in_lockstep, losses_and_slopes, loss_of, score_many, search_constants, state_loss
from ferrule.operators.search import SearchEngine
from ferrule.plans import store
from ferrule.plans.compile import numpy_eval, numpy_grad
from ferrule.plans.expr import Expr, build, lit, var
from ferrule.plans.program import Program, Survivors, without_constants
from ferrule.sources import dataset as ds
from ferrule.steps import played, replayed
from ferrule.streaming.scorer import windowed_loss, windowed_state_loss

X, Y = var(0), var(1)


def population(n=200, seed=0):
    """Formulas as a search has them: mutated from few."""
    rng, ops = np.random.default_rng(seed), OperatorSet.from_names(["+", "sub", "*", "/", "cos", "log", "max"])
    out = [mu.random_expr(rng, ops, 2, 9) for _ in range(6)]
    while len(out) < n:
        e = mu.mutate_feature(rng, out[int(rng.integers(len(out)))], 2) if rng.random() < 0.5 else mu.add_node(rng, out[int(rng.integers(len(out)))], ops, 2)
        if e is not None:
            out.append(e)
    return out


def test_a_program_gives_what_each_formula_gives():
    formulas = [*population(), X, lit(2.0), lit(float("inf")), build("log", X) - build("log", X), X + 1.0, 1.0 + X]
    x = np.random.default_rng(1).normal(size=(2, 50))
    program, got = Program(formulas), {}
    good = program.run(x, lambda k, v: got.update({k: v.copy()}))
    for k, e in enumerate(formulas):
        value, ok = numpy_eval(e, x)
        assert good[k] == ok and (k in got) == ok
        if ok:
            assert np.array_equal(got[k], value)


def test_equal_subtrees_are_computed_once_in_few_registers():
    shared = build("cos", X * Y)
    program = Program([shared + 1.0, shared * shared, build("exp", shared), Y * X, shared])
    assert program.kernels == 5  # of them 14 in all: the product, its cosine, and the three roots
    calls = Program([shared + 1.0, build("log", lit(-1.0)) + shared])
    calls.run(np.ones((2, 3)), lambda k, v: None)
    assert calls.calls == 4 and calls.kernels == 5  # what is above a failure isn't computed
    many = population(800)
    program, alone = Program(many), sum(sum(not isinstance(n, type(X.nodes[0])) and hasattr(n, "arity") for n in e.nodes) for e in many)
    assert program.kernels < 0.6 * alone
    deep = X
    for _ in range(200):
        deep = build("cos", deep + X)
    assert Program([deep]).registers <= 4
    assert program.registers < program.kernels / 2


def test_formulas_that_failed_are_left_out():
    s, seen = Survivors([build("log", X), X + 1.0]), []
    for value in (1.0, -1.0, 2.0):
        s.run(np.full((1, 2), value), lambda k, v: seen.append(k))
    assert seen == [0, 1, 1, 1] and s.good.tolist() == [False, True] and s.program.kernels == 1


def test_subtrees_without_constants_are_features():
    formulas = [build("cos", X * Y) * 2.0 + 1.0, build("cos", X * Y) + build("cos", X * Y) * 3.0]
    reduced, subtrees = without_constants(formulas, 2)
    assert [str(s) for s in subtrees] == ["cos(x0 * x1)"]
    x = np.random.default_rng(2).normal(size=(2, 20))
    more = np.vstack([x, [numpy_eval(s, x)[0] for s in subtrees]])
    for e, r in zip(formulas, reduced, strict=True):
        assert all(np.allclose(a, b) for a, b in zip(numpy_grad(e, x)[:2], numpy_grad(r, more)[:2], strict=True))


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    a, b, w = rng.normal(size=400), rng.normal(size=400), rng.uniform(0, 2, 400)
    t = 1.5 * np.cos(a) - 0.5 * b + 0.2 + 0.05 * rng.normal(size=400)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, t, w, strict=True)], "a double, b double, t double, w double").repartition(5)


@pytest.mark.parametrize("loss", [r2_loss(), correlation_loss()], ids=lambda x: x.name)
@pytest.mark.parametrize("weighted", [False, True])
def test_state_losses_merge_and_their_slopes_are_differences(noisy, loss, weighted):
    rows = noisy.toPandas()
    p, y, w = np.cos(rows["a"].to_numpy()), rows["t"].to_numpy(), rows["w"].to_numpy() if weighted else None
    v = np.ones(len(y)) if w is None else w
    if loss.name == "r2":
        want = (v * (p - y) ** 2).sum() / (v * (y - np.average(y, weights=v)) ** 2).sum()
    else:
        c = np.cov(p, y, aweights=v)
        want = 1 - c[0, 1] / math.sqrt(c[0, 0] * c[1, 1])
    assert loss.numpy(p, y, w) == pytest.approx(want)
    whole = loss.empty()
    for part in np.array_split(np.arange(len(y)), 7):
        whole = loss.merge(whole, loss.update(loss.empty(), p[part], y[part], None if w is None else w[part]))
    assert loss.finish(whole) == pytest.approx(want)
    g = loss.numpy_gradient(p, y, w)
    for i in (0, 7, 100):
        d = np.zeros(len(y))
        d[i] = 1e-6
        assert g[i] == pytest.approx((loss.numpy(p + d, y, w) - loss.numpy(p - d, y, w)) / 2e-6, abs=1e-7)
    df = noisy.withColumn("p", F.cos("a"))
    assert state_loss(df, loss, "p", "t", "w" if weighted else None).first().loss == pytest.approx(want)
    data = ds.Dataset(noisy, ("a", "b"), "t", "w" if weighted else None)
    scored = score_many(data, [build("cos", X), build("log", X)], loss).orderBy("k").collect()
    assert scored[0].loss == pytest.approx(want) and scored[1].loss is None and not scored[1].ok
    assert loss_of(data, [build("cos", X)], loss).first().loss == pytest.approx(want)


def test_state_losses_of_odd_groups(spark):
    rows = [("a", 1.0, 1.0, True), ("a", 2.0, 1.0, True), (None, 1.0, 2.0, True), (None, 3.0, 5.0, True), ("c", 1.0, 2.0, True), ("c", 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "g string, p double, y double, ok boolean")
    got = {r.g: (r.loss, r.ok) for r in state_loss(df, r2_loss(), "p", "y", by=["g"], ok="ok").collect()}
    assert got == {"a": (1.0, True), None: (pytest.approx(5 / 4.5), True), "c": (None, False)}
    assert state_loss(df.where("y > 99"), r2_loss(), "p", "y").first().loss == 0.0
    assert state_loss(df.where("y > 99"), r2_loss(), "p", "y", by=["g"]).count() == 0


def test_an_own_loss_in_a_search(noisy):
    """The largest error, which no mean gives; without a slope constants can't be optimised."""
    most = StateLoss("most", (0.0,), lambda s, p, y, w: np.maximum(s, np.abs(p - y).max(initial=0.0)), np.maximum, lambda s: float(s[0]))
    data = ds.Dataset(noisy, ("a", "b"), "t")
    o = Options(operators=OperatorSet.from_names(["+", "*", "cos"]), loss=most, populations=2, population_size=10, niterations=1, ncycles_per_iteration=30, maxsize=7, should_optimize_constants=False)
    rows = SearchEngine(data, o).run().pareto_front().collect()
    assert rows and all(math.isfinite(r.loss) for r in rows)
    with pytest.raises(ValueError, match="no slope"):
        search_constants(data, [X * 2.0], most)


@pytest.mark.parametrize("loss", [ls.mse(), ls.rmse(), ls.huber(0.3), r2_loss(), correlation_loss()], ids=lambda x: x.name)
@pytest.mark.parametrize("weighted", [False, True])
def test_slopes_over_all_rows(noisy, loss, weighted):
    data = ds.Dataset(noisy, ("a", "b"), "t", "w" if weighted else None)
    exprs = [build("cos", X) * 1.2 + Y * -0.3, build("cos", X * Y) + 0.5, build("log", X) * 2.0, X * Y]
    rows = noisy.toPandas()
    x, y, w = rows[["a", "b"]].to_numpy().T.copy(), rows["t"].to_numpy(), rows["w"].to_numpy() if weighted else None
    for e, (value, slopes) in zip(exprs, losses_and_slopes(data, exprs, loss), strict=True):
        p, grad, ok = numpy_grad(e, x)
        if not ok:
            assert value == math.inf and np.isnan(slopes).all()
            continue
        assert value == pytest.approx(loss.numpy(p, y, w)) and slopes == pytest.approx(grad @ loss.numpy_gradient(p, y, w), abs=1e-12)


def test_constants_in_step_take_as_many_scans_as_the_slowest(noisy, monkeypatch):
    data = ds.Dataset(noisy, ("a", "b"), "t")
    exprs = [build("cos", X) * 1.0 + Y * 1.0 + lit(0.0), Y * 2.0, X * Y, build("log", X) * 3.0, build("cos", X) + 1.0]
    scans, scan = [], scoring.losses_and_slopes
    monkeypatch.setattr(scoring, "losses_and_slopes", lambda d, some, loss: scans.append(len(some)) or scan(d, some, loss))
    found = search_constants(data, exprs, ls.mse(), 20)
    assert scans[0] == 5 and scans[-1] < 5
    alone = []
    for e, (better, loss) in zip(exprs, found, strict=True):
        scans.clear()
        ((one, value),) = search_constants(data, [e], ls.mse(), 20)
        alone.append(len(scans))
        assert one.consts == pytest.approx(better.consts) and value == pytest.approx(loss)
    scans.clear()
    search_constants(data, exprs, ls.mse(), 20)
    assert len(scans) == max(alone)
    a, b, t = (noisy.toPandas()[c].to_numpy() for c in "abt")
    fit = np.linalg.lstsq(np.stack([np.cos(a), b, np.ones(400)], axis=1), t, rcond=None)[0]
    assert found[0][0].consts == pytest.approx(fit, abs=1e-5)
    assert found[2] == (exprs[2], pytest.approx(float(np.mean((a * b - t) ** 2)))) and found[3] == (exprs[3], math.inf)


def test_a_step_answers_each_as_it_would_alone():
    goals = [np.array([1.0]), np.array([2.0, -1.0]), np.arange(4.0)]
    objective = lambda g: lambda c: (float(((c - g) ** 2).sum()), 2 * (c - g))
    asked = []

    def answer(which, points):
        asked.append(list(which))
        return [objective(goals[k])(p) for k, p in zip(which, points, strict=True)]

    ends = in_lockstep([trials_of(np.zeros(len(g))) for g in goals], answer)
    for g, (x, value) in zip(goals, ends, strict=True):
        alone = answered(trials_of(np.zeros(len(g))), objective(g))
        assert np.array_equal(x, alone[0]) and value == alone[1] and x == pytest.approx(g, abs=1e-6)
    assert asked[0] == [0, 1, 2]


def test_an_easy_sample_lets_no_worse_formula_win(spark):
    """Rows of the sample fit cos(a); of all rows a ninth lie elsewhere. A parent with its loss over all rows would lose to
    any child with the sample's; now both are the sample's, and the front goes by all rows."""
    rows = spark.range(4000, numPartitions=4).select((F.col("id") / 700.0).alias("a"))
    data = ds.with_roles(rows.withColumn("t", F.when(F.col("a") > 5.1, 9.0).otherwise(F.cos("a"))), "t")
    o = Options(operators=OperatorSet.from_names(["cos", "+", "*"]), populations=2, population_size=20, niterations=3, ncycles_per_iteration=40, maxsize=7, sample_rows=200, seed=2)
    engine = SearchEngine(data, o)
    engine.step()
    seen = engine.members.select("id", "loss", "own_loss", "expr").collect()
    x, y = engine.sample.x, engine.sample.y
    full = {r.k: r.loss for r in score_many(data, [Expr.from_row(json.loads(r.expr), engine.ops) for r in seen], o.loss).collect()}
    for k, r in enumerate(seen):
        value, ok = numpy_eval(Expr.from_row(json.loads(r.expr), engine.ops), x)
        assert math.isnan(r.own_loss) or (r.own_loss == pytest.approx(o.loss.numpy(value, y)) if ok else r.own_loss == math.inf)
        assert r.loss == pytest.approx(full[k], rel=1e-9)
    assert any(abs(r.loss - r.own_loss) > 1e-6 for r in seen)
    worst, losses = math.inf, []
    for _ in range(2):
        best = min(r.loss for r in engine.pareto_front().collect())
        assert best <= worst + 1e-12
        worst = best
        losses.append(best)
        engine.step()
    # what an island takes over is measured on the sample again
    island = Island(o, engine.sample, 0, 9, [search.Member(1, None, 1, X, 1, math.nan, math.nan)], np.ones(7) / 7)
    assert island.members[0].loss == pytest.approx(o.loss.numpy(x[0], y))


def test_constants_are_optimised_over_all_rows_in_the_search(spark, monkeypatch):
    rows = spark.range(3000, numPartitions=4).select((F.col("id") / 500.0).alias("a"))
    data = ds.with_roles(rows.withColumn("t", F.col("a") * 2.5 - 0.75), "t")
    asked = []
    real = search.search_constants
    monkeypatch.setattr(search, "search_constants", lambda d, exprs, *more, **named: asked.append(len(exprs)) or real(d, exprs, *more, **named))
    o = Options(operators=OperatorSet.from_names(["+", "*"]), populations=2, population_size=15, niterations=2, ncycles_per_iteration=40, maxsize=7, sample_rows=100, optimizer_probability=1.0, optimizer_nrestarts=0)
    engine = SearchEngine(data, o).run()
    assert len(asked) == 2 and max(asked) > 5
    assert min(r.loss for r in engine.pareto_front().collect()) < 1e-9
    ids = engine.members.select("id").collect()
    assert len(set(ids)) == len(ids)


def test_a_front_is_read_without_a_scan(spark, noisy, monkeypatch):
    o = Options(operators=OperatorSet.from_names(["+", "*", "cos"]), populations=2, population_size=10, niterations=1, ncycles_per_iteration=20, maxsize=7)
    data = ds.Dataset(noisy, ("a", "b"), "t")
    engine = SearchEngine(data, o).run()
    monkeypatch.setattr(ds.Dataset, "project", lambda self: pytest.fail("the data is read"))
    shot = engine.snapshot()
    monkeypatch.undo()
    exprs = [Expr.from_row(json.loads(r.expr), engine.ops) for r in engine.pareto_members().orderBy("complexity").collect()]
    losses = [r.loss for r in score_many(data, exprs, o.loss).orderBy("k").collect()]
    assert [r["loss"] for r in shot["front"]] == pytest.approx(losses)


@pytest.mark.parametrize("sample_rows", [100_000, 150])
def test_a_search_goes_on_after_its_driver(spark, noisy, tmp_path, sample_rows):
    o = Options(operators=OperatorSet.from_names(["+", "*", "cos"]), populations=2, population_size=10, niterations=3, ncycles_per_iteration=15, maxsize=7, sample_rows=sample_rows, fraction_replaced=0.2)
    rows = spark.createDataFrame(noisy.drop("w").withColumn("id", F.monotonically_increasing_id()).toPandas())
    data, path = ds.Dataset(rows, ("a", "b"), "t"), f"file://{tmp_path}/search"
    started = SearchEngine(data, o, path=path, validation_fraction=0.2, key="id").step(2)
    where = started.snapshot()
    assert sorted(p.name for p in (tmp_path / "search").iterdir() if not p.name.startswith(".")) == ["hof-2", "manifest.json", "members-2", "sample"]
    resumed = SearchEngine.resume(data, o, path)
    assert {k: v for k, v in resumed.snapshot().items() if k != "evals_per_second"} == {k: v for k, v in where.items() if k != "evals_per_second"}
    whole = SearchEngine(data, o, validation_fraction=0.2, key="id").run()
    resumed.run()
    assert [tuple(r) for r in resumed.pareto_front().orderBy("complexity").collect()] == [tuple(r) for r in whole.pareto_front().orderBy("complexity").collect()]
    assert resumed.total_evals == whole.total_evals and np.array_equal(resumed.freq, whole.freq)
    with pytest.raises(ValueError, match="other options"):
        SearchEngine.resume(data, Options(maxsize=8), path)
    with pytest.raises(ValueError, match="other data"):
        SearchEngine.resume(ds.Dataset(rows.limit(300), ("a", "b"), "t"), o, path)


def test_a_file_is_there_whole(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    for text in ('{"a": 1}', '{"a": 2}'):
        store.written_whole(spark, path, text)
        assert store.text_file(spark, path) == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["m.json"]


def test_scopes_delete_what_is_theirs(spark):
    df = spark.range(3)
    outside = store.stored(df, "a")
    with store.scoped(spark) as keep:
        inside, kept = store.stored(df, "b"), keep(store.stored(df, "c"))
        with store.scoped(spark) as deeper:
            passed = deeper(store.stored(df, "d"))
        assert passed.count() == 3
    assert outside.count() == 3 and kept.count() == 3
    for gone in (inside, passed):
        with pytest.raises(Exception):
            spark.read.schema(df.schema).parquet(gone._stored_at).count()


@pytest.mark.parametrize("n", [0, 1, 777, 5000])
def test_a_bootstrap_has_exactly_its_rows(spark, n):
    df = spark.range(1000, numPartitions=7)
    one, two = (ds.bootstrap(df, n, 3).collect() for _ in range(2))
    assert len(one) == n and one == two
    if n == 5000:
        counts = np.bincount([r.id for r in one], minlength=1000)
        assert abs(((counts - 5) ** 2 / 5).sum() - 999) < 6 * math.sqrt(2 * 999)
        assert one != ds.bootstrap(df, n, 4).collect()
    assert ds.bootstrap(df.where("id < 0"), n, 3).count() == 0


def test_batches_come_from_all_rows(spark):
    """With a small sample, minibatches still hold rows that it doesn't."""
    rows = spark.range(5000, numPartitions=4).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("t"))
    o = Options(operators=OperatorSet.from_names(["+", "*"]), populations=2, population_size=6, niterations=1, ncycles_per_iteration=5, maxsize=5, sample_rows=50, batching=True, batch_size=40)
    engine = SearchEngine(ds.with_roles(rows, "t"), o)
    batches = engine._batches()
    assert sorted(batches) == [0, 1] and all(len(b) == 2 and all(len(s.y) == 40 for s in b) for b in batches.values())
    drawn = {v for b in batches.values() for s in b for v in s.x[0]}
    assert len(drawn - set(engine.sample.x[0])) > 100
    assert engine.run().pareto_front().count() > 0


def test_skyline(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), float(b), k) for k, (a, b) in enumerate(zip(rng.integers(0, 300, 2000), rng.integers(0, 500, 2000), strict=True))]
    rows += [(-5, math.nan, 9000), (-6, None, 9001), (None, 1.0, 9002), (-4, math.inf, 9003)]
    df = spark.createDataFrame(rows, "x int, y double, k int").repartition(7)
    got = sorted(map(tuple, front.skyline(df, "x", "y", ["k"]).collect()))
    good = [r for r in rows if r[0] is not None and r[1] is not None and math.isfinite(r[1])]
    want, least = [], math.inf
    for x in sorted({r[0] for r in good}):
        best = min((r for r in good if r[0] == x), key=lambda r: (r[1], r[2]))
        if best[1] < least:
            want.append(best)
            least = best[1]
    assert got == want and len(want) > 3
    assert front.skyline(df.where("x > 999"), "x", "y").count() == 0


def test_nearest_lower_of_many(spark):
    rng = np.random.default_rng(5)
    members = [(f"g{rng.integers(4)}", int(c), k) for k, c in enumerate(rng.integers(5, 40, 60))] + [(None, 3, 900), ("g1", None, 901)]
    asked = [(k, f"g{rng.integers(6)}", int(w)) for k, w in enumerate(rng.integers(0, 45, 500))] + [(900, None, 7), (901, "g1", None)] + [(1000 + k, "g2", 20) for k in range(300)]
    m = spark.createDataFrame(members, "g string, complexity int, arrival int").repartition(3)
    q = spark.createDataFrame(asked, "id int, g string, wanted int").repartition(5)
    out = front.nearest_lower_each(q, m, ["g"], "wanted")
    got = {r.id: (r.found_complexity, r.found_arrival) for r in out.collect()}
    assert len(got) == len(asked)
    for i, g, w in asked:
        own = [(c, a) for h, c, a in members if h == g and c is not None] if g is not None and w is not None else []
        below = [r for r in own if r[0] <= w]
        want = max(below) if below else max(r for r in own if r[0] == min(own)[0]) if own else (None, None)
        assert got[i] == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_nearest_lower_of_many_in_linear_work(spark):
    # no window reaches to the end of its range: Spark makes such a frame anew for each row
    m = spark.createDataFrame([("a", 30, 1), ("a", 31, 2), ("b", 5, 3)], "g string, complexity int, arrival int")
    q = spark.range(40_000, numPartitions=1).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 40).alias("wanted"))
    out = front.nearest_lower_each(q, m, ["g"], "wanted")
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = F.when(F.col("g") == "b", 5).when(F.col("wanted") >= 31, 31).otherwise(30)
    assert out.count() == out.where(F.col("found_complexity") == want).count() == 40_000


def test_differing_values_of_many_pairs(spark):
    rows = [(float(k), float(k % 3), 1.0) for k in range(30)] + [(math.nan, 1.0, 1.0), (math.inf, 1.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(4)
    pairs = [(X + Y, Y + X), (X, X + Y), (X, X + 1e-9), (X * 0.0, build("abs", X * 0.0)), (X, X), (lit(1.0) * Y, Y + 2.0), (X, build("max", X, lit(3.0)))]
    got = {r.k: r.differ for r in differing(df, pairs, ["x", "y"]).collect()}
    # max leaves NaN out, so on NaN rows the last pair has a number on one side alone
    assert got == {0: 0, 1: 20, 2: 0, 3: 0, 4: 0, 5: 33, 6: 5}
    assert [r.differ for r in differing(df.where("x < -1"), pairs, ["x", "y"]).collect()] == [0] * 7


def test_simplified_values_are_a_short_plan(spark, sf):
    # 60 formulas as columns, one on top of another, took 67 s on sf0.1 and 107 s on ten times as many lines
    out = queries.simplified_values(spark, sf)
    assert len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 20
    assert out.where("differ = 0 AND NOT grew").count() == 30


def counted(spark, df):
    """``df``, and how many of its rows have been read."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(seen, df.schema), read


@pytest.mark.parametrize("w", [None, "w"])
def test_equal_rows_are_one_with_a_weight(spark, w):
    some = [(0.0, 1.0, 2.0, 0.5), (-0.0, 1.0, 2.0, 0.5), (0.0, -0.0, 2.0, 0.5), (0.5, 1.0, 2.0, 0.5), (0.5, 1.0, 2.0, -0.25), (math.nan, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame([r for k, r in enumerate(some) for _ in range(20 + k)], "x double, y double, t double, w double").repartition(3)
    data = ds.Dataset(df if w else df.drop("w"), ("x", "y"), "t", w)
    out = ds.packed(data)
    got = sorted(("%r %r" % (r.x, r.y), r["__weight"]) for r in out.df.collect())
    counts = {("%r %r" % s[:2], s[3] if w else 1.0): 0 for s in some}
    for k, s in enumerate(some):
        counts["%r %r" % s[:2], s[3] if w else 1.0] += 20 + k
    assert got == sorted((name, v * n) for (name, v), n in counts.items())
    assert ds.packed(out) is out and ds.packed(data).is_packed
    clean = ds.Dataset(data.df.where("NOT isnan(x)"), data.x, data.y, w)
    exprs = [X * 0.7 + Y, build("atan2", X, Y - 2.0), build("log", X), build("cos", X * 1.5) * 0.3]
    one, two = (losses_and_slopes(d, exprs, ls.mse()) for d in (clean, ds.packed(clean)))
    for (a, da), (b, db) in zip(one, two, strict=True):
        assert a == pytest.approx(b) and da == pytest.approx(db, nan_ok=True)
    one, two = ([(r.k, r.ok, None if r.loss is None else pytest.approx(r.loss)) for r in score_many(d, exprs, ls.rmse()).orderBy("k").collect()] for d in (clean, ds.packed(clean)))
    assert one == two


def test_rows_that_differ_stay_as_they_are(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("t"))
    assert ds.packed(ds.with_roles(df)).df is df
    with pytest.raises(Exception, match="is null in a row"):
        ds.packed(ds.with_roles(df.withColumn("x", F.when(F.col("x") > 5, F.col("x")))))


def test_equal_rows_are_grouped_by_plain_keys(spark, sf, monkeypatch):
    """An array as a key makes each row an object; it took 1.6 times as long over lineitem."""
    plans, real = [], ds.stored
    monkeypatch.setattr(ds, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    lines = ds.with_roles(queries.inputs(spark, sf).select("x", "y", (F.col("x") * F.cos("y")).alias("t")), "t")
    out = ds.packed(lines)
    assert len(plans) == 1 and "Aggregate" in plans[0] and "array(" not in plans[0]
    assert out.df.agg(F.sum("__weight")).first()[0] == lines.df.count() and out.df.count() == lines.df.distinct().count()


def test_signs_of_zeros_in_more_columns_than_a_number_has_bits(spark):
    n = 127
    minus = [set(), {0}, {n - 1}, {61, 62}, set(range(n))]
    some = [tuple(-0.0 if k in m else 0.0 for k in range(n)) for m in minus]
    df = spark.createDataFrame([r for r in some for _ in range(10)], ", ".join(f"c{k} double" for k in range(n)))
    got = ds.packed(ds.with_roles(df)).df.collect()
    assert len(got) == len(some)
    assert {frozenset(k for k, v in enumerate(r[:n]) if math.copysign(1, v) < 0): r["__weight"] for r in got} == {frozenset(m): 10.0 for m in minus}


def test_a_search_sees_whether_rows_repeat_without_a_sketch(spark, monkeypatch):
    """A sketch isn't generated code: over lineitem its scan took three times as long as one that hashes all rows."""

    def sketch(*_):
        raise AssertionError("a sketch of all rows")

    monkeypatch.setattr(ds.F, "approx_count_distinct", sketch)
    monkeypatch.setattr(ds, "HASHES", 256, raising=False)
    for different in (20, 700, 800, 6000):  # 6000 rows: every 23rd hash is looked at
        df = spark.range(6000, numPartitions=3).select((F.col("id") % different).cast("double").alias("x"), (F.col("id") % different * 2.0).alias("t"))
        engine = SearchEngine(ds.Dataset(df, ("x",), "t"), Options(sample_rows=500))
        assert engine.rows.is_packed
        if different in (20, 6000):  # between them the estimate may err, and either is right
            assert engine.rows.df.count() == different
        assert score_many(engine.rows, [X * 2.0 - 1.0], ls.mse()).first().loss == pytest.approx(1.0)


def test_constants_over_rows_that_repeat_read_them_twice(spark):
    rows = spark.range(4000, numPartitions=3).select((F.col("id") % 20 / 10.0).alias("x"), (F.cos(F.col("id") % 20 / 10.0 * 1.3) + 2.0).alias("t"))
    df, read = counted(spark, rows)
    exprs = [build("cos", X * 1.1) + 1.5, X * 0.5 + 1.0]
    found = search_constants(ds.Dataset(df, ("x",), "t"), exprs, ls.mse(), 20)
    assert read.value == 2 * 4000 and found[0][1] < 1e-9
    x, t = (np.array(v) for v in zip(*rows.collect(), strict=True))
    a, b = np.polyfit(x, t, 1)
    assert found[1][0].consts == pytest.approx((a, b), abs=1e-5)


def test_a_search_over_rows_that_repeat_reads_them_a_fixed_number_of_times(spark):
    rows = spark.range(3000, numPartitions=3).select((F.col("id") % 20 / 10.0).alias("x"), (F.cos(F.col("id") % 20 / 10.0) * 2.0).alias("t"))
    df, read = counted(spark, rows)
    o = Options(operators=OperatorSet.from_names(["+", "*", "cos"]), populations=2, population_size=8, niterations=3, ncycles_per_iteration=10, maxsize=7, sample_rows=500)
    engine = SearchEngine(ds.Dataset(df, ("x",), "t"), o)
    began = read.value
    rows_of = engine.run().pareto_front().collect()
    assert engine.sampled and read.value == began
    losses = {r.k: r.loss for r in score_many(engine.data, [Expr.from_row(json.loads(r.expr), engine.ops) for r in engine.pareto_members().orderBy("complexity").collect()], o.loss).collect()}
    assert [r.loss for r in rows_of] == pytest.approx([losses[k] for k in range(len(rows_of))])


def test_a_search_reads_its_rows_four_times_before_it_begins(spark):
    """To count them, for the sample, to see whether they repeat, and to pack them, or for the baseline where they differ."""
    for different in (20, 3000):
        x = F.col("id") % different / 10.0
        df, read = counted(spark, spark.range(3000, numPartitions=3).select(x.alias("x"), (x * 2.0 - 1.0).alias("t")))
        engine = SearchEngine(ds.Dataset(df, ("x",), "t"), Options(sample_rows=500))
        assert read.value == 4 * 3000 and engine.sampled and len(engine.sample.y) == 500
        assert engine.rows.df.count() == different
        assert engine.baseline == pytest.approx(np.mean([(k % different / 5.0 - 1.0) ** 2 for k in range(3000)]), rel=1e-11)


@pytest.mark.parametrize("name", ["search_square_recovery", "search_front"])
def test_registered_searches_read_their_lines_a_fixed_number_of_times(spark, sf, monkeypatch, name):
    """With a sample smaller than the table, as on larger ones: all reads are before the first iteration."""
    engines, real = [], queries.inputs(spark, sf)
    lines, read = counted(spark, real)
    monkeypatch.setattr(queries, "inputs", lambda *_: lines)
    monkeypatch.setattr(queries, "SearchEngine", lambda data, o: engines.append((SearchEngine(data, replace(o, sample_rows=500, populations=2, niterations=2, ncycles_per_iteration=20)), read.value)) or engines[0][0])
    queries.queries()[name](spark, sf).collect()
    ((engine, began),) = engines
    assert engine.sampled and engine.iteration == 2 and 0 < began == read.value
    assert engine.rows.df.count() == real.select("x", "y").distinct().count()


def test_search_front_reads_its_lines_five_times(spark, sf, monkeypatch):
    """Four times before the search begins, and at most once to see that there is a row; the front reads them no more."""
    lines, read = counted(spark, real := queries.inputs(spark, sf))
    monkeypatch.setattr(queries, "inputs", lambda *_: lines)
    monkeypatch.setattr(queries, "SearchEngine", lambda data, o: SearchEngine(data, replace(o, sample_rows=500, populations=2, niterations=2, ncycles_per_iteration=20)))
    rows = queries.search_front(spark, sf).orderBy("complexity").collect()
    assert 4 * real.count() <= read.value <= 5 * real.count()
    assert rows and all(a.loss > b.loss for a, b in zip(rows, rows[1:], strict=False))


def test_weighted_metrics_with_a_large_offset(spark):
    rng = np.random.default_rng(6)
    y, w = 1e9 + rng.normal(size=300), rng.uniform(0, 3, 300)
    p = y + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(p, y, w, strict=True)], "yhat double, y double, w double").repartition(6)
    r = metrics(df, w="w").first()
    my = np.average(y, weights=w)
    assert r.r2 == pytest.approx(1 - (w * (p - y) ** 2).sum() / (w * (y - my) ** 2).sum(), rel=1e-6)
    assert r["corr"] == pytest.approx(((y - my) * (p - p.mean())).sum() / math.sqrt(((y - my) ** 2).sum() * ((p - p.mean()) ** 2).sum()), rel=1e-6)
    assert r.n == 300 and r.max_abs_err == pytest.approx(np.abs(p - y).max())
    plan = metrics(df, w="w")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and metrics(df.where("y < 0"), w="w").first().n == 0


def test_streams_drop_late_rows_and_their_state_falls(spark, sf):
    def rows():
        return replayed(spark, sf).withColumn("x", F.col("value") / 10.0).withColumn("goal", (F.col("event_id") % 7).cast("double"))

    _, progress = played(spark, windowed_loss(rows(), X + 0.0, ["x"], "goal", ls.mse(), "ts", "6 hours", "1 day"), "w")
    state = [p["stateOperators"][0] for p in progress]
    held = [s["numRowsTotal"] for s in state]
    assert len([p for p in progress if p["numInputRows"]]) == 6 and held[-1] < max(held) / 2
    assert sum(s["numRowsDroppedByWatermark"] for s in state) > 10
    out, progress = played(spark, windowed_state_loss(rows(), X + 0.0, ["x"], "goal", correlation_loss(), "ts", ["event_type"], "6 hours", "1 day"), "s")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert held[-1] < max(held) / 2
    assert out.count() == out.select("event_type", "start").distinct().count() > 50


def test_exact_split_reads_its_source_twice(spark):
    count = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    df = spark.range(1000, numPartitions=3).mapInArrow(seen, "id long")
    out = ds.exact_split(df, 0.25, "id", 1)
    assert count.value == 2000
    assert out.where("is_val").count() == 250
