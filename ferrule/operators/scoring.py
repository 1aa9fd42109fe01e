"""Losses of expressions over data of any size.

``loss_of`` compiles a few formulas into one aggregation (generated code, partial sums). ``score_many`` takes hundreds:
they go to the tasks as one program that computes equal subtrees once, NumPy evaluates each Arrow batch, and each task
hands on one partial state a formula: two sums, or the state of a loss that is more than a mean (``StateLoss``). Both read
the data once. ``search_constants`` improves the constants of many formulas at once, a scan of all rows for each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ferrule.evolve.optim import Trials, bfgs_trials, trials_of
from ferrule.functions.losses import Loss
from ferrule.functions.scalar import NUMPY
from ferrule.functions.state_losses import StateLoss
from ferrule.plans.compile import evaluate, numpy_grad
from ferrule.plans.expr import Expr, zero
from ferrule.plans.program import Program, Survivors, without_constants
from ferrule.plans.store import discard
from ferrule.sources.dataset import Dataset, packed

#: Parts in which a key's states are merged first, and keys whose states a task holds at once.
FAN_IN, HELD = 64, 4096


def loss_of(data: Dataset, exprs: Sequence[Expr], loss: Loss | StateLoss, names: Sequence[str] | None = None) -> DataFrame:
    """A row for each expression: name, loss (null where it isn't finite throughout) and ok."""
    names = list(names or (str(i) for i in range(len(exprs))))
    if isinstance(loss, StateLoss):
        shown = data.df.sparkSession.createDataFrame(list(enumerate(names)), "k long, name string")
        return score_many(data, exprs, loss).join(F.broadcast(shown), "k").select("name", "loss", "ok")  # as many as the call has
    df = data.project()
    for k, e in enumerate(exprs):
        df = evaluate(df, e, data.x, f"__v{k}", f"__ok{k}")
    w = F.col(data.w) if data.w else None
    aggs = []
    for k in range(len(exprs)):
        ok = F.coalesce(F.every(f"__ok{k}"), F.lit(True))
        aggs.append(F.struct(F.lit(names[k]).alias("name"), F.when(ok, loss.aggregate(F.col(f"__v{k}"), F.col(data.y), w)).alias("loss"), ok.alias("ok")))
    return df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def baseline_loss(data: Dataset, loss: Loss | StateLoss) -> float | None:
    """The loss of the constant 0; None where it isn't finite."""
    row = loss_of(data, [zero()], loss).first()
    return row.loss if row.loss is not None and np.isfinite(row.loss) else None


def _rows(batch: pa.RecordBatch, n_x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Features, y and weights of a batch of a projected dataset."""
    cols = [np.asarray(c, dtype=np.float64) for c in batch.columns]
    return np.stack(cols[:n_x]), cols[n_x], cols[n_x + 1] if len(cols) > n_x + 1 else None


def merged_states(parts: DataFrame, keys: list[str], loss: StateLoss) -> DataFrame:
    """``parts``: keys, ``state`` and ``good``, a row for each task that has met the key. The states of a key are merged in a
    tree: in ``FAN_IN`` parts by the number of the task, and then these, so that no key's states are all one task's work."""
    names = [*keys, "state", "good"]
    fields = parts.select(*keys).schema.fields
    schema = parts.select(*names).schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, state = tuple(row[k] for k in keys), np.array(row["state"], float)
                if key in held:
                    held[key] = [loss.merge(held[key][0], state), held[key][1] and row["good"]]
                    continue
                if len(held) >= HELD:  # rows come in the order of keys, so what is held is done
                    yield _states(held, fields)
                    held = {}
                held[key] = [state, row["good"]]
        if held:
            yield _states(held, fields)

    dealt = parts.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).repartition(*keys, "__part")
    if not keys:
        return dealt.select(*names).mapInArrow(merge, schema).coalesce(1).mapInArrow(merge, schema)
    some = dealt.sortWithinPartitions(*keys).select(*names).mapInArrow(merge, schema)
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def _states(held: dict[tuple, list], fields: list[T.StructField]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in held], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([s.tolist() for s, _ in held.values()], pa.list_(pa.float64())), pa.array([bool(g) for _, g in held.values()])], [*(f.name for f in fields), "state", "good"])


def finished(states: DataFrame, keys: list[str], loss: StateLoss) -> DataFrame:
    """Keys, loss (null where some row failed) and ok."""
    schema = T.StructType([*states.select(*keys).schema.fields, T.StructField("loss", T.DoubleType()), T.StructField("ok", T.BooleanType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(len(keys) + 1).to_pylist()
            with np.errstate(all="ignore"):
                values = [float(loss.finish(np.array(s, float))) if g else None for s, g in zip(batch.column(len(keys)).to_pylist(), good, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(values, pa.float64()), pa.array(good, pa.bool_())], [*keys, "loss", "ok"])

    return states.select(*keys, "state", "good").mapInArrow(finish, schema)


def _groups(batch: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The rows of each group of a batch by its first ``n`` columns."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in range(n):
        own = pc.dictionary_encode(batch.column(k), null_encoding="encode")
        _, code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
        yield tuple(batch.column(k)[int(rows[0])].as_py() for k in range(n)), rows


def states_by(df: DataFrame, loss: StateLoss, yhat: str, y: str, w: str | None = None, by: Sequence[str] = (), ok: str | None = None) -> DataFrame:
    """The finished ``state`` of all rows, or of each group of columns ``by`` (null is a group), and ``good``.

    A task makes one state a group, and the states are merged in a tree."""
    by = list(by)
    fields = df.select(*by).schema.fields
    schema = T.StructType([*fields, T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("good", T.BooleanType())])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            p, t, v = (np.asarray(batch.column(len(by) + k), dtype=np.float64) for k in range(3))
            good = batch.column(len(by) + 3).to_numpy(zero_copy_only=False).astype(bool)
            for key, rows in _groups(batch, len(by)):
                if key not in held:
                    if len(held) >= HELD:
                        yield _states(held, fields)
                        held = {}
                    held[key] = [loss.empty(), True]
                with np.errstate(all="ignore"):
                    held[key] = [loss.update(held[key][0], p[rows], t[rows], v[rows] if w else None), held[key][1] and bool(good[rows].all())]
        if held:
            yield _states(held, fields)

    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(*by, F.col(yhat).cast("double").alias("__p"), F.col(y).cast("double").alias("__y"), weight.alias("__v"), F.coalesce(F.col(ok), F.lit(False)).alias("__g") if ok else F.lit(True).alias("__g"))
    parts = rows.mapInArrow(states, schema)
    if not by:  # no rows have a state too
        parts = parts.unionByName(df.sparkSession.createDataFrame([(list(loss.init), True)], "state array<double>, good boolean"))
    return merged_states(parts, by, loss)


def state_loss(df: DataFrame, loss: StateLoss, yhat: str, y: str, w: str | None = None, by: Sequence[str] = (), ok: str | None = None) -> DataFrame:
    """``loss`` and ``ok`` of all rows, or of each group. ``ok`` names the flag of a row's prediction: where it is false
    somewhere, the group has no loss."""
    return finished(states_by(df, loss, yhat, y, w, by, ok), list(by), loss)


def score_many(data: Dataset, exprs: Sequence[Expr], loss: Loss | StateLoss) -> DataFrame:
    """(k, loss, ok) of each expression, by its place in the list. Expressions that fail give a null loss."""
    n_x = len(data.x)
    formulas = list(exprs)  # a few hundred nodes; they travel with the task

    if isinstance(loss, StateLoss):
        return finished(_states_of(data, formulas, loss), ["k"], loss)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, totals = Survivors(formulas), np.zeros((len(formulas), 2))
        for batch in batches:
            x, y, w = _rows(batch, n_x)
            weight = float(batch.num_rows if w is None else w.sum())

            def take(k: int, value: np.ndarray, y=y, w=w, weight=weight) -> None:
                p = loss.point(NUMPY, value - y)
                totals[k] += (float((p if w is None else p * w).sum()), weight)

            program.run(x, take)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), pa.array(totals[:, 0]), pa.array(totals[:, 1]), pa.array(program.good)], ["k", "total", "weight", "good"])

    parts = data.project().mapInArrow(sums, "k long, total double, weight double, good boolean")
    whole = parts.groupBy("k").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"), F.every("good").alias("ok"))
    return whole.select("k", F.when(F.col("ok"), loss.finish(F.col("total"), F.col("weight"))).alias("loss"), "ok")


def differing(df: DataFrame, pairs: Sequence[tuple[Expr, Expr]], features: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """(k, differ) of each pair of expressions, by its place: at how many rows their values differ by more than
    ``tolerance`` times 1 + the first one's size. NaN is equal to NaN, and an infinity to itself; nulls are NaN.

    One scan, and one program for all of them; a task hands on a count for each pair."""
    n = len(pairs)
    formulas = [e for pair in pairs for e in pair]
    for e in formulas:
        e.validate(len(features))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, totals = Program(formulas), np.zeros(n, np.int64)
        for batch in batches:
            x = np.stack([np.asarray(c, dtype=np.float64) for c in batch.columns])
            first: dict[int, np.ndarray] = {}  # of each pair the value that came first

            def take(at: int, value: np.ndarray, first=first) -> None:
                k = at // 2
                if k not in first:
                    first[k] = value.copy()
                    return
                a, b = (value, first.pop(k)) if at % 2 == 0 else (first.pop(k), value)
                near = np.abs(a - b) <= tolerance * (1 + np.abs(a))
                if not near.all():
                    near = np.where(np.isfinite(a) & np.isfinite(b), near, (a == b) | (np.isnan(a) & np.isnan(b)))
                    totals[k] += len(near) - int(near.sum())

            program.run(x, take, check=False)
        yield pa.RecordBatch.from_arrays([pa.array([totals.tolist()], pa.list_(pa.int64()))], ["differ"])

    parts = df.select(*(F.col(c).cast("double").alias(c) for c in features)).mapInArrow(counts, "differ array<long>")
    whole = parts.agg(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(F.sum(F.get("differ", F.lit(k))), F.lit(0).cast("long")).alias("differ")) for k in range(n))).alias("all"))
    return whole.select(F.inline("all"))


def losses_and_slopes(data: Dataset, exprs: Sequence[Expr], loss: Loss | StateLoss) -> list[tuple[float, np.ndarray]]:
    """Each expression's loss over all rows and its slope by each of its constants; infinite, and NaN, where it fails.

    One scan for all of them, whose tasks hand on as many sums as there are constants: subtrees without constants are
    computed once for all expressions. A loss whose slopes follow from its finished state takes a scan for the states first."""
    formulas, subtrees = without_constants(exprs, len(data.x))
    n_x, stateful = len(data.x), isinstance(loss, StateLoss)
    ends: dict[int, tuple[np.ndarray, bool]] = {}
    if stateful:
        if loss.slope is None:
            raise ValueError(f"{loss.name} has no slope")
        ends = {r.k: (np.array(r.state), r.good) for r in _states_of(data, exprs, loss).collect()}
    widths = [2 + len(e.consts) for e in formulas]
    begins = np.cumsum([0, *widths])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, totals = Survivors(subtrees), np.zeros(begins[-1])
        good = np.array([ends[k][1] if stateful else True for k in range(len(formulas))], bool)
        for batch in batches:
            x, y, w = _rows(batch, n_x)
            more = np.full((len(subtrees), len(y)), np.nan)
            program.run(x, more.__setitem__)
            every = np.vstack([x, more])
            weight = float(len(y) if w is None else w.sum())
            lost = {n_x + k for k in np.flatnonzero(~program.good)}
            for k, e in enumerate(formulas):
                if not good[k]:
                    continue
                value, grad, ok = numpy_grad(e, every)
                good[k] = ok and not any(getattr(n, "feature", None) in lost for n in e.nodes)
                if not good[k]:
                    continue
                with np.errstate(all="ignore"):
                    if stateful:
                        point, slope = np.zeros(1), loss.slope(ends[k][0], value, y, w)
                    else:
                        point, slope = loss.point(NUMPY, value - y), loss.slope(NUMPY, value - y)
                        point, slope = (point, slope) if w is None else (point * w, slope * w)
                    totals[begins[k] : begins[k + 1]] += [point.sum(), weight, *(grad @ slope)]
        at = np.repeat(np.arange(len(formulas)), widths)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.arange(len(at)) - begins[at]), pa.array(totals), pa.array(good[at])], ["k", "slot", "total", "good"])

    parts = data.project().mapInArrow(sums, "k long, slot long, total double, good boolean")
    found = [np.zeros(n) for n in widths]
    fine = [True] * len(formulas)
    # as many rows as the expressions have constants, and two each
    for r in parts.groupBy("k", "slot").agg(F.sum("total").alias("total"), F.every("good").alias("good")).collect():
        found[r.k][r.slot] = r.total
        fine[r.k] = fine[r.k] and r.good
    out = []
    for k, sums_of in enumerate(found):
        total, weight, slopes = sums_of[0], sums_of[1], sums_of[2:]
        with np.errstate(all="ignore"):
            value = float(loss.finish(ends[k][0])) if stateful else loss.whole(total, weight)
        if not fine[k] or not np.isfinite(value):
            out.append((np.inf, np.full(len(slopes), np.nan)))
        elif stateful:
            out.append((value, slopes))
        else:
            scale = 0.0 if not weight or (loss.root and value == 0) else 1.0 / weight / (2.0 * value if loss.root else 1.0)
            out.append((value, slopes * scale))
    return out


def _states_of(data: Dataset, exprs: Sequence[Expr], loss: StateLoss) -> DataFrame:
    """k, state and good of each expression over all rows."""
    n_x, formulas = len(data.x), list(exprs)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, held = Survivors(formulas), [loss.empty() for _ in formulas]
        for batch in batches:
            x, y, w = _rows(batch, n_x)

            def take(k: int, value: np.ndarray, y=y, w=w) -> None:
                held[k] = loss.update(held[k], value, y, w)

            program.run(x, take)
        yield _states({(k,): [held[k], program.good[k]] for k in range(len(formulas))}, [T.StructField("k", T.LongType())])

    return merged_states(data.project().mapInArrow(states, "k long, state array<double>, good boolean"), ["k"], loss)


def in_lockstep(trials: Sequence[Trials], answer: Callable[[list[int], list[np.ndarray]], list[tuple[float, np.ndarray]]]) -> list[tuple[np.ndarray, float]]:
    """What each of many optimisations ends with: in each step all that go on name a point, and one answer is for all."""
    out: list[tuple[np.ndarray, float] | None] = [None] * len(trials)
    points = {k: next(t) for k, t in enumerate(trials)}
    while points:
        order = sorted(points)
        answers = answer(order, [points[k] for k in order])
        points = {}
        for k, found in zip(order, answers, strict=True):
            try:
                points[k] = trials[k].send(found)
            except StopIteration as end:
                out[k] = end.value
    return out


def search_constants(data: Dataset, exprs: Sequence[Expr], loss: Loss | StateLoss, iterations: int = 8, restarts: int = 0, seed: int = 0, f_calls: int = 10_000, answer: Callable | None = None) -> list[tuple[Expr, float]]:
    """The expressions with constants of less loss over all rows, and their losses (infinite where they fail).

    All optimisations go in step: the driver keeps each one's inverse Hessian and line search, and a scan of all rows
    answers the points that all of them ask for. So the number of scans is that of the slowest one's steps, however many
    expressions there are; where rows repeat, each scan but the first two is of the different ones (``packed``). An
    expression starts from its own constants, and ``restarts`` times from changed ones; it stays
    as it is where no start finds a lesser loss."""
    rng = np.random.default_rng(seed)
    of, trials = [], []
    for k, e in enumerate(exprs):
        start = np.array(e.consts)
        for r in range(1 + restarts if len(start) else 1):
            of.append(k)
            at = start if r == 0 else start * (1 + 0.5 * rng.standard_normal(len(start)))
            trials.append(trials_of(at, iterations, f_calls) if len(start) else bfgs_trials(start, 0))
    # a state may take weights for something else than how often a row comes
    rows = data if answer or not trials or isinstance(loss, StateLoss) else packed(data)
    scan = answer or (lambda some: losses_and_slopes(rows, some, loss))
    first: dict[int, float] = {}  # what an expression's own constants give

    def answered(which: list[int], points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        found = scan([exprs[of[i]].with_constants(tuple(map(float, p))) for i, p in zip(which, points, strict=True)])
        for i, (value, _) in zip(which, found, strict=True):
            if i == 0 or of[i] != of[i - 1]:
                first.setdefault(of[i], value)
        return found

    best = [(e, np.inf) for e in exprs]
    try:
        ends = in_lockstep(trials, answered)
    finally:
        if rows.df is not data.df:
            discard(rows.df)
    for k, value in first.items():
        best[k] = (exprs[k], value)
    for k, (x, value) in zip(of, ends, strict=True):
        if np.isfinite(value) and value < best[k][1]:
            best[k] = (exprs[k].with_constants(tuple(map(float, x))), value)
    return [(e, float(value)) for e, value in best]


def optimised_constants(data: Dataset, expr: Expr, loss: Loss | StateLoss, iterations: int = 8) -> tuple[Expr, float]:
    """``search_constants`` of one expression, by BFGS; the loss is None where it fails."""
    ((found, value),) = search_constants(data, [expr], loss, iterations)
    return found, value


def loss_and_gradient(data: Dataset, expr: Expr, loss: Loss) -> DataFrame:
    """slot, slope and loss: d loss / d constant for each constant, and the loss itself, null where some row fails."""
    slopes = constant_gradient(data, expr, loss)
    return slopes.join(F.broadcast(loss_of(data, [expr], loss).select("loss")))  # one row


def constant_gradient(data: Dataset, expr: Expr, loss: Loss) -> DataFrame:
    """d loss / d constant for each constant of the pool: slot and slope.

    One aggregation: slopes, loss and weight are summed together, and what all rows share is divided out after."""
    from ferrule.plans.compile import gradient

    df = gradient(data.project(), expr, data.x, variables=False)
    w = F.col(data.w) if data.w else None
    own = loss.gradient(F.col("yhat"), F.col(data.y), F.lit(1.0), w, F.lit(0.5))  # of a root, 0.5 cancels its factor
    total, weight = loss.parts(F.col("yhat"), F.col(data.y), w)
    sums = df.agg(F.array(*(F.sum(own * F.get("grad", F.lit(k))) for k in range(len(expr.consts)))).alias("sums"), total.alias("total"), weight.alias("weight"))
    whole = loss.finish(F.col("total"), F.col("weight"))
    shared = F.lit(1.0)
    if loss.root:
        good = (whole > 0) & ~F.isnan(whole) & (whole < float("inf"))
        shared = F.when(good, 1.0 / (2.0 * F.when(whole > 0, whole).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0))
    div = F.when(F.coalesce("weight", F.lit(0.0)) == 0.0, F.lit(0.0)).otherwise(F.lit(1.0) / F.when(F.col("weight") == 0.0, F.lit(1.0)).otherwise(F.col("weight")))
    return sums.select(F.posexplode("sums").alias("slot", "sum"), (shared * div).alias("share")).select("slot", (F.col("sum") * F.col("share")).alias("slope"))
