"""Registered queries about the steps of a search and what it is made of, over whole tables.

Where a step draws random numbers, its query counts how often the step breaks a rule that holds for all draws.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import losses as ls
from ferrule.functions.scalar import OperatorSet, register
from ferrule.functions.state_losses import correlation_loss, r2_loss
from ferrule.operators import front
from ferrule.operators.options import Options
from ferrule.operators.scoring import score_many, search_constants, state_loss
from ferrule.operators.search import SearchEngine
from ferrule.operators.session import SearchSession
from ferrule.plans.compile import evaluate, gradient
from ferrule.plans.expr import Expr, build, var
from ferrule.plans.store import place, stored
from ferrule.queries import inputs, members, predictions, table
from ferrule.sources import dataset as ds
from ferrule.streaming.scorer import windowed_loss, windowed_state_loss


def custom_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and slope of a custom operator over all rows."""
    square = register("square", 1, lambda m, v: v * v, [lambda m, v: v * 2.0])
    g = gradient(inputs(spark, sf_dir), Expr.apply(square, var(0) + var(1)), ["x", "y"])
    return g.select("l_orderkey", "l_linenumber", F.round("yhat", 6).alias("yhat"), (F.round(F.get("grad", F.lit(0)), 6) + 0.0).alias("slope"), "ok")


def losses_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"mse": ls.parse_loss("MSE"), "mae": ls.parse_loss(" mae "), "huber": ls.parse_loss("Huber", 1.0), "logcosh": ls.parse_loss("log-cosh"), "lp": ls.parse_loss("Lp", 3.0), "quantile": ls.parse_loss("QUANTILE", 0.3), "epsins": ls.parse_loss("epsilon_insensitive", 0.1)}
    named["custom"] = ls.custom_loss("fourth", lambda m, r: r * r * r * r, lambda m, r: r * r * r * 4.0)
    rows = predictions(spark, sf_dir)
    whole = rows.agg(F.array(*(F.struct(F.lit(k).alias("loss"), F.round(v.aggregate(F.col("yhat"), F.col("z"), None), 6).alias("value")) for k, v in named.items())).alias("all"))
    return whole.select(F.inline("all"))


def unchecked_and_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logarithm of signed numbers, with and without the check, and its gradient filled where it fails."""
    df = evaluate(inputs(spark, sf_dir), build("log", var(0)), ["x"])
    df = evaluate(df, build("log", var(0)), ["x"], "free", "free_ok", check=False)
    df = gradient(df, build("log", var(0)), ["x"], out="v", grad="g", ok="gok", fill=True)
    return df.agg(F.count_if("ok").alias("ok"), F.count_if("free_ok").alias("unchecked"), F.count_if(F.isnan(F.get("g", F.lit(0)))).alias("filled"))


def csv_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file without a header, of which the rows go that have a cell that is no number or isn't finite."""
    path = place(spark, "csv")
    cell = F.when(F.col("s_suppkey") % 3 == 0, "n/a").when(F.col("s_suppkey") % 5 == 0, "Infinity").otherwise(F.concat(F.lit(" "), F.col("s_acctbal").cast("string")))
    table(spark, sf_dir, "supplier").select("s_suppkey", cell.alias("cell")).write.csv(path)
    df = ds.read_csv(spark, path, header=False, on_bad_rows="drop")
    return df.agg(F.lit(",".join(df.columns)).alias("columns"), F.count("*").alias("n"), F.sum("col_0").cast("long").alias("keys"))


def search_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by requests: their events, and whether a member's metrics agree with its loss in the front."""
    data = ds.with_roles(inputs(spark, sf_dir).select("x", "y", (F.col("x") * F.col("y")).alias("t")), "t")
    o = Options(operators=OperatorSet.from_names(["+", "*"]), populations=2, population_size=10, niterations=2, ncycles_per_iteration=10, maxsize=5)
    session = SearchSession(lambda: SearchEngine(data, o))
    rows = []
    for request in ({"type": "step"}, {"type": "init"}, {"type": "step"}, {"type": "start"}, {"type": "evaluate"}, {"type": "pause"}, {"type": "reset"}):
        if request["type"] == "evaluate":
            best = session.engine.snapshot()["front"][-1]
            request |= {"member": best["id"]}
        events = list(session.answer(request))
        holds = events[0]["type"] != "eval_result" or abs(events[0]["result"]["mse"] - best["loss"]) <= 1e-6 * (1 + best["loss"])
        rows.append((len(rows), request["type"], " ".join(dict.fromkeys(e["type"] for e in events)), holds))
    return spark.createDataFrame(rows, "n int, request string, events string, holds boolean")


def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled orders are the same rows, in another order, which the seed repeats."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    place_of = lambda seed: ds.shuffled(orders, seed).withColumn("place", F.monotonically_increasing_id())
    one, two = place_of(3), orders.withColumn("place", F.monotonically_increasing_id())
    both = one.join(two.select("o_orderkey", F.col("place").alias("before")), "o_orderkey")
    return both.agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"), (F.abs(F.corr("place", "before")) < 0.2).alias("mixed"))


def hof_bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hall of fame that is brought up to date by batches of members is that of all of them."""
    rows, best = members(spark, sf_dir), None
    for k in range(3):
        batch = rows.where(F.col("pop") % 3 == k)
        best = front.best_by_complexity(batch if best is None else best.unionByName(batch), 30)
    return best


def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded sample has as many rows as asked for, without replacement, from all over the table."""
    lines = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().cast("double").alias("row"), F.col("l_quantity").cast("double").alias("t"))
    whole, n = lines.agg(F.avg("row").alias("m"), F.stddev("row").alias("s")).first(), 2000
    x, y, _ = ds.bounded_sample(ds.with_roles(lines), n, 4)
    return spark.createDataFrame([(len(y), len(set(x[0].tolist())), bool(abs(x[0].mean() - whole.m) < 5 * whole.s / n**0.5))], "n int, different int, everywhere boolean")


def bootstrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample with replacement has exactly as many rows as asked for, also when it is drawn again, and none that isn't
    there; chi-squared of how often each row comes is as it should be."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    draws = 2 * n + 7
    some = ds.bootstrap(orders, draws, 5).groupBy("o_orderkey").agg(F.count("*").alias("k"))
    both = orders.join(some, "o_orderkey", "full").select("o_orderkey", F.coalesce("k", F.lit(0)).alias("k"))
    same = ds.bootstrap(orders, draws, 5).groupBy("o_orderkey").agg(F.count("*").alias("again"))
    expected = draws / n
    square = F.sum((F.col("k") - expected) * (F.col("k") - expected) / expected)
    out = both.join(same, "o_orderkey", "left").agg(F.sum("k").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("k") != F.coalesce("again", F.lit(0))).alias("other"), square.alias("square"))
    return out.select("rows", "keys", "other", (F.abs(F.col("square") - (n - 1)) < 6 * (2 * n) ** 0.5).alias("even"))


def skyline_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a larger quantity than all cheaper ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", (-F.col("l_quantity").cast("double")).alias("y"), "l_orderkey", "l_linenumber")
    return front.skyline(rows, "l_extendedprice", "y", ["l_orderkey", "l_linenumber"]).select("l_extendedprice", "l_orderkey", "l_linenumber", (-F.col("y")).alias("quantity"))


def skyline_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are cheaper than all of a lesser quantity, by quantity times a rising price: the front of all of them."""
    rows = table(spark, sf_dir, "lineitem").select((60 - F.col("l_quantity")).alias("x"), F.col("l_extendedprice").alias("y"), "l_orderkey", "l_linenumber")
    return front.skyline(rows, "x", "y", ["l_orderkey", "l_linenumber"])


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the member that it asks for, of its priority's members: every third size that some order has."""
    orders = table(spark, sf_dir, "orders")
    sized = orders.where(F.col("o_orderkey") % 3 == 0).withColumn("complexity", (F.col("o_orderkey") % 47 + 5).cast("int"))
    members_of = sized.select("o_orderpriority", "complexity", F.col("o_orderkey").alias("arrival"), F.col("o_totalprice").alias("price")).where("complexity % 2 = 1")
    asked = orders.select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 60).alias("wanted"))
    return front.nearest_lower_each(asked, members_of, ["o_orderpriority"], "wanted").select("o_orderkey", "o_orderpriority", "wanted", "found_complexity", "found_arrival", "found_price")


def search_constants_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants of three linear formulas over all rows, all of them in step; least squares has a closed form."""
    data = ds.with_roles(inputs(spark, sf_dir).select("x", "y", "z"), "z")
    x, y = var(0), var(1)
    goals = {"x": x, "y": y, "xy": x * y}
    found = search_constants(data, [g * 0.5 + 1.0 for g in goals.values()], ls.mse(), 30)
    return spark.createDataFrame([(k, round(e.consts[0], 4), round(e.consts[1], 4), round(loss, 5)) for k, (e, loss) in zip(goals, found, strict=True)], "formula string, slope double, intercept double, loss double")


def state_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - R² and 1 - correlation of each flag's rows, with and without weights."""
    rows = predictions(spark, sf_dir)
    out = None
    for name, loss in (("r2", r2_loss()), ("correlation", correlation_loss())):
        for w in (None, "w"):
            one = state_loss(rows, loss, "yhat", "z", w, ["l_returnflag"]).select(F.lit(name).alias("name"), F.lit(w is not None).alias("weighted"), "l_returnflag", F.round("loss", 6).alias("loss"), "ok")
            out = one if out is None else out.unionByName(one)
    return out


def score_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses that are no means, of several formulas in one pass; one of them fails on rows of no quantity below 25."""
    data = ds.with_roles(inputs(spark, sf_dir).select("x", "y", "z"), "z")
    x, y = var(0), var(1)
    formulas = [x, x * y, x * y + x, build("log", x), build("cos", x * y)]
    out = None
    for name, loss in (("r2", r2_loss()), ("correlation", correlation_loss())):
        one = score_many(data, formulas, loss).select(F.lit(name).alias("name"), "k", F.round("loss", 6).alias("loss"), "ok")
        out = one if out is None else out.unionByName(one)
    return out


def search_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that is cut and resumed by another engine, and one that is not: whether their fronts agree row for row."""
    data = ds.with_roles(inputs(spark, sf_dir).select("x", "y", (F.col("x") * F.col("y") + F.col("z")).alias("t")), "t")
    o = Options(operators=OperatorSet.from_names(["+", "*", "cos"]), populations=3, population_size=12, niterations=3, ncycles_per_iteration=15, maxsize=7)
    path = place(spark, "search")
    SearchEngine(data, o, path=path).step(1)
    resumed, whole = SearchEngine.resume(data, o, path).run(), SearchEngine(data, o).run()
    one, two = ([tuple(r) for r in e.pareto_front().orderBy("complexity").collect()] for e in (resumed, whole))
    return spark.createDataFrame([(resumed.iteration, len(one) == len(two), one == two, resumed.total_evals == whole.total_evals)], "iterations int, as_many boolean, agree boolean, evals boolean")


#: Chunks that events are replayed in, and files of each.
CHUNKS, FILES = 6, 2


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: chunks of time, one a micro-batch, with some events three chunks late."""
    # instants, whatever the session's time zone
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))")
    events = table(spark, sf_dir, "events").withColumn("ts", instant)
    a, z = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    # whole seconds, so that other engines cut at the same places
    own = F.least(F.floor((F.unix_seconds("ts") - a // 1_000_000) * CHUNKS / F.lit((z - a) // 1_000_000 + 1)).cast("int"), F.lit(CHUNKS - 1))
    chunk = F.when(F.col("event_id") % 10 == 3, F.least(own + 3, F.lit(CHUNKS - 1))).otherwise(own)
    to = place(spark, "replay")
    rows = stored(events.select("event_id", "ts", "event_type", "value", chunk.alias("chunk")), "events")
    for k in range(CHUNKS):  # one after another, so that files are as old as their chunks
        rows.where(F.col("chunk") == k).repartition(FILES, "event_id").write.mode("append").parquet(to)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(to)


def played(spark: SparkSession, out: DataFrame, name: str) -> tuple[DataFrame, list[dict]]:
    """What a stream has written when all its files are read, and the progress of its micro-batches."""
    to = place(spark, name)
    query = out.writeStream.format("parquet").option("path", to).option("checkpointLocation", place(spark, "stream")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(to), [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The losses of event-time windows that close: late rows are dropped, and each window is given out once."""
    rows = replayed(spark, sf_dir).withColumn("x", F.col("value") / 10.0).withColumn("goal", (F.col("event_id") % 7).cast("double"))
    out, _ = played(spark, windowed_loss(rows, build("sqrt", var(0) + 2.75), ["x"], "goal", ls.mse(), "ts", "12 hours", "1 day"), "windows")
    return out.select(F.unix_timestamp("start").alias("start"), "rows", F.round("loss", 6).alias("loss"), "ok")


def stream_state_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - R² of each event type's days, given out by timers when the day has closed."""
    rows = replayed(spark, sf_dir).withColumn("x", F.col("value") / 10.0).withColumn("goal", (F.col("event_id") % 7).cast("double"))
    out, _ = played(spark, windowed_state_loss(rows, var(0) * 0.25 + 1.5, ["x"], "goal", r2_loss(), "ts", ["event_type"], "1 day", "1 day"), "state_windows")
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "rows", F.round("loss", 6).alias("loss"), "ok")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    steps = (
        shuffled_rows, hof_bulk_update, training_sample, custom_operator, losses_by_name, unchecked_and_filled, csv_drop, bootstrap_rows, search_session, search_resumed, search_constants_linear,
        state_losses, score_states, skyline_price, skyline_quantity, asof_orders, stream_windows, stream_state_windows,
    )
    return {f.__name__: f for f in steps}
