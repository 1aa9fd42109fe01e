"""A fixed formula over a stream: scores as a projection, and losses of event-time windows with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferrule.functions.losses import Loss
from ferrule.functions.state_losses import StateLoss
from ferrule.plans.compile import evaluate
from ferrule.plans.expr import Expr


def scored(stream: DataFrame, expr: Expr, features: list[str], out: str = "yhat") -> DataFrame:
    """The stream with the formula's value and flag; it has no state and works for batches too."""
    return evaluate(stream, expr, features, out)


def windowed_loss(stream: DataFrame, expr: Expr, features: list[str], y: str, loss: Loss, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, rows, loss and ok of each window; rows later than ``late`` behind the latest are left out, and a window's
    state goes when it closes. As over batches, a window with a row that fails has no loss, and its ok is false."""
    df = evaluate(stream.withWatermark(time, late), expr, features)
    total, weight = loss.parts(F.col("yhat"), F.col(y))
    sums = df.groupBy(F.window(time, window)).agg(F.count("*").alias("rows"), total.alias("total"), weight.alias("weight"), F.every("ok").alias("ok"))
    return sums.select(F.col("window.start").alias("start"), "rows", F.when(F.col("ok"), loss.finish(F.col("total"), F.col("weight"))).alias("loss"), "ok")


def windowed_state_loss(stream: DataFrame, expr: Expr, features: list[str], y: str, loss: StateLoss, time: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``by``, start, rows, loss and ok of each key's windows, for losses that are more than means, over a stream.

    The state of a key's window is the loss's own state, a few numbers. It takes in the rows of each micro-batch; a timer at
    the window's end, in event time, gives out the window's loss, once, and removes the state. A row whose window ended at or
    before the watermark is late and is left out, so no window is given out twice."""
    df = evaluate(stream.withWatermark(time, late), expr, features)
    rows = df.select(*by, F.window(time, window).alias("__window"), F.col("yhat").alias("__p"), F.col(y).cast("double").alias("__y"), F.col("ok").alias("__ok"), F.col(time))
    keys = [*by, "__start", "__end"]
    # milliseconds, as timers count
    rows = rows.withColumns({"__start": F.unix_millis("__window.start"), "__end": F.unix_millis("__window.end")}).drop("__window")
    kept = "n long, good boolean, state array<double>"
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("start", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("ok", T.BooleanType())])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end = int(key[-1])
        if end <= state.getCurrentWatermarkMs():
            # the timer, or late rows that come in the micro-batch of the timer and would put it off
            if not state.exists:
                return
            n, good, numbers = state.get
            state.remove()
            with np.errstate(all="ignore"):
                value = float(loss.finish(np.array(numbers, float))) if good else None
            yield pd.DataFrame([(*key[:-2], int(key[-2]), int(n), value, bool(good))], columns=schema.names)
            return
        n, good, numbers = state.get if state.exists else (0, True, list(loss.init))
        numbers = np.array(numbers, float)
        for frame in frames:
            with np.errstate(all="ignore"):
                numbers = loss.update(numbers, frame["__p"].to_numpy(float), frame["__y"].to_numpy(float), None)
            n, good = n + len(frame), good and bool(frame["__ok"].all())
        state.update((int(n), bool(good), [float(v) for v in numbers]))
        state.setTimeoutTimestamp(end)

    out = rows.groupBy(*keys).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("start", F.timestamp_millis("start"))
