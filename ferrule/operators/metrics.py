"""Metrics of a prediction and summaries of columns, in one pass over the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.scalar import SPARK
from ferrule.functions.state_losses import EE, MY, PP, W, YP, YY, StateLoss, merged_moments, moments
from ferrule.operators.scoring import states_by
from ferrule.plans.compile import finite

#: Places in the state of a weighted prediction: moments of all rows alike, those by weight, and what has no moments.
ALIKE, WEIGHED, AE, LEAST, MOST = 0, 7, 14, 15, 16


def _update(state: np.ndarray, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    if not len(y):
        return state
    e = np.abs(p - y)
    # a weight of 0 weighs nothing, whatever the error
    return _merge(state, np.concatenate([moments(p, y, None), moments(p, y, w), [float((e * w).sum()), np.fmin.reduce(e), np.fmax.reduce(e)]]))


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([merged_moments(a[:WEIGHED], b[:WEIGHED]), merged_moments(a[WEIGHED:AE], b[WEIGHED:AE]), [a[AE] + b[AE], min(a[LEAST], b[LEAST]), max(a[MOST], b[MOST])]])


#: What is kept of a prediction with weights; it merges, so metrics of any data are one pass.
WEIGHTED = StateLoss("metrics", (*[0.0] * 15, float("inf"), float("-inf")), _update, _merge, lambda s: float(s[WEIGHED + EE]))


def metrics(df: DataFrame, yhat: str = "yhat", y: str = "y", w: str | None = None, by: list[str] | None = None) -> DataFrame:
    """n, mse, mae, rmse, r2, corr, min_abs_err and max_abs_err, of all rows or of each group.

    Weights enter mse, mae and r2. The correlation weighs no row, but centres y at its weighted mean. r2 is 0 where y
    doesn't vary, corr where either does not; no rows give NaN (and 0 for the least error). Rows whose key is null are a
    group of their own.
    """
    by = by or []
    a, b = F.col(yhat), F.col(y)
    e = a - b
    n, vy = F.count("*").cast("double"), F.var_pop(b)
    own = [F.count("*").alias("n"), F.min(F.abs(e)).alias("least"), F.max(F.abs(e)).alias("most")]
    if w is None:
        # moments about the mean merge, so that one pass will do
        whole = df.groupBy(*by).agg(*own, n.alias("w"), F.sum(e * e).alias("se"), F.sum(F.abs(e)).alias("ae"), (vy * n).alias("sst"), (F.covar_pop(a, b) * n).alias("cov"), (vy * n).alias("vy"), (F.var_pop(a) * n).alias("vp"))
    else:
        states = states_by(df, WEIGHTED, yhat, y, w, by)
        s = lambda k: F.get("state", F.lit(k))
        shift = s(MY) - s(WEIGHED + MY)  # y is centred at its weighted mean, also where rows weigh alike
        some = s(W) > 0
        whole = states.select(
            *by, s(W).cast("long").alias("n"), F.when(some, s(LEAST)).alias("least"), F.when(some, s(MOST)).alias("most"), s(WEIGHED + W).alias("w"), s(WEIGHED + EE).alias("se"), s(AE).alias("ae"),
            s(WEIGHED + YY).alias("sst"), s(YP).alias("cov"), (s(YY) + s(W) * shift * shift).alias("vy"), s(PP).alias("vp"),
        )
    nan = F.lit(float("nan"))
    mean = lambda c: F.when(F.col("n") == 0, nan).otherwise(SPARK.div(F.col(c), F.col("w")))
    r2 = F.when(F.col("n") == 0, nan).when(F.col("sst") == 0, F.lit(0.0)).otherwise(1.0 - SPARK.div(F.col("se"), F.col("sst")))
    corr = F.when(F.col("n") == 0, nan).when((F.col("vy") == 0) | (F.col("vp") == 0), F.lit(0.0)).otherwise(SPARK.div(F.col("cov"), F.sqrt(F.col("vy")) * F.sqrt(F.col("vp"))))
    return whole.select(*by, "n", mean("se").alias("mse"), mean("ae").alias("mae"), F.sqrt(mean("se")).alias("rmse"), r2.alias("r2"), corr.alias("corr"), F.coalesce("least", F.lit(0.0)).alias("min_abs_err"), F.coalesce("most", nan).alias("max_abs_err"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: name, and mean, population std, min and max of its finite cells; one pass over the rows."""

    def of(c: str) -> Column:
        x = F.when(finite(F.col(c)), F.col(c).cast("double"))
        mean = F.avg(x)
        return F.struct(F.lit(c).alias("name"), F.count(x).alias("n"), mean.alias("mean"), F.sqrt(F.avg(x * x) - mean * mean).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))

    return df.agg(F.array(*map(of, columns)).alias("all")).select(F.inline("all"))
