"""Datasets: column roles over a DataFrame, CSV ingest, splits, samples and previews."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.plans.compile import finite
from ferrule.plans.store import stored

#: Fixed value: so many equal pairs are written out at once.
RUN = 4096


class DatasetError(ValueError):
    pass


@dataclass(frozen=True)
class Dataset:
    """A DataFrame with the roles of its columns. All of them are doubles without null; a null is an error as soon as its
    row is read, so that no operator skips a row that another one counts."""

    df: DataFrame
    x: tuple[str, ...]
    y: str
    w: str | None = None
    #: equal rows have been looked for, and are one where that saves much (``packed``)
    is_packed: bool = False

    def project(self) -> DataFrame:
        """Only the columns with a role, so that a scan reads no other."""
        there = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null in a row of a dataset"))).otherwise(F.col(c).cast("double")).alias(c)
        return self.df.select(*map(there, (*self.x, self.y, *([self.w] if self.w else []))))

    def mean_y(self) -> DataFrame:
        from ferrule.functions.losses import mean_y

        return self.project().agg(mean_y(F.col(self.y), F.col(self.w) if self.w else None).alias("avg_y"))


def with_roles(df: DataFrame, y: str | None = None, x: Sequence[str] | None = None, w: str | None = None) -> Dataset:
    """Roles by name: y is the last column unless it is named; x all others but the weights, in order, each once."""
    if len(df.columns) < 2:
        raise DatasetError("a dataset needs two columns or more")
    if len(set(df.columns)) < len(df.columns):
        raise DatasetError("column names must differ")
    y = y if y is not None else df.columns[-1]
    for c in (y, *([w] if w else []), *(x or ())):
        if c not in df.columns:
            raise DatasetError(f"there is no column {c!r}")
    if w == y:
        raise DatasetError("the weights can't be y")
    if x is not None and y in x:
        raise DatasetError("x can't contain y")
    if x is not None and w is not None and w in x:
        raise DatasetError("x can't contain the weights")
    chosen = [c for c in df.columns if (c in x if x is not None else c not in (y, w))]
    if not chosen:
        raise DatasetError("no column is left for x")
    if df.isEmpty():
        raise DatasetError("a dataset needs a row")
    return Dataset(df, tuple(chosen), y, w)


def csv_columns(spark: SparkSession, path: str, header: bool = True) -> list[str]:
    """The names in a CSV file's header; ``col_0``, ``col_1``, ... where there is none, or where the first row of data has
    another width."""
    rows = list(csv.reader(r.value for r in spark.read.text(path).where("trim(value) <> ''").take(2)))
    if len(rows) <= header:
        raise DatasetError("a CSV file needs a row of data")
    names = [c.strip() for c in rows[0]] if header else []
    return names if len(names) == len(rows[-1]) else [f"col_{i}" for i in range(len(rows[-1]))]


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, header: bool = True, on_bad_rows: str = "error") -> DataFrame:
    """A CSV file of doubles; cells are trimmed. A cell that is no number is an error, or with ``drop`` its row goes, as
    do rows with NaN or infinity. The columns are those of the file unless they are named."""
    if on_bad_rows not in ("error", "drop"):
        raise ValueError("on_bad_rows is error or drop")
    columns = csv_columns(spark, path, header) if columns is None else columns
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    mode = "FAILFAST" if on_bad_rows == "error" else "DROPMALFORMED"
    df = spark.read.csv(path, schema=schema, header=header, mode=mode, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    if on_bad_rows == "drop":
        return df.where(all_finite(columns))
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"failed to parse a cell of {c}"))).otherwise(F.col(c)).alias(c) for c in columns]
    return df.select(*checked)


def all_finite(columns: Sequence[str]) -> Column:
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(finite(F.col(c)), F.lit(False))
    return good


def preview(df: DataFrame, n: int = 12) -> DataFrame:
    return df.select(*df.columns[:n]).limit(n)


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).alias("x"), F.col(y).alias("y")).where(all_finite(["x", "y"]))


def curve(df: DataFrame, x: str, y: str) -> DataFrame:
    """Finite pairs in the order of x, for plotting."""
    return finite_pairs(df, x, y).orderBy("x", "y")


def weight_before(df: DataFrame, order: Sequence[str], weight: str) -> DataFrame:
    """``df`` with ``before``: the weight of all rows that come first in an order without ties.

    Ranges of the order are tasks: each adds up its own rows, and the driver adds up the ranges.
    """
    ranges = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    first, total = [], 0
    for r in ranges.groupBy("__p").agg(F.sum(weight).alias("n")).orderBy("__p").collect():  # a row a partition
        first.append((r["__p"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(first, "__p int, __first long")
    inside = F.sum(weight).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "__p").withColumn("before", F.col("__first") + F.col("__inside")).drop("__p", "__first", "__inside")


def curve_places(df: DataFrame, x: str, y: str) -> DataFrame:
    """All finite pairs, repeated ones too, with their ``place`` in the order of x and y, from 1.

    Equal pairs are sorted as one and then dealt out, so that a pair with many rows isn't one task's work.
    """
    pairs = weight_before(finite_pairs(df, x, y).groupBy("x", "y").agg(F.count("*").alias("n")), ["x", "y"], "n")
    runs = pairs.select("x", "y", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("__at"))
    dealt = runs.repartition(F.col("before") + F.col("__at"))
    last = F.least(F.col("__at") + RUN, "n")
    return dealt.select(F.explode(F.sequence(F.col("before") + F.col("__at") + 1, F.col("before") + last)).alias("place"), "x", "y")


#: Numbers that a key is scattered to.
KEYS = 2_147_483_647


def hashed(key: Column, seed: int) -> Column:
    """A number from 0 to 2**31 - 2 by hash, for keys of any type; null for a null key."""
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(KEYS)))


def arithmetic(key: Column, seed: int) -> Column:
    """The same for whole numbers by plain arithmetic, which other engines can state; its seeds only shift one order."""
    return F.pmod((F.pmod(key.cast("long"), F.lit(KEYS)) + F.lit(seed + 1)) * F.lit(1_327_217_885), F.lit(KEYS))


def split(df: DataFrame, fraction: float, key: str, seed: int = 0, scatter: Callable[[Column, int], Column] = hashed) -> DataFrame:
    """``df`` with ``is_val``: a row is for validation by its key's number, so no order of rows is needed, equal keys go to
    one side, and the split doesn't move when rows are added. The share is the clamped fraction in expectation. Rows with
    a null key are for training."""
    limit = round(min(max(fraction, 0.0), 0.9) * KEYS)
    return df.withColumn("is_val", F.coalesce(scatter(F.col(key), seed) < limit, F.lit(False)))


def exact_split(df: DataFrame, fraction: float, key: str, seed: int = 0, scatter: Callable[[Column, int], Column] = hashed) -> DataFrame:
    """As ``split``, with exactly round(fraction * n) of the n rows whose key isn't null, when keys are unique (rows of one
    key stay together). Rows with a null key are for training.

    The cut is the key at that rank. It takes two scans to find: one counts rows in 65,536 ranges of numbers, the other
    keeps those of the range that holds the rank, whose numbers are counted; rows of one number are put in order, by key."""
    keyed = df.withColumn("__h", scatter(F.col(key), seed))
    known = keyed.where("__h IS NOT NULL")
    # 65,536 ranges at most
    ranges = [(r["part"], r["count"]) for r in known.groupBy(F.shiftright("__h", 15).alias("part")).count().orderBy("part").collect()]
    left = round(min(max(fraction, 0.0), 0.9) * sum(n for _, n in ranges))
    if left == 0:
        return df.withColumn("is_val", F.lit(False))
    for top, n in ranges:  # noqa: B007
        if left <= n:
            break
        left -= n
    # of the range that holds the rank, a 65,536th of all rows, number and key are kept, so that the data is read no more
    inside = stored(known.where(F.shiftright("__h", 15) == top).select("__h", F.col(key).alias("__cut")), "range")
    for r in inside.groupBy("__h").count().orderBy("__h").collect():  # 32,768 numbers at most
        number = r["__h"]
        if left <= r["count"]:
            break
        left -= r["count"]
    cut = inside.where(F.col("__h") == number).orderBy("__cut").select("__cut").offset(left - 1).limit(1)
    before = (F.col("__h") < number) | ((F.col("__h") == number) & (F.col(key) <= F.col("__cut")))
    return keyed.join(F.broadcast(cut)).withColumn("is_val", F.coalesce(before, F.lit(False))).drop("__h", "__cut")


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """The rows in an order that the seed draws, a number for each row; a sort of all rows by ranges."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").drop("__r")


def gather(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose keys are listed, in any number; Spark picks the join by the list's size."""
    return df.join(rows.select(key), key)


def bootstrap(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows with replacement, each row as likely as any other; none of an empty table.

    One draw shares ``n`` among the partitions by their rows (a multinomial), and each task draws its part from its own rows
    by (seed, partition), so tasks may run in any order and again. ``df`` should be a scan or a written table, whose
    partitions hold the same rows each time they are read."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    # a number a partition
    sizes = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    shares = np.random.default_rng(seed).multinomial(n, np.array([sizes[p] for p in order]) / max(1, sum(sizes.values()))) if order else []
    parts = {p: (sizes[p], int(k)) for p, k in zip(order, shares, strict=True)}

    def draw(batches: Iterator) -> Iterator:
        p = TaskContext.get().partitionId()
        rows, k = parts.get(p, (0, 0))
        places, at = np.sort(np.random.default_rng([seed, p]).integers(rows, size=k)) if k else np.zeros(0, np.int64), 0
        for batch in batches:
            own = places[np.searchsorted(places, at) : np.searchsorted(places, at + batch.num_rows)] - at
            at += batch.num_rows
            if len(own):
                yield batch.take(pa.array(own))

    return df.mapInArrow(draw, df.schema)


def default_data(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """y = 2 cos(x0) + x1 ** 2 - 2 at normal x0 and x1."""
    rows = spark.range(n).select(F.randn(seed).alias("x0"), F.randn(seed + 1).alias("x1"))
    return rows.withColumn("y", 2.0 * F.cos("x0") + F.col("x1") * F.col("x1") - 2.0)


#: How many rows there must be for each different one, for equal rows to become one.
REPEATED = 8


#: Signs of zeros that one whole number holds when rows are grouped.
SIGNS = 62
#: Of more rows than these, different ones are counted in a share of all hashes.
HASHES = 2**20


def packed(data: Dataset, total: int | None = None) -> Dataset:
    """The dataset for scans that add up over rows what they give times their weight: where rows repeat (``REPEATED`` times
    and more), each different row once, with the sum of its weights, as a stored table; else as it is.

    All rows count, and the sums are the same but for rounding. Whether it pays is seen from an estimate, in one scan; a
    second one groups, and all later ones read the different rows alone. Zeros of either sign are different values.

    ``total`` is the number of all rows, where it is known. Then the estimate hashes each row, and counts the different ones
    of a share of all hashes, of which there are less than twice ``HASHES``; unlike a sketch, that is generated code."""
    if data.is_packed:
        return data
    df = data.project()
    code = F.xxhash64(*df.columns)
    if total is None:
        seen = df.agg(F.count("*").alias("n"), F.approx_count_distinct(code).alias("different")).first()
        total, different = seen.n, seen.different
    else:
        one_in = max(1, total // HASHES)
        different = one_in * df.select(code.alias("__code")).where(F.pmod("__code", F.lit(one_in)) == 0).distinct().count()
    if total < REPEATED * different:
        return replace(data, is_packed=True)
    # grouping makes one zero of both, so the signs of zeros are keys of their own, a bit a column
    place = {c: (f"__signs{k // SIGNS}", 1 << (SIGNS - 1 - k % SIGNS)) for k, c in enumerate(df.columns)}
    signs: dict[str, Column] = {}
    for c, (name, bit) in place.items():
        own = F.when((F.col(c) == 0.0) & (F.col(c).cast("string") == "-0.0"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long"))
        signs[name] = signs[name].bitwiseOR(own) if name in signs else own
    rows = df.withColumns(signs).groupBy(*df.columns, *signs).agg(F.count("*").cast("double").alias("__n"))
    back = [F.when(F.col(name).bitwiseAND(F.lit(bit).cast("long")) != 0, F.lit(-0.0)).otherwise(F.col(c)).alias(c) for c, (name, bit) in place.items()]
    weight = F.col("__n") * F.col(data.w) if data.w else F.col("__n")
    names = [*data.x, data.y]
    out = stored(rows.sort(*df.columns, *signs).select(*back[: len(names)], weight.alias("__weight")), "packed")
    return Dataset(out, data.x, data.y, "__weight", True)


def bounded_sample(data: Dataset, rows: int, seed: int, total: int | None = None) -> tuple:
    """Up to ``rows`` rows as NumPy arrays x (features by rows), y and w: the training sample of a search. ``total`` is the
    number of all rows, where it is known."""
    import numpy as np

    df = data.project()
    total = df.count() if total is None else total
    # a number drawn for each row (not a hash of its values, by which equal rows would come in or stay out together); the
    # rows of least numbers are taken from a draw that all but surely holds enough, so that no partition comes first
    share = min(1.0, (rows + 6 * rows**0.5 + 20) / max(total, 1))
    picked = df if total <= rows else df.withColumn("__r", F.rand(seed)).where(F.col("__r") < share).orderBy("__r").limit(rows).drop("__r")
    # in an order of its own, so that a search doesn't depend on the order of files
    frame = picked.toPandas().sort_values([*data.x, data.y, *([data.w] if data.w else [])], kind="stable")
    return frame[list(data.x)].to_numpy(np.float64).T.copy(), frame[data.y].to_numpy(np.float64), frame[data.w].to_numpy(np.float64) if data.w else None
