"""The relational steps of a search: best per complexity, Pareto front, top lists, histograms, lookups.

Groups go by complexity or population, both bounded by options. What keeps one row of a group is an aggregate with partial
aggregation; top lists and the oldest members are ranks, of which Spark keeps the first ones before it shuffles. Ties are
always broken by arrival. ``pareto_front`` takes a row a complexity; ``skyline`` and ``nearest_lower_each`` take tables of
any size, in ranges of their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.plans.store import stored


def _least(order: list[str], kept: list[str]) -> Column:
    """The row least in ``order``, as an aggregate; min over structs, as min_by may return any of equal rows."""
    return F.min(F.struct(*order, *(c for c in kept if c not in order)))


def best_by_complexity(members: DataFrame, maxsize: int, cost: str = "cost", arrival: str = "arrival", complexity: str = "complexity") -> DataFrame:
    """The hall of fame: of each complexity from 1 to ``maxsize`` the member of least cost, the first of equal ones.

    A NaN cost replaces nothing, but fills a slot that had come first to it and that no number takes.
    """
    rows = members.where(F.col(complexity).between(1, maxsize))
    best = rows.groupBy(complexity).agg(_least([cost, arrival], [c for c in members.columns if c != complexity]).alias("b"))
    return best.select(*(F.col(complexity) if c == complexity else F.col(f"b.{c}").alias(c) for c in members.columns))


def pareto_front(best: DataFrame, complexity: str = "complexity", loss: str = "loss") -> DataFrame:
    """Members whose loss is less than that of all simpler ones; one row a complexity comes in, so the window is small."""
    before = F.min(loss).over(Window.orderBy(complexity).rowsBetween(Window.unboundedPreceding, -1))
    kept = best.withColumn("__before", before).where(~F.isnan(loss) & (F.col(loss) < float("inf")) & (F.col("__before").isNull() | (F.col(loss) < F.col("__before"))))
    return kept.drop("__before")


def skyline(df: DataFrame, x: str, y: str, order: list[str] | None = None) -> DataFrame:
    """The Pareto front of a table of any size: the rows whose ``y`` is less than that of all rows with a lesser ``x``, one
    for each ``x`` (the least in ``y`` and ``order``). Rows with a null or NaN ``x`` or ``y``, or an infinite ``y``, are not in it.

    Rows are pre-aggregated by ``x`` and sorted in ranges. Each range's least ``y`` goes to the driver, a number a partition;
    a row is then compared with the least before its range, and with those before it inside."""
    known = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & (F.col(y) < float("inf"))
    kept = [c for c in df.columns if c != x]
    best = df.where(known).groupBy(x).agg(_least([y, *(order or [])], kept).alias("__b")).select(*(F.col(x) if c == x else F.col(f"__b.{c}").alias(c) for c in df.columns))
    ranges = stored(best.repartitionByRange(x).withColumn("__p", F.spark_partition_id()), "ranges")
    least, before = None, []
    for r in ranges.groupBy("__p").agg(F.min(y).alias("y")).orderBy("__p").collect():  # a row a partition
        before.append((r["__p"], least))
        least = r.y if least is None else min(least, r.y)
    kind = df.schema[y].dataType.simpleString()
    table = df.sparkSession.createDataFrame(before, f"__p int, __before {kind}")
    inside = F.min(y).over(Window.partitionBy("__p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    limit = F.least("__inside", "__before")  # of the two, nulls are left out
    rows = ranges.withColumn("__inside", inside).join(F.broadcast(table), "__p")
    return rows.where(limit.isNull() | (F.col(y) < limit)).select(*df.columns)


def nearest_lower_each(requests: DataFrame, front: DataFrame, by: list[str], wanted: str, complexity: str = "complexity", arrival: str = "arrival", prefix: str = "found_") -> DataFrame:
    """``requests`` with the columns of the member that each asks for, of the members with its ``by``: that of the largest
    complexity up to ``wanted`` (the last of equal ones), else the simplest; nulls where there are no members. Requests
    with a null ``by`` or ``wanted`` find none.

    An as-of join: both tables are sorted as one, members before requests, in ranges; each request takes the last member
    before it, or else the first one after it. What a range takes from other ranges is one member from either side, which
    the driver carries over, so neither a range join nor a group in one task is needed."""
    names = [c for c in front.columns if c not in by]
    known = front.dropna(subset=[*by, complexity])
    # of members that are equal in complexity the last one, so however many they are, a key has one
    last = known.groupBy(*by, F.col(complexity).cast("double").alias("__at")).agg(F.max(F.struct(F.col(arrival).alias("__a"), *names)).alias("__m"))
    left = last.select(*by, "__at", F.lit(0).alias("__kind"), F.lit(0.0).alias("__tie"), "__m", F.lit(None).cast(requests.select(F.struct(*requests.columns)).schema[0].dataType).alias("__r"))
    right = requests.select(*by, F.col(wanted).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.rand(0).alias("__tie"), F.lit(None).cast(left.schema["__m"].dataType).alias("__m"), F.struct(*requests.columns).alias("__r"))
    order = [*by, "__at", "__kind", "__tie"]
    ranges = stored(left.unionByName(right).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    group = F.struct(*by)
    is_member = F.col("__kind") == 0
    # of each range its first and last member, a row a partition
    ends = ranges.where(is_member).groupBy("__p").agg(F.min(F.struct(*order, "__m")).alias("first"), F.max(F.struct(*order, "__m")).alias("last")).orderBy("__p")
    ends = {r["__p"]: r for r in ends.collect()}
    last_p = max([*ends, *(r["__p"] for r in ranges.select("__p").distinct().collect())], default=-1)
    carried, before = [], None
    for p in range(last_p + 1):
        carried.append([p, before, None])
        before = ends[p]["last"] if p in ends else before
    after = None
    for p in range(last_p, -1, -1):
        carried[p][2] = after
        after = ends[p]["first"] if p in ends else after
    side = ranges.select(F.struct(*order, "__m").alias("s")).schema["s"].dataType.simpleString()
    table = requests.sparkSession.createDataFrame([tuple(c) for c in carried], f"__p int, __before {side}, __after {side}")
    own = F.when(is_member, F.struct(*order, "__m"))
    # both ways up to the row itself: a frame that reaches to the end of its range is made anew for each row
    so_far = lambda *keys: F.last(own, ignorenulls=True).over(Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    rows = ranges.withColumn("__lower", so_far(*order)).withColumn("__upper", so_far(*(F.col(c).desc() for c in order)))
    rows = rows.where(~is_member).join(F.broadcast(table), "__p")
    same = lambda c: F.when(F.struct(*(F.col(f"{c}.{b}").alias(b) for b in by)) == group, F.col(f"{c}.__m"))
    # a range's own member is nearer than one that was carried over
    found = F.coalesce(F.coalesce(same("__lower"), same("__before")), F.coalesce(same("__upper"), same("__after")))
    found = F.when(F.col("__at").isNotNull(), found)
    return rows.withColumn("__f", found).select("__r.*", *(F.col(f"__f.{c}").alias(f"{prefix}{c}") for c in names))


def front_tail(front: DataFrame, k: int, complexity: str = "complexity") -> DataFrame:
    return front.orderBy(F.col(complexity).desc()).limit(k)


def top_members(members: DataFrame, n: int, by: str = "pop", cost: str = "cost", arrival: str = "arrival") -> DataFrame:
    """The ``n`` members of least cost of each population."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(cost, arrival))
    return members.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def global_best(members: DataFrame, loss: str = "loss", arrival: str = "arrival") -> DataFrame:
    return members.where(~F.isnan(loss)).orderBy(loss, arrival).limit(1)


def oldest(members: DataFrame, n: int = 1, by: str = "pop", birth: str = "birth", index: str = "arrival") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(birth, index))
    return members.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def replace_oldest(members: DataFrame, children: DataFrame, by: str = "pop", birth: str = "birth", index: str = "arrival") -> DataFrame:
    """Each population's oldest members give way to its children, as many as there are."""
    counts = children.groupBy(by).agg(F.count("*").alias("__n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(birth, index))
    stay = members.withColumn("__rank", rank).join(counts, by, "left").where(F.col("__rank") > F.coalesce("__n", F.lit(0)))
    return stay.drop("__rank", "__n").unionByName(children)


def migrants_pool(tops: DataFrame, pops: DataFrame, by: str = "pop") -> DataFrame:
    """For each population the best members of all others: the pool it draws migrants from."""
    return pops.select(F.col(by).alias("target")).join(tops, F.col("target") != F.col(by))


def size_histogram(members: DataFrame, maxsize: int, complexity: str = "complexity") -> DataFrame:
    """(size, freq) for sizes from 1 to ``maxsize``; each starts at 1."""
    counts = members.groupBy(F.col(complexity).cast("int").alias("size")).agg(F.count("*").alias("n"))
    sizes = members.sparkSession.range(1, maxsize + 1).select(F.col("id").cast("int").alias("size"))
    return sizes.join(F.broadcast(counts.where(F.col("size").between(1, maxsize))), "size", "left").select("size", (F.coalesce("n", F.lit(0)) + 1.0).alias("freq"))


def normalised(histogram: DataFrame, least: float = 1e-6) -> DataFrame:
    """The share of each size, ``least`` at least."""
    total = histogram.agg(F.sum("freq").alias("total"))
    return histogram.join(F.broadcast(total)).select("size", F.greatest(F.col("freq") / F.col("total"), F.lit(least)).alias("share"))


def tournament_score(members: DataFrame, shares: DataFrame, scaling: float, cost: str = "cost", complexity: str = "complexity") -> DataFrame:
    """Members with ``score``: the cost, grown with how common their size is."""
    share = F.coalesce("share", F.lit(1e-6))
    joined = members.join(F.broadcast(shares.select(F.col("size").alias("__size"), "share")), F.col(complexity) == F.col("__size"), "left")
    return joined.withColumn("score", F.col(cost) * F.exp(share * scaling)).drop("__size", "share")


def nearest_lower(front: DataFrame, wanted: int, complexity: str = "complexity", arrival: str = "arrival") -> DataFrame:
    """The member of the largest complexity up to ``wanted`` (the last of equal ones), else the simplest."""
    below = F.col(complexity) <= wanted
    order = [below.desc(), F.when(below, -F.col(complexity)).otherwise(F.col(complexity)), F.col(arrival).desc()]
    return front.orderBy(*order).limit(1)


def by_id(first: DataFrame, second: DataFrame, member: int, key: str = "id") -> DataFrame:
    """The member of that id: from the first table, or if it isn't there, from the second."""
    both = first.where(F.col(key) == member).withColumn("__t", F.lit(0)).unionByName(second.where(F.col(key) == member).withColumn("__t", F.lit(1)))
    return both.orderBy("__t").limit(1).drop("__t")
