"""What the operators on embeddings share: usable rows, packed blocks, and a set of queries in blocks against shards."""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of queries that a task puts to its shard, one after another.
BLOCKS_A_TASK = 16


def dimension(df: DataFrame, vector: str) -> int:
    """The number of components that most vectors have, the larger of equally common ones; 0 where there are none."""
    row = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return 0 if row is None else row.d


def usable(vector: str | Column, d: int) -> Column:
    """Whether a vector has ``d`` components, none of them null, NaN or infinite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce((F.size(v) == d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column, of ``d`` numbers each, as doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def unpacked(payload: pa.Scalar) -> list[np.ndarray]:
    with np.load(pa.BufferReader(payload.as_buffer())) as held:
        return [held[k] for k in held.files]


def partition() -> int:
    """The number of the partition that the running task works on; the same when the task runs again."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def in_blocks(rows: DataFrame, key: str, size: int, pack: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """``rows`` dealt out by a hash of ``key`` and packed: (block, payload), of at most ``size`` rows each."""
    n = max(1, math.ceil(rows.count() / size))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for table in regrouped(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([(partition() << 32) + k], pa.int64()), pa.array([packed(*pack(table))], pa.binary())], ["block", "payload"])
            k += 1

    return rows.repartition(n, key).mapInArrow(blocks, "block long, payload binary")


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of ``size`` rows; the last one may have fewer."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.Table]]:
    """The runs of rows that have one number in ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and z > a and held[0].column(column)[0].as_py() != values[a]:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(batch.slice(a, z - a))
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)


def against(blocks: DataFrame, shards: DataFrame, search: Callable[[Iterator[list[np.ndarray]]], Callable], schema: str) -> DataFrame:
    """Each block of queries against each shard: ``search(arrays of the shard's payloads)`` gives what answers one block.

    ``blocks`` is (block, payload), ``shards`` (shard, ordinal, payload), both written tables. A task holds a shard and
    reads its blocks one by one; a shard is sent to as many tasks as ``BLOCKS_A_TASK`` blocks each make, and a block, much
    smaller than a shard, to each shard. So every pair is met once, and no task's memory grows with the tables."""
    spark = blocks.sparkSession
    n_blocks = blocks.count()
    n_shards = shards.select("shard").distinct().count()
    parts = max(1, math.ceil(n_blocks / BLOCKS_A_TASK))
    own = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = shards.select("shard", own.alias("part"), F.lit(0).alias("kind"), F.col("ordinal").alias("at"), "payload")
    # one row a shard; joined with blocks' numbers only, payloads follow by the part that they belong to
    which = shards.select("shard").distinct().withColumn("part", own)
    right = which.join(blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")), "part").select("shard", "part", F.lit(1).alias("kind"), F.col("block").alias("at"), "payload")
    # pairs are dealt to tasks one by one, so that none has two while another has none
    tasks = min(n_shards * parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1000))
    both = left.unionByName(right).withColumn("task", F.pmod(F.col("shard") * parts + F.col("part"), F.lit(max(1, tasks))).cast("int"))
    dealt = both.repartitionById(max(1, tasks), "task").drop("task").sortWithinPartitions("shard", "part", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, answer = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                now, payload = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), unpacked(batch.column(4)[i])
                if now != key:
                    key, held, answer = now, [], None
                if batch.column(2)[i].as_py() == 0:
                    held.append(payload)
                elif held or answer:
                    if answer is None:
                        answer, held = search(held), []
                    yield from answer(payload)

    return dealt.mapInArrow(run, schema)
