"""Hard negatives by one-dimensional distance keys, exact.

Vectors become whole numbers, floor(``scale`` * x). Each gets one more component, the root of M**2 - |x|**2 with M the
largest length, so that the nearest vectors to an anchor are those of the largest inner product. Each vector belongs to its
nearest pivot, and the table is stored sorted by (pivot, distance to it), in chunks of ``CHUNK`` rows.

By the triangle inequality a vector within r of an anchor has a key within r of the anchor's own distance to the pivot, so
an anchor searches chunks of keys around that distance, in intervals that double. What a chunk can hold at most, and at
least (the annulus), follows from its least and largest key. An anchor's search of a shard ends when no chunk left can hold
a score that is wanted: not less than the last of the k best ones, and within the bounds that a positive sets. The k best of
all shards are the result; no candidate is left out but by a bound that rules it out, with a margin for rounding.

Anchors are a stated query set: they go in blocks to each shard (``vectors.against``). A first pass finds an anchor's
positives, a second one the negatives of each. Shards are ranges of the sorted table, of ``SHARD`` rows or so, so one pivot
or one vector with very many rows is split by id.

Defined results: rows with a null id or label, or with a vector that is null, empty, holds null or non-finite components,
or has another length than most, take no part; repeated rows are one; a row is never its own id's partner. Scores are
whole numbers; equal ones go by the smaller id. Numbers whose inner products reach 2**53 are an error. An anchor without
positives, and a positive without negatives, give no rows; a negative positive score leaves none. An empty table gives an
empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import written
from ferrule.llm.vectors import against, dimension, in_blocks, matrix, packed, partition, regrouped, usable

#: Rows of a chunk, and about as many rows of a shard; anchors of a block.
CHUNK, SHARD, BLOCK = 512, 8192, 256
#: Rows that pivots are chosen from, and their number.
SAMPLE, PIVOTS = 2048, 32


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of a bounded sample: farthest-first starts, and four rounds of k-means."""
    centres = sample[:1]
    for _ in range(min(n, len(sample)) - 1):
        far = ((sample[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        if far.max() == 0:
            break
        centres = np.vstack([centres, sample[far.argmax()]])
    for _ in range(4):
        own = ((sample[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([sample[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
    return centres


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """With the component that gives all vectors the length whose square is ``most``."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T), 0.0))


class Keyed:
    """A shard: chunks of rows sorted by (pivot, distance)."""

    def __init__(self, chunks: list[list[np.ndarray]], pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most
        self.chunks = [(ids, labels, x) for ids, labels, x, _, _ in chunks]
        self.pivot = np.array([int(c[3][0]) for c in chunks])
        self.near, self.far = (np.array([c[4][k] for c in chunks]) for k in (0, 1))
        self.scanned = 0

    def best(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor's each window [low, high] of scores (anchors, windows) the k best rows of the same label, or of
        other ones: anchor, window, id and score."""
        n, windows = low.shape
        own = distances(np.hstack([x, np.zeros((n, 1))]), self.pivots)[:, self.pivot]  # (anchors, chunks)
        whole = self.most + (x * x).sum(axis=1)[:, None]
        margin = 1e-9 * whole + 1e-6
        gap = np.maximum(np.maximum(own - self.far, self.near - own), 0.0)
        upper = (whole - gap**2) / 2 + margin
        lower = (whole - (own + self.far) ** 2) / 2 - margin
        order = np.argsort(gap, axis=1, kind="stable")
        last = np.full((n, windows), -np.inf)  # the k-th best score so far
        pool = np.zeros((0, 4))
        at, width = 0, 1
        while at < len(self.chunks):
            due = np.zeros(gap.shape, bool)
            np.put_along_axis(due, order[:, at : at + width], True, axis=1)
            for c in np.flatnonzero(due.any(axis=0)).tolist():
                wanted = (np.minimum(high, upper[:, c, None]) >= np.maximum(low, last)) & (lower[:, c, None] <= high)
                rows = np.flatnonzero(due[:, c] & wanted.any(axis=1))
                if not len(rows):
                    continue
                self.scanned += len(rows)
                other, kinds, y = self.chunks[c]
                scores = x[rows] @ y.T
                fit = (labels[rows][:, None] == kinds[None, :]) == same
                fit &= ids[rows][:, None] != other[None, :]
                found = [pool]
                for w in range(windows):
                    i, j = np.nonzero(fit & (scores >= np.maximum(low, last)[rows, w, None]) & (scores <= high[rows, w, None]))
                    found.append(np.stack([rows[i] * windows + w, -scores[i, j], j + 0.0, np.full(len(i), c + 0.0)], axis=1))
                pool = self.trimmed(np.concatenate(found), k, last)
            at, width = at + width, width * 2
        ids_of = np.array([self.chunks[int(c)][0][int(j)] for _, _, j, c in pool], np.int64)
        return pool[:, 0].astype(np.int64) // windows, pool[:, 0].astype(np.int64) % windows, ids_of, (-pool[:, 1]).astype(np.int64)

    def trimmed(self, pool: np.ndarray, k: int, last: np.ndarray) -> np.ndarray:
        """The k best rows of each query, and the k-th score where there are as many."""
        ids = np.zeros(len(pool), np.int64)
        for c in np.unique(pool[:, 3]).astype(int).tolist():
            there = pool[:, 3] == c
            ids[there] = self.chunks[c][0][pool[there, 2].astype(np.int64)]
        pool = pool[np.lexsort((ids, pool[:, 1], pool[:, 0]))]
        starts = np.flatnonzero(np.append(True, pool[1:, 0] != pool[:-1, 0])) if len(pool) else np.zeros(0, np.int64)
        place = np.arange(len(pool)) - np.repeat(starts, np.diff(np.append(starts, len(pool))))
        kth = place == k - 1
        last.reshape(-1)[pool[kth, 0].astype(np.int64)] = -pool[kth, 1]
        return pool[place < k]


def whole_rows(df: DataFrame, d: int, scale: float, vec_id: str, vector: str, label: str) -> DataFrame:
    """id, label, the vector in whole numbers as bytes of doubles, and its squared length; repeated rows once."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(matrix(batch.column(2), d) * scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array((x * x).sum(axis=1))], ["id", "label", "x", "squares"])

    known = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & usable(vector, d)
    rows = df.where(known).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(floors, "id long, label long, x binary, squares double").distinct()


def stacked(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def keyed_chunks(rows: DataFrame, pivots: np.ndarray, most: float, d: int, n: int) -> DataFrame:
    """The rows sorted by (pivot, distance, id) and packed: shard, ordinal and payload (ids, labels, vectors, pivot, the
    least and largest distance) of each chunk."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(augmented(stacked(batch.column(2), d), most), pivots)
            pivot = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pivot, pa.int32()), pa.array(far[np.arange(len(pivot)), pivot])], ["id", "label", "x", "pivot", "distance"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for table in regrouped(batches, CHUNK):
            pivot = table.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part, far = table.slice(a, z - a), table.column(4).to_numpy()[a:z]
                payload = packed(part.column(0).to_numpy(), part.column(1).to_numpy(), stacked(part.column(2), d), pivot[a : a + 1], np.array([far[0], far[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([partition()], pa.int64()), pa.array([(partition() << 32) + at], pa.int64()), pa.array([payload], pa.binary())], ["shard", "ordinal", "payload"])
                at += 1

    keyed = rows.select("id", "label", "x").mapInArrow(keys, "id long, label long, x binary, pivot int, distance double")
    order = ["pivot", "distance", "id", "label"]
    return keyed.repartitionByRange(max(1, math.ceil(n / SHARD)), *order).sortWithinPartitions(*order).mapInArrow(chunks, "shard long, ordinal long, payload binary")


def searched(queries: DataFrame, chunks: DataFrame, pivots: np.ndarray, most: float, same: bool, k: int) -> DataFrame:
    """anchor, window, id and score of the k best rows of each query in each shard."""

    def search(held: list[list[np.ndarray]]) -> Callable:
        shard = Keyed(held, pivots, most)

        def answer(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ids, labels, x, low, high = arrays
            at, window, other, score = shard.best(ids, labels, x, same, low, high, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(window), pa.array(other), pa.array(score)], ["anchor", "window", "id", "score"])

        return answer

    return against(queries, chunks, search, "anchor long, window long, id long, score long")


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of what the shards found, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchor`` says of an id whether its rows are anchors. A negative's score is from ``low`` to ``high`` percent of the
    positive's; labels are whole numbers."""
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    d = dimension(df, vector)
    rows = written(whole_rows(df, d, scale, vec_id, vector, label), "whole")
    n, most = rows.agg(F.count("*"), F.max("squares")).first()
    if not n:
        return df.sparkSession.createDataFrame([], result)
    if most >= 1 << 53:
        raise ValueError("inner products are not exact in doubles")
    # a bounded sample, drawn by hash
    sample = rows.orderBy(F.xxhash64("id", F.lit(11)), "x").limit(SAMPLE).select("x").collect()
    pivots = pivots_of(augmented(np.stack([np.frombuffer(r.x, np.float64) for r in sample]), most), PIVOTS)
    chunks = written(keyed_chunks(rows, pivots, most, d, n), "keyed")
    # neighbouring ranges are one shard where there are more of them than shards
    ranges, shards = chunks.agg(F.max("shard")).first()[0] + 1, max(1, math.ceil(n / SHARD))
    chunks = chunks.withColumn("shard", F.floor(F.col("shard") * F.lit(min(shards, ranges)) / F.lit(ranges)).cast("long"))
    anchors = rows.where(anchor(F.col("id"))).select("id", "label", "x")

    def all_scores(table: pa.Table) -> list[np.ndarray]:
        open_ended = np.full((table.num_rows, 1), np.inf)
        return [table.column(0).to_numpy(), table.column(1).to_numpy(), stacked(table.column(2), d), -open_ended, open_ended]

    def windows(table: pa.Table) -> list[np.ndarray]:
        """Of each positive the scores that its negatives may have; windows that an anchor lacks hold none."""
        scores = np.full((table.num_rows, positives), -1)
        for i, own in enumerate(table.column(3).to_pylist()):
            scores[i, : len(own)] = own
        ends = -(-scores * low // 100) + 0.0, scores * high // 100 + 0.0
        return [table.column(0).to_numpy(), table.column(1).to_numpy(), stacked(table.column(2), d), np.where(scores < 0, np.inf, ends[0]), np.where(scores < 0, -np.inf, ends[1])]

    first = written(in_blocks(anchors, "id", BLOCK, all_scores), "anchors")
    best = written(ranked(searched(first, chunks, pivots, most, True, positives), ["anchor"], positives).select("anchor", "id", "score", "rank"), "positives")
    # at most ``positives`` of each anchor, in the order of their rank
    listed = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    second = written(in_blocks(anchors.join(listed, F.col("id") == F.col("anchor")).select("id", "label", "x", "scores"), "id", BLOCK, windows), "windows")
    found = ranked(searched(second, chunks, pivots, most, False, negatives), ["anchor", "window"], negatives)
    own = best.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(own, ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
