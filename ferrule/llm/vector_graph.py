"""Approximate nearest neighbours by inner product: a robust-pruned directed graph a shard.

Each shard of about ``shard_rows`` rows is indexed by one task, a graph for each band of lengths that differ by a factor of 2
at most. Vectors get one more component, so that all have the length of the band's longest and the nearest ones are those
of the largest inner product; bands keep that component small beside the others. A query searches the bands of the
longest vectors first, and ends where no length left can give a score that is wanted. Nodes are inserted in batches that
double and then stay: greedy searches of the graph so far propose each new node's neighbours, and of the proposals, nearest
first, those stay that no neighbour kept before is nearer to than 1/``slack`` of their own distance (relaxed pruning), at
most ``degree``. Reverse edges are added, and a node that has too many is pruned in the same way. So near copies do not use
up a node's edges, and some that lead far away stay; nodes of the first batch are the entries.

The index is a written table of shards. Queries go in blocks to each shard (``vectors.against``), a beam search of ``beam``
nodes answers them all at once, and the scores of what it found are computed anew, from the vectors as they came and in double
precision. The k best of all shards are the result. Every row is indexed; recall against brute force is measured in the
tests and stated in the README.

Equal vectors of a shard are one node that keeps its ids in order, so ties are right within a node however many rows it
has. Building and search take the same path for the same rows, so a task that runs again gives the same answer.

Defined results: rows with a null id, or with a vector that is null, empty, zero, holds null or non-finite components, or
has another length than most, take no part, as queries or as candidates. Repeated rows are one; of rows that share an id
the best score counts, and a query doesn't find its own id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import written
from ferrule.llm.vectors import against, dimension, in_blocks, matrix, packed, runs, usable

#: Rows of a shard, or so; queries of a block.
SHARD, BLOCK = 16_384, 256
#: Edges that a node keeps, nodes of the beam when building, and how much nearer a kept neighbour must be to rule out another.
DEGREE, BUILD_BEAM, SLACK = 40, 96, 1.2
#: Nodes of the beam that are followed at once, entries of a graph, and nodes inserted at once.
STEP, ENTRIES, BATCH = 4, 32, 256


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes of a beam search, nearest first, and their inner products; -1 where there are fewer."""
    n, m = len(queries), len(entries)
    beam = max(beam, m)
    nodes, score, fresh = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32), np.zeros((n, beam), bool)
    nodes[:, :m], score[:, :m], fresh[:, :m] = entries, queries @ x[entries].T, True
    seen = np.full((n, len(x)), -1, np.int32)  # where a node first came from, in the step that met it
    seen[:, entries] = 0
    active = np.arange(n)
    while len(active):
        # the nearest few that have not been followed
        waiting = np.where(fresh[active], score[active], -np.inf)
        near = np.argpartition(-waiting, min(STEP, beam) - 1, axis=1)[:, :STEP]
        real = np.take_along_axis(waiting, near, axis=1) > -np.inf
        alive = real.any(axis=1)
        active, near, real = active[alive], near[alive], real[alive]
        if not len(active):
            break
        follow = np.where(real, np.take_along_axis(nodes[active], near, axis=1), 0)
        fresh[active[:, None], near] = False
        found = np.where(real[:, :, None], edges[follow], -1).reshape(len(active), -1)
        i, j = np.nonzero(found >= 0)
        there = found[i, j]
        new = seen[active[i], there] < 0
        i, j, there = i[new], j[new], there[new]
        seen[active[i], there] = j
        new = seen[active[i], there] == j  # of one node that came from two places, one
        i, j, there = i[new], j[new], there[new]
        near_by = np.full(found.shape, -np.inf, np.float32)
        near_by[i, j] = np.einsum("ij,ij->i", x[there], queries[active[i]])
        all_nodes, all_scores = np.hstack([nodes[active], found]), np.hstack([score[active], near_by])
        all_fresh = np.hstack([fresh[active], np.ones(found.shape, bool)])
        best = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        nodes[active], score[active] = np.take_along_axis(all_nodes, best, axis=1), np.take_along_axis(all_scores, best, axis=1)
        fresh[active] = np.take_along_axis(all_fresh, best, axis=1) & (score[active] > -np.inf)
    order = np.lexsort((nodes, -score), axis=1)
    nodes, score = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(score, order, axis=1)
    return np.where(score > -np.inf, nodes, -1), score


def pruned(x: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning of the ``proposed`` nodes (-1: none) of each node in ``own``: at most ``degree``, -1 for the rest."""
    out = np.full((len(own), degree), -1, np.int32)
    for at in range(0, len(own), BATCH):
        mine, nodes = own[at : at + BATCH], proposed[at : at + BATCH]
        theirs = x[np.maximum(nodes, 0)]
        squares = 2 * float(x[0] @ x[0])  # all nodes have one length
        far = np.where((nodes >= 0) & (nodes != mine[:, None]), squares - 2 * np.einsum("ijk,ik->ij", theirs, x[mine]), np.inf)
        order = np.lexsort((nodes, far), axis=1)
        nodes, far = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(far, order, axis=1)
        theirs = np.take_along_axis(theirs, order[:, :, None], axis=1)
        between = squares - 2 * (theirs @ theirs.transpose(0, 2, 1))
        alive = np.isfinite(far)
        alive[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        rows = np.arange(len(mine))
        for k in range(degree):
            pick = alive.argmax(axis=1)
            there = alive[rows, pick]
            if not there.any():
                break
            out[at + rows[there], k] = nodes[rows[there], pick[there]]
            alive[rows, pick] = False
            alive &= (SLACK**2 * between[rows, pick] > far) | ~there[:, None]
    return out


def graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> np.ndarray:
    """The edges (nodes, degree and some room) of a graph over vectors of equal length; -1 for none."""
    n = len(x)
    room = degree + degree // 2
    edges = np.full((n, room), -1, np.int32)
    first = min(n, 4 * ENTRIES)
    edges[:first, :degree] = pruned(x, np.arange(first), np.tile(np.arange(first, dtype=np.int32), (first, 1)), degree)
    entries = np.arange(min(n, ENTRIES))
    at = first
    while at < n:
        new = np.arange(at, min(n, at + min(at, BATCH)))
        nodes, _ = beam_search(x[:at], edges[:at], x[new], entries, beam)
        edges[new, :degree] = out = pruned(x, new, nodes, degree)
        # reverse edges, by the node that gets them
        i, j = np.nonzero(out >= 0)
        to, by = out[i, j], new[i].astype(np.int32)
        order = np.lexsort((by, to))
        to, by = to[order], by[order]
        owners, starts, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(starts, counts)
        used = (edges[owners] >= 0).sum(axis=1)
        fits = used + counts <= room
        simple = np.repeat(fits, counts)
        edges[to[simple], (np.repeat(used, counts) + place)[simple]] = by[simple]
        if len(full := np.flatnonzero(~fits)):
            more = np.full((len(full), int(counts[full].max())), -1, np.int32)
            which = np.full(len(owners), -1)
            which[full] = np.arange(len(full))
            more[np.repeat(which, counts)[~simple], place[~simple]] = by[~simple]
            kept = pruned(x, owners[full], np.hstack([edges[owners[full]], more]), degree)
            edges[owners[full]] = -1
            edges[owners[full], :degree] = kept
        at += len(new)
    return edges


class Band:
    """A band's nodes: vectors as they came, ids of each, and the graph over vectors of equal length."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, ids: np.ndarray, ends: np.ndarray):
        self.x, self.edges, self.ids, self.ends = x, edges, ids, ends
        self.begins = np.append(0, ends[:-1])
        # one more component, which queries have as 0
        self.flat = np.hstack([x.astype(np.float32), np.zeros((len(x), 1), np.float32)])
        self.entries = np.arange(min(len(x), ENTRIES))

    @staticmethod
    def made(ids: np.ndarray, x: np.ndarray) -> Band:
        x, node = np.unique(x, axis=0, return_inverse=True)
        # in an order of their own, so that the first ones, the entries, lie anywhere
        order = np.random.default_rng(len(x)).permutation(len(x))
        x, node = x[order], np.argsort(order)[node.ravel()]
        by = np.lexsort((ids, node))
        squares = (x * x).sum(axis=1)
        equal = np.hstack([x, np.sqrt(np.maximum(squares.max() - squares, 0.0))[:, None]])
        equal /= math.sqrt(squares.max())
        return Band(x, graph(equal.astype(np.float32)), ids[by], np.cumsum(np.bincount(node, minlength=len(x))))

    def arrays(self) -> list[np.ndarray]:
        return [self.x, self.edges, self.ids, self.ends]

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of the k best of what a beam search finds, the query's own id left out."""
        lengths = np.sqrt((queries * queries).sum(axis=1))[:, None]
        asked = np.hstack([queries / lengths, np.zeros((len(queries), 1))]).astype(np.float32)
        nodes, _ = beam_search(self.flat, self.edges, asked, self.entries, beam)
        i, j = np.nonzero(nodes >= 0)
        node = nodes[i, j]
        score = np.einsum("ij,ij->i", self.x[node], queries[i])
        # of a node's ids the k + 1 least are enough: one may be the query's own
        some = np.minimum(self.ends[node] - self.begins[node], k + 1)
        at = np.repeat(self.begins[node], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        i, score, other = np.repeat(i, some), np.repeat(score, some), self.ids[at]
        strange = other != ids[i]
        i, score, other = i[strange], score[strange], other[strange]
        order = np.lexsort((other, -score, i))
        i, score, other = i[order], score[order], other[order]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
        return i[place < k], other[place < k], score[place < k]


class Shard:
    """The bands of a shard, the longest vectors first."""

    def __init__(self, bands: list[Band]):
        self.bands = bands
        self.longest = [math.sqrt((b.x * b.x).sum(axis=1).max()) for b in bands]

    @staticmethod
    def made(ids: np.ndarray, x: np.ndarray) -> Shard:
        lengths = np.sqrt((x * x).sum(axis=1))
        # a margin, so that lengths that are equal but for rounding are in one band
        number = np.floor(np.log2(lengths.max() * (1 + 1e-6) / lengths)).astype(np.int64)
        return Shard([Band.made(ids[number == k], x[number == k]) for k in np.unique(number)])

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of what the bands' searches find; of each, the k best are among them."""
        lengths, last = np.sqrt((queries * queries).sum(axis=1)), np.full(len(queries), -np.inf)
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for band, longest in zip(self.bands, self.longest, strict=True):
            some = np.flatnonzero(lengths * longest * (1 + 1e-9) >= last)
            if len(some):
                i, other, score = band.best(ids[some], queries[some], k, beam)
                found = [np.concatenate(x) for x in zip(found, (some[i], other, score), strict=True)]
                order = np.lexsort((-found[2], found[0]))
                place = np.arange(len(order)) - np.searchsorted(found[0][order], found[0][order])
                kth = order[place == k - 1]
                last[found[0][kth]] = found[2][kth]
        return found[0], found[1], found[2]


def usable_rows(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    d = dimension(df, vector)
    good = F.col(vec_id).isNotNull() & usable(vector, d) & F.exists(vector, lambda v: v != 0)
    return df.where(good).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), d


def vector_index(df: DataFrame, shard_rows: int = SHARD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """shard, ordinal and payload (vectors, edges, ids, ends of each node's ids) of each shard's bands, over all usable rows."""
    rows, d = usable_rows(df, vec_id, vector)
    rows = written(rows.distinct(), "vectors")
    n = rows.count()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in runs(batches, 2):
            made = Shard.made(table.column(0).to_numpy(), matrix(table.column(1).combine_chunks(), d))
            for k, band in enumerate(made.bands):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([k], pa.int64()), pa.array([packed(*band.arrays())], pa.binary())], ["shard", "ordinal", "payload"])

    # a task a shard: rows are even under their hash, and repeated ones are gone
    shards = max(1, math.ceil(n / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).repartitionById(shards, "shard")
    return dealt.sortWithinPartitions("shard").mapInArrow(build, "shard long, ordinal long, payload binary")


def nearest_neighbours(df: DataFrame, query: Callable[[Column], Column], k: int = 20, beam: int = 192, shard_rows: int = SHARD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest that are found of each query, nearest first, ties by id.

    ``query`` says of an id whether its rows are queries."""
    index = written(vector_index(df, shard_rows, vec_id, vector), "index")
    rows, d = usable_rows(df, vec_id, vector)
    asked = written(in_blocks(rows.where(query(F.col("id"))).distinct(), "id", BLOCK, lambda t: [t.column(0).to_numpy(), matrix(t.column(1).combine_chunks(), d)]), "queries")

    def search(held: list[list[np.ndarray]]) -> Callable:
        shard = Shard([Band(*arrays) for arrays in held])

        def answer(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ids, queries = arrays
            i, other, score = shard.best(ids, queries, k, beam)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other), pa.array(score)], ["query_id", "vec_id", "score"])

        return answer

    found = against(asked, index, search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
