"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces, without their texts, are dealt out evenly and mixed by a hash, so that each task sees the corpus's mix of lengths
however its sources lie. A task packs its pieces in chunks, the largest first, each into the fullest bin that has room.
Bins that are full but for ``slack`` tokens are emitted. The others climb a tree: a node's underfull bins are the items
of another best fit, which is to say that whole bins are joined and their pieces move along. The first round joins the
bins of a task's chunks, each later one those of ``fan_in`` nodes, until one node is left.

To a best fit, bins are equal that are equally full. So what climbs is how many bins of each fill a node has, which are
at most ``capacity`` numbers, however large the corpus is, and all underfull bins of a node are packed at every level:
items of one size go into bins of one size in a single step (``fit``). The outcome is a plan of ranges, "bins 0 to 499 of
those with fill 700 go two and two into the new bins 0 to 249", and the bins follow it by a join on node and fill. A join
key holds ``BLOCK`` bins at most.

Each round is written in the shared folder before the next reads it, so a lost executor repeats one task and cannot
change what was packed before.

Defined results: a null text has the end token alone; repeated rows are packed each on its own; sequence ids are any
distinct numbers; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import by_bytes, written
from ferrule.llm.tokens import pieces

#: Pieces that a task packs together in the first round.
CHUNK = 20_000
#: Bins of one node and fill that meet in one key of a join.
BLOCK = 4096
#: Bits of a sequence id: the round, the task or node, and the bin.
NODE_BITS, BIN_BITS = 24, 34


def fit(counts: np.ndarray, capacity: int) -> tuple[list[tuple], list[tuple]]:
    """Best fit of ``counts[s]`` items of each size s, the largest first, each into the fullest bin with room.

    Gives runs (size, items a bin, first bin, bins, offset), in the order of the items, largest first: each puts so many
    items of a size, one behind the other, into each of some bins in a row; and ranges (first bin, bins, fill) of the bins
    as they are at last. An item's room at least halves a bin's, so the work doesn't grow with the counts."""
    with_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    some = made = 0  # some: bit r is set while a bin has room for r
    runs = []
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            fits = some >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                first, bins = with_room[room].pop()
                if not with_room[room]:
                    some ^= 1 << room
            else:
                room, first = capacity, made
                bins = -(-left // (capacity // size))
                made += bins
            each = room // size
            full = min(bins, left // each)
            parts = [(full, each)] if full else []
            if full < bins and left - full * each:
                parts.append((1, left - full * each))
            for some_bins, items in parts:
                runs.append((size, items, first, some_bins, capacity - room))
                rest = room - items * size
                with_room[rest].append((first, some_bins))
                some |= 1 << rest
                first, bins, left = first + some_bins, bins - some_bins, left - some_bins * items
            if bins:
                with_room[room].append((first, bins))
                some |= 1 << room
    return runs, sorted((first, bins, capacity - room) for room, own in enumerate(with_room) for first, bins in own)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order, at = np.argsort(-sizes, kind="stable"), 0
    for size, each, first, n, base in fit(np.bincount(sizes, minlength=1), capacity)[0]:
        q = np.arange(n * each)
        own = order[at : at + n * each]
        bins[own], offsets[own] = first + q // each, base + q % each * size
        at += n * each
    return bins, offsets


PLAN = "node long, fill long, low long, high long, parent long, shift long, each long, base long, first long, into_fill long, into_rank long, into_closed boolean"


def plan(frame: pd.DataFrame, capacity: int, slack: int, last: bool) -> pd.DataFrame:
    """What becomes of the underfull bins of a node's children, which are given by child, fill and count.

    Of a child's bins with one fill, those ranked from ``low`` to ``high`` go, ``each`` in one, into new bins from
    ``first`` on, from the offset ``base`` on; ``shift`` of their run precede them. The new bins have ``into_fill`` tokens,
    and are closed or have ranks from ``into_rank`` on among the parent's bins."""
    frame = frame.sort_values(["fill", "node"], ascending=[False, True])
    fills, nodes, counts = (frame[c].to_numpy() for c in ("fill", "node", "n"))
    runs, ranges = fit(np.bincount(fills, weights=counts, minlength=1).astype(np.int64), capacity)
    first = np.array([r[0] for r in ranges])
    ranks: dict[int, int] = {}
    rank = []
    for _, n, fill in ranges:
        rank.append(ranks.get(fill, 0))
        ranks[fill] = rank[-1] + n
    ends = np.cumsum(counts)  # children's items follow each other, as those of the runs do
    rows, at = [], 0
    for size, each, begin, bins, base in runs:
        r = int(np.searchsorted(first, begin, "right")) - 1
        b = begin
        while b < begin + bins:
            z = min(begin + bins, ranges[r][0] + ranges[r][1])
            a, stop = at + (b - begin) * each, at + (z - begin) * each
            k = int(np.searchsorted(ends, a, "right"))
            low = a
            while low < stop:
                high = min(stop, int(ends[k]))
                start = int(ends[k] - counts[k])
                rows.append((nodes[k], size, low - start, high - start, frame["parent"].iat[0], low - a, each, base, b, ranges[r][2], rank[r] + b - ranges[r][0], bool(last or ranges[r][2] >= capacity - slack)))
                low, k = high, k + 1
            b, r = z, r + 1
        at += bins * each
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])


PACKED = T.StructType([T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "fill", "node", "rank")] + [T.StructField("closed", T.BooleanType())])


def mixed_pieces(docs: DataFrame, path: str, capacity: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of all documents' pieces, dealt out evenly, in the order of a hash."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            found = np.array(list(pieces(batch.column(1).to_pylist(), path, capacity)), np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1].astype(np.int32)), *(pa.array(found[:, k]) for k in (2, 3, 4))], schema.names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # in turn and not by a key, so that repeated rows don't meet in one task
    return rows.mapInArrow(cut, schema).hint("rebalance").sortWithinPartitions(F.xxhash64(*schema.names), *schema.names)


def local_packing(docs: DataFrame, path: str, capacity: int, slack: int, doc_id: str, text: str) -> DataFrame:
    """The pieces of all documents, packed by each task among those dealt to it; a chunk is a node."""
    dealt = mixed_pieces(docs, path, capacity, doc_id, text)
    schema = T.StructType([*dealt.schema, *PACKED])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, chunks = TaskContext.get().partitionId(), 0, 0
        waiting: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, chunks
            rows = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            sizes = rows.column("length").to_numpy()
            bins, offsets = best_fit(sizes, capacity)
            fills = np.bincount(bins, weights=sizes).astype(np.int64)
            order = np.argsort(fills, kind="stable")
            rank = np.zeros(len(fills), np.int64)
            rank[order] = np.arange(len(fills)) - np.searchsorted(fills[order], fills[order], "left")
            new = [bins + made + (task << BIN_BITS), offsets, fills[bins], np.full(len(bins), (task << 20) + chunks), rank[bins], fills[bins] >= capacity - slack]
            made, chunks = made + len(fills), chunks + 1
            return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns] + [pa.array(c) for c in new], schema.names)

        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                waiting.append(whole.slice(at, CHUNK))
                if sum(b.num_rows for b in waiting) >= CHUNK:
                    yield flush()
        if waiting:
            yield flush()

    return dealt.mapInArrow(pack, schema)


def climbed(rows: DataFrame, parent, number: int, capacity: int, slack: int, last: bool) -> DataFrame:
    """Pieces of underfull bins, with their bins joined into those of the parents."""
    counts = rows.where("offset = 0").groupBy("node", "fill").agg(F.count("*").alias("n")).withColumn("parent", parent)
    steps = counts.groupBy("parent").applyInPandas(lambda frame: plan(frame, capacity, slack, last), PLAN)
    blocks = F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK))
    steps = steps.withColumn("block", F.explode(blocks)).withColumnRenamed("node", "__node").withColumnRenamed("fill", "__fill")
    placed = rows.withColumn("__block", F.floor(F.col("rank") / BLOCK))
    on = (F.col("node") == F.col("__node")) & (F.col("fill") == F.col("__fill")) & (F.col("__block") == F.col("block")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    place = F.col("shift") + F.col("rank") - F.col("low")
    bin_ = F.floor(place / F.col("each"))
    own = {
        "sequence_id": F.lit(number << (NODE_BITS + BIN_BITS)) + F.shiftleft("parent", BIN_BITS) + F.col("first") + bin_,
        "offset": F.col("base") + (place % F.col("each")) * F.col("fill") + F.col("offset"),
        "fill": F.col("into_fill"), "node": F.col("parent"), "rank": F.col("into_rank") + bin_, "closed": F.col("into_closed"),
    }
    return placed.join(steps, on).select(*(own[c].alias(c) if c in own else F.col(c) for c in rows.columns))


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 2048, slack: int = 16, fan_in: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of each document."""
    level = written(local_packing(docs, path, capacity, slack, doc_id, text), "packing")
    top = level.agg(F.max(F.shiftright("node", 20))).first()[0]
    done = [level.where("closed")]
    number, parent = 1, F.shiftright("node", 20)
    while top is not None:
        last = number > 1 and top < fan_in
        if number > 1:
            parent, top = F.floor(F.col("node") / fan_in), top // fan_in
        level = written(climbed(level.where("NOT closed"), parent, number, capacity, slack, last), "packing")
        done.append(level.where("closed"))
        number, top = number + 1, None if last else top
    return reduce(DataFrame.unionByName, done).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
