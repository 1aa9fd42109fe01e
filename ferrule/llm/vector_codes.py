"""Vector codes by product quantisation: k-means of each part of the vectors, exact in whole numbers.

Vectors become whole numbers, floor(``scale`` * x), and are cut into ``parts`` equal parts. They are stored as columnar
blocks, a component after another. A round is one ``treeAggregate`` over the blocks: for each part, the squared distances
of a block's rows to the codebook's entries grow dimension by dimension, the nearest entries (ties: the lower index) get
the rows' components and counts by ``np.add.at`` in int64, and these tensors, whose size depends on the codebooks alone,
merge through the reduction tree. What tasks get is a broadcast of the codebooks, ``entries`` vectors, and what the driver
gets are ``entries`` sums and counts. Sums of whole numbers are the same in any order, so a lost executor changes nothing.

Defined results: vectors that are null, empty, or hold null or non-finite components are dropped, as are those of another
length than most. Rows with a null id stay and come last where ids are ordered; repeated rows each count. An empty table
gives an empty one. A dimension that the parts do not divide, and numbers of 2**26 and more, are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import joined_by_count, written
from ferrule.llm.vectors import dimension, matrix, regrouped, usable

#: Rows of a block.
BLOCK = 2048
#: Whole numbers must be less than this, so that all distances and sums fit in 64 bits.
LARGEST = 1 << 26


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    out = np.floor(x * scale)
    if (np.abs(out) >= LARGEST).any():
        raise ValueError(f"a component times {scale} is not less than {LARGEST}")
    return out.astype(np.int64)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry and the squared distance; ``columns`` is (dimensions, rows)."""
    far = np.zeros((columns.shape[1], len(book)), np.int64)
    for column, entry in zip(columns, book.T, strict=True):
        gap = column[:, None] - entry[None, :]
        gap *= gap
        far += gap
    index = far.argmin(axis=1)  # the first of equal ones
    return index, far[np.arange(len(index)), index]


class Tensors:
    """Sums and counts of the rows that are nearest to each entry of each part."""

    def __init__(self, parts: int, entries: int, width: int):
        self.sums, self.counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)

    def add(self, columns: np.ndarray, books: np.ndarray) -> Tensors:
        for p, part in enumerate(np.split(columns, len(books))):
            index, _ = nearest(part, books[p])
            np.add.at(self.sums[p], index, part.T)
            np.add.at(self.counts[p], index, 1)
        return self

    def merge(self, other: Tensors) -> Tensors:
        self.sums += other.sums
        self.counts += other.counts
        return self

    def means(self, books: np.ndarray) -> np.ndarray:
        """Entries moved to the floor of their rows' mean; unused ones stay."""
        mean = np.floor_divide(self.sums, np.maximum(self.counts, 1)[:, :, None])
        return np.where(self.counts[:, :, None] > 0, mean, books)


def vector_blocks(df: DataFrame, d: int, scale: float, vec_id: str, vector: str, label: str) -> DataFrame:
    """ids, labels and the components of up to ``BLOCK`` rows, a component after another, as int64."""
    kinds = [df.schema[c].dataType.simpleString() for c in (vec_id, label)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in regrouped(batches, BLOCK):
            ids, labels, v = (table.column(k).combine_chunks() for k in range(3))
            columns = np.ascontiguousarray(whole(matrix(v, d), scale).T)
            wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([wrap(ids), wrap(labels), pa.array([columns.tobytes()], pa.binary())], ["ids", "labels", "columns"])

    rows = df.where(usable(vector, d)).select(F.col(vec_id), F.col(label), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(blocks, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, columns binary")


def trained(blocks: DataFrame, books: np.ndarray, rounds: int, d: int) -> np.ndarray:
    """The codebooks (parts, entries, width) after some rounds of k-means over all blocks."""
    shape = books.shape
    held = blocks.select("columns").rdd.map(lambda r: np.frombuffer(r.columns, np.int64).reshape(d, -1))
    for _ in range(rounds):
        shared = blocks.sparkSession.sparkContext.broadcast(books)
        total = held.treeAggregate(Tensors(*shape), lambda t, block: t.add(block, shared.value), lambda a, b: a.merge(b))  # noqa: B023
        books = total.means(books)
        shared.unpersist()
    return books


def vector_codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each kept row."""
    if not 0 < entries <= 256:
        raise ValueError("there are 1 to 256 entries")
    d = dimension(df, vector)
    if d % parts:
        raise ValueError(f"{d} components can't be cut into {parts} equal parts")
    kind = df.schema[vec_id].dataType.simpleString()
    # the first entries are those of the least ids: as many rows as a codebook has
    first = df.where(usable(vector, d)).select(F.col(vec_id).alias("k"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries)
    least = [r.v for r in first.collect()]
    if not least:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    start = whole(np.array(least), scale)
    blocks = written(vector_blocks(df, d, scale, vec_id, vector, label), "blocks")
    books = trained(blocks, np.stack(np.split(start, parts, axis=1)), rounds, d)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(books)
    hexes = np.array([f"{k:02x}" for k in range(256)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64).reshape(d, -1)
                error, code = np.zeros(columns.shape[1], np.int64), np.full(columns.shape[1], "", object)
                for book, part in zip(shared.value, np.split(columns, parts), strict=True):
                    index, far = nearest(part, book)
                    error += far
                    code += hexes[index].astype(object)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = f"vec_id {kind}, label {df.schema[label].dataType.simpleString()}, code string, error long"
    rows = written(blocks.select("ids", "labels", "columns").mapInArrow(coded, kinds), "codes")
    # null labels are one label
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    return joined_by_count(keyed, totals, "key", "__n").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
