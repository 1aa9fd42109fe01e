"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.plans.store import stored

#: Separators of words: the ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SEPARATORS = r"[\x20\x09-\x0D]+"

#: Bytes of text that are worked on together in Python; a longer text is alone.
BATCH_BYTES = 4_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there, so that a lost executor
    costs a reread and not the work before it."""
    return stored(df, name)


#: A key is hot that has more than one in so many rows, so there are fewer hot keys than this.
SHARES = 512


def joined_by_count(rows: DataFrame, table: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, whose ``key`` is unique and whose ``count`` says how many of the rows have it.

    Keys with more than one in ``SHARES`` rows are split off: fewer than ``SHARES`` such keys can exist, so they are sent
    to the rows, which stay where they are. The others are shuffled, and none of them fills a task. ``rows``, of which
    there are ``total``, is read twice, so it should be a written table or little more."""
    table = written(table, "counts")
    limit = (rows.count() if total is None else total) // SHARES
    hot, others = table.where(F.col(count) > limit), table.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts in ``column`` of each have ``limit`` bytes at most, or are a single one."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = before = 0
        while at < batch.num_rows:
            z = max(at + 1, int(np.searchsorted(upto, before + limit, "right")))
            yield batch.slice(at, z - at)
            at, before = z, int(upto[z - 1])
