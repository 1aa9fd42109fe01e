"""Benchmark decontamination by spaced-seed hashing.

A document leaks a benchmark item when some ``WINDOW`` words of the two, in line without gaps, agree in all but at most
``SUBSTITUTIONS`` places. Fixed masks select words of a window and ignore the rest; the chosen words are hashed at every
place of the items and of the documents, and equal hashes are joined. The masks are such that every leak gives a hit: of
any 13 words with 2 substituted, one of the masks fits between them (a test tries all cases). Around each hit all
windows on its diagonal are compared word by word, so that the result is exact, whatever the hashes do.

Words are lower-case, without ASCII punctuation, and part at ASCII white space. Of an item of 5 to 12 words all must
agree; shorter ones aren't searched for.

How hashes are joined goes by the benchmark's size. Up to ``block_chars`` code points, its hashes are an index that goes to
all tasks: a word takes two code points with its separator, and at most ``WORD_BYTES`` bytes in the index. Documents are
searched as they come, so hot sources or copies make no task larger and nothing is shuffled.

A larger benchmark is joined in one scan of the documents, whatever its size. A Bloom filter of its hashes, of a fixed
``FILTER_BITS``, goes to all tasks; documents with a place that passes are kept in a table, with the hashes of these places.
Their hashes are shuffled once, against those of the items, and pairs of document and item with their diagonals are
verified in tasks. Hashes and items with very many places are split off by their counts (``joined_by_count``).

Defined results: null or empty texts leak nothing; repeated documents each give their rows; repeated items count once;
items that share an id are one item, of which the best overlap is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ferrule.llm.common import SHARES, by_bytes, joined_by_count, written

WINDOW = 13
SUBSTITUTIONS = 2
SHORTEST_ITEM = 5
#: The spaced seeds; 1 selects a word. Their span is 8.
MASKS = ("11101011", "11001111")
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Bytes of an index for each word of its items, at most: 8 for the word, and for each mask 8 for a hash, 8 for its place,
#: and up to 32 bits of the filter.
WORD_BYTES = 8 + 2 * (8 + 8 + 4)
#: Code points of a benchmark that goes to all tasks, so that its index has 100 MB at most, besides its different words.
BLOCK_CHARS = 4_000_000
#: Bytes of documents that are hashed together.
TOGETHER = 500_000
#: Bits of the filter of a larger benchmark's hashes: 32 MB.
FILTER_BITS = 1 << 28


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split()


def mixed(ids: np.ndarray, mask: str, length: int) -> np.ndarray:
    """For each of ``length`` places, the hash of the words that the mask selects there."""
    h = np.full(length, int(mask, 2) + 1, dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ ids[i : i + length]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def overlap(stream: np.ndarray, token: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """What an item has in common with a text where its first word is at ``diagonal``: matched words, and negated, so that
    the greatest is the best, words of the overlap, its first word in the text, and in the item."""
    a, z = max(diagonal, 0), min(diagonal + len(token), len(stream))
    width = min(WINDOW, len(token))
    if z - a < width:
        return None
    same = (stream[a:z] == token[a - diagonal : z - diagonal]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= width - (SUBSTITUTIONS if width == WINDOW else 0))
    if not len(good):
        return None
    covered = np.zeros(z - a + 1, dtype=np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + width, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return int(same[inside].sum()), -int(inside.sum()), -int(a + good[0]), -int(a + good[0] - diagonal)


class SeedIndex:
    """The seeds of some benchmark items and what is needed to verify their hits."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = list(dict.fromkeys(i for i, _ in items))
        number = {i: k for k, i in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        self.owner: list[int] = []
        self.tokens: list[np.ndarray] = []
        for i, text in items:
            w = words_of(text or "")
            if len(w) >= SHORTEST_ITEM:
                self.owner.append(number[i])
                self.tokens.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], dtype=np.uint64))
        spans = {len(MASKS[0])} | {len(t) for t in self.tokens if len(t) < len(MASKS[0])}
        self.masks = [m for n in sorted(spans) for m in (MASKS if n == len(MASKS[0]) else ("1" * n,))]
        self.tables = []
        for mask in self.masks:
            parts = [(mixed(t, mask, len(t) - len(mask) + 1), k) for k, t in enumerate(self.tokens) if len(t) >= len(mask) and (len(mask) == len(MASKS[0]) or len(mask) == len(t))]
            hashes = np.concatenate([h for h, _ in parts] or [np.zeros(0, np.uint64)])
            where = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in parts] or [np.zeros(0, np.int32)])
            which = np.concatenate([np.full(len(h), k, np.int32) for h, k in parts] or [np.zeros(0, np.int32)])
            order = np.argsort(hashes, kind="stable")
            # a bit for the first bits of each hash: 16 to 32 bits a hash
            bits = max(12, int(len(hashes) * 16).bit_length())
            first = hashes[order] >> np.uint64(64 - bits)
            known = np.zeros(1 << (bits - 3), dtype=np.uint8)
            np.bitwise_or.at(known, (first >> np.uint64(3)).astype(np.int64), np.uint8(1) << (first & np.uint64(7)).astype(np.uint8))
            self.tables.append((mask, hashes[order], which[order], where[order], known, np.uint64(64 - bits)))

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in self.tokens) + sum(x.nbytes for table in self.tables for x in table[1:5])

    def overlaps(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, matched words, words of the overlap, its first word in the text, and in the item), the best for
        each text and item."""
        gap = len(MASKS[0])
        ids: list[int] = []
        starts, ends = [], []
        get = self.vocabulary.get
        for text in texts:
            starts.append(len(ids))
            if text:
                ids.extend(map(get, words_of(text), repeat(0)))
            ends.append(len(ids))
            ids.extend(repeat(0, gap))
        stream = np.array(ids, dtype=np.uint64)
        begin, end = np.array(starts), np.array(ends)
        hits = set()
        for mask, hashes, which, where, known, shift in self.tables:
            n = len(stream) - len(mask) + 1
            if n <= 0 or not len(hashes):
                continue
            h = mixed(stream, mask, n)
            first = h >> shift
            at = np.flatnonzero((known[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & 1)
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            if len(at):
                k = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(at, count)
                text = np.searchsorted(begin, place, "right") - 1
                found = np.stack([text, which[k].astype(np.int64), place - where[k]], axis=1)
                hits.update(map(tuple, np.unique(found, axis=0).tolist()))
        best: dict[tuple[int, int], tuple] = {}
        for text, item, diagonal in hits:
            got = overlap(stream[begin[text] : end[text]], self.tokens[item], diagonal - int(begin[text]))
            if got is not None:
                key = (text, self.owner[item])
                best[key] = max(best.get(key, got), got)
        return sorted((t, i, m, -n, -d, -p) for (t, i), (m, n, d, p) in best.items())


def fits(benchmark: DataFrame, text: str, block_chars: int) -> bool:
    return (benchmark.agg(F.sum(F.length(text))).first()[0] or 0) <= block_chars


def index_of(benchmark: DataFrame, item_id: str, text: str) -> SeedIndex:
    """The index of a benchmark that fits; its items go through the driver."""
    rows = benchmark.select(F.col(item_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct().orderBy("id", "text")
    return SeedIndex([(r.id, r.text) for r in rows.collect()])


def searched(rows: DataFrame, shared: Broadcast, schema: T.StructType) -> DataFrame:
    """The overlaps of ``rows``, (key, text), with one block's items."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for part in by_bytes(batches, 1, TOGETHER):
            if found := seeds.overlaps(part.column(1).to_pylist()):
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0])), pa.array([seeds.ids[i] for i in cols[1]]), *(pa.array(c, pa.int64()) for c in cols[2:])], schema.names)

    return rows.mapInArrow(search, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, matched_words, overlap_words, doc_start and
    item_start (words from 0, on the diagonal of most matched words)."""
    return _overlaps(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, item_id, item_text, block_chars)


def _overlaps(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> DataFrame:
    spark = rows.sparkSession
    schema = T.StructType([rows.schema[0], T.StructField("item_id", benchmark.schema[item_id].dataType), *(T.StructField(n, T.LongType()) for n in ("matched_words", "overlap_words", "doc_start", "item_start"))])
    if fits(benchmark, item_text, block_chars):
        index = index_of(benchmark, item_id, item_text)
        return searched(rows, spark.sparkContext.broadcast(index), schema) if index.tokens else spark.createDataFrame([], schema)
    return joined(rows, benchmark, item_id, item_text, schema)


def hashed_places(words: list[bytes], known: np.ndarray | None = None, item: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all masks at all places of a text, and the places; only those that pass the filter ``known``. An item's
    are those of its own length's masks; a text's are of all masks, as items of any length may be in it."""
    w = np.array(list(map(xxh3_64_intdigest, words)), dtype=np.uint64)
    long = len(MASKS[0])
    short = range(SHORTEST_ITEM, long)
    masks = [*(MASKS if len(w) >= long else ()), *("1" * n for n in short if (n == len(w) if item else n <= len(w)))]
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for mask in masks:
        h = mixed(w, mask, len(w) - len(mask) + 1)
        at = np.arange(len(h)) if known is None else np.flatnonzero(passes(known, h))
        hashes.append(h[at])
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in the filter."""
    last = np.uint64(FILTER_BITS - 1)
    return h & last, (h >> np.uint64(32)) & last


def passes(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = bits_of(h)
    set_ = lambda b: (known[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
    return (set_(one) & set_(two)).astype(bool)


def joined(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, schema: T.StructType) -> DataFrame:
    """The overlaps of ``rows``, (key, text), with a benchmark of any size."""
    spark = rows.sparkSession
    items = written(benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "items")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, TOGETHER):
            found = [hashed_places(words_of(t), item=True) for t in batch.column(1).to_pylist()]
            sizes = [len(h) for h, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.concatenate([h for h, _ in found]).view(np.int64)), pa.array(np.concatenate([p for _, p in found]))], ["item", "hash", "place"])

    seeded = written(items.select("item", "text").mapInArrow(seeds, "item long, hash long, place long"), "seeds")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for b in bits_of(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(known, b >> np.uint64(3), np.uint8(1) << (b & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([known.tobytes()], pa.binary())], ["bits"])

    # filters of a fixed size are merged in a tree
    filters = seeded.select("hash").mapInArrow(bits, "bits binary").rdd.map(lambda r: bytes(r.bits))
    known = np.frombuffer(filters.treeReduce(lambda a, b: np.bitwise_or(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()), np.uint8)
    shared = spark.sparkContext.broadcast(known)
    kind = rows.schema[0].dataType.simpleString()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, TOGETHER):
            found = [hashed_places(words_of(t or ""), shared.value) for t in batch.column(1).to_pylist()]
            some = pa.array([k for k, (h, _) in enumerate(found) if len(h)], pa.int64())
            lists = [pa.array([list(x[c].view(np.int64)) for x in found if len(x[0])], pa.list_(pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), *lists], ["key", "text", "hashes", "places"])

    docs = written(rows.mapInArrow(candidates, f"key {kind}, text string, hashes array<long>, places array<long>").withColumn("doc", F.monotonically_increasing_id()), "candidates")
    hits = docs.select("doc", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("doc", F.col("h.hashes").alias("hash"), F.col("h.places").alias("at"))
    counts = hits.groupBy("hash").agg(F.count("*").alias("n"))
    places = seeded.groupBy("hash").agg(F.collect_list(F.struct("item", "place")).alias("seeds")).join(counts, "hash")
    met = joined_by_count(hits, places, "hash", "n").select("doc", "at", F.explode("seeds").alias("s"))
    pairs = met.groupBy("doc", F.col("s.item").alias("item")).agg(F.collect_set(F.col("at") - F.col("s.place")).alias("diagonals"))
    pairs = written(pairs, "pairs")
    wanted = items.join(pairs.groupBy("item").agg(F.count("*").alias("n")), "item").select("item", "item_id", F.col("text").alias("item_text"), "n")
    both = joined_by_count(pairs, wanted, "item", "n").join(docs.select("doc", "key", "text"), "doc")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, TOGETHER):
            out: list[list] = [[], [], [], [], []]
            for k, (item, text, diagonals) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                number: dict[bytes, int] = {}
                token, stream = ([number.setdefault(w, len(number)) for w in words_of(t)] for t in (item, text))
                token, stream = np.array(token), np.array(stream)
                if found := max((o for d in diagonals if (o := overlap(stream, token, d)) is not None), default=None):
                    m, n, d, p = found
                    for column, value in zip(out, (k, m, -n, -d, -p), strict=True):
                        column.append(value)
            if out[0]:
                at = pa.array(out[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(4).take(at), *(pa.array(c, pa.int64()) for c in out[1:]), batch.column(5).take(at)], [*schema.names, "doc"])

    item_kind = schema["item_id"].dataType.simpleString()
    checked = both.select("key", "item_text", "text", "diagonals", "item_id", "doc").mapInArrow(verified, f"{schema.names[0]} {kind}, item_id {item_kind}, matched_words long, overlap_words long, doc_start long, item_start long, doc long")
    # items that share an id are one: of their overlaps with a document the best, as for one item
    best = F.max(F.struct("matched_words", (-F.col("overlap_words")).alias("n"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("p"))).alias("b")
    out = checked.groupBy("doc", "item_id").agg(best, F.first(schema.names[0]).alias("__key"))
    return out.select(F.col("__key").alias(schema.names[0]), "item_id", "b.matched_words", (-F.col("b.n")).alias("overlap_words"), (-F.col("b.d")).alias("doc_start"), (-F.col("b.p")).alias("item_start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    if not fits(benchmark, item_text, block_chars):
        # texts that leak, by their digests; those of very many documents are split off
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        leaks = written(_overlaps(docs.select(digest.alias("digest"), F.col(text).alias("text")), benchmark, item_id, item_text, block_chars).groupBy("digest").agg(F.count("*").alias("n")), "leaks")
        limit = max(docs.count() // SHARES, 1000)
        hot, others = leaks.where(F.col("n") > limit).select("digest"), leaks.where(F.col("n") <= limit).select("digest")
        own = docs.withColumn("__own", digest)
        own = own.join(F.broadcast(hot), F.col("__own") == F.col("digest"), "left_anti")
        return own.join(others, F.col("__own") == F.col("digest"), "left_anti").drop("__own")
    index = index_of(benchmark, item_id, item_text)
    if not index.tokens:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(index)
    column = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in by_bytes(batches, column, TOGETHER):
            clean = np.ones(batch.num_rows, dtype=bool)
            for leak in seeds.overlaps(batch.column(column).to_pylist()):
                clean[leak[0]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
