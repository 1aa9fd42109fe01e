"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Two documents are linked when the sets of their ``ngram``-word shingles have a Jaccard similarity of ``threshold`` or
more. The result has a row for each document: its class (the least id that links lead to) and its number of links.

1. Documents with equal texts are one; the rest of the work is on distinct texts, and membership is kept aside.
2. Forest: each text gets ``trees`` labels of ``depth`` MinHash values, and each tree is the prefix trie of its labels in
   sorted order. Texts that share the shortest prefix that is ever needed meet in one bucket, a subtrie. There the matched
   prefix begins as the whole label and is shortened value by value: at each length, the texts below one node are
   compared that no longer prefix has put together yet, and no others, until the prefix is so short that pairs at the
   threshold meet with the target recall.
3. Texts that meet are put together where the estimate from their whole signatures is ``likely`` or more; the recall
   counts in what this misses. A bucket's leader, its text with the least id, is compared with the others first; those
   that are like it are one group already. Where few are left over, each of these is compared with all of its bucket, so
   near copies, however many, take work and shuffle in proportion to their number (``led``). The edges are at most the
   bucket's rows; pairs are compared within a task and never emitted. Connected components of all edges are the groups
   within which links are sought.
4. Verification: a text's shingle set is kept as its difference from that of the group's first text, which is little for
   near copies. In each group, all pairs' intersections are computed exactly from these differences. A task reports a
   count of links for each text and a spanning forest of the links, so no link between different texts is lost and none
   is emitted.
5. Connected components of the verified links are the classes.

Buckets and groups of any size are dealt out in blocks, a task for each pair of blocks, so the memory of a task is bounded
and a large group is shared among tasks. Blocks go by the hash of the id. A bucket's blocks have ``block`` texts; a
group's have as many as have differences of ``BLOCK_BYTES``, and 1024 at most.

Defined results: texts of fewer words than ``ngram`` have one shingle, all their words; null texts and those without
words link to nothing and are each a class of their own, as are rows with a null id; rows that share an id are one
document, with all their texts. Words are ``[^\\x20\\x09-\\x0D]+``, case and punctuation count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ferrule.llm.common import by_bytes, joined_by_count, written
from ferrule.llm.components import connected_components
from ferrule.plans.store import discard

ODD = np.uint64(0x9E3779B97F4A7C15)
#: The block of rows that are left over when a bucket's others are like its leader.
LEFT = -1
#: Bytes of shingles in a block of a group.
BLOCK_BYTES = 8_000_000


def shingles(text: str | None, ngram: int) -> np.ndarray:
    """The sorted set of a text's shingles, by 64-bit hash."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(xxh3_64_intdigest, words)), dtype=np.uint64)
    n = max(1, len(w) - ngram + 1)
    h = np.full(n, len(w) if len(w) < ngram else ngram, np.uint64)
    for i in range(min(ngram, len(w))):
        h = (h ^ w[i : i + n]) * ODD
        h ^= h >> np.uint64(32)
    return np.unique(h)


class Forest:
    """MinHash labels of sets: ``trees`` labels of ``depth`` values each."""

    def __init__(self, trees: int, depth: int, seed: int = 1):
        self.trees, self.depth = trees, depth
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, trees * depth, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(hashes), 1024):
            part = hashes[at : at + 1024, None] * self.a + self.b
            part >>= np.uint64(32)
            np.minimum(best, part.min(axis=0).astype(np.uint32), out=best)
        return best

    def recall(self, threshold: float, length: int, likely: float) -> float:
        """How surely a pair at the threshold shares a prefix in some tree and has a likely estimate, at the least."""
        n = self.trees * self.depth
        passes = sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(math.ceil(likely * n - 1e-9), n + 1))
        return (1 - (1 - threshold**length) ** self.trees) * passes

    def shortest(self, threshold: float, recall: float, likely: float) -> int:
        """Where the shortening of prefixes ends: at the longest one that reaches the target recall."""
        length = self.depth
        while length > 1 and self.recall(threshold, length, likely) < recall:
            length -= 1
        return length

    def buckets(self, signature: np.ndarray, length: int) -> np.ndarray:
        """The label prefix of each tree as one number, the tree's own included."""
        labels = signature.reshape(self.trees, self.depth)[:, :length].astype(np.uint64)
        h = np.arange(1, self.trees + 1, dtype=np.uint64) * ODD
        for i in range(length):
            h = (h ^ labels[:, i]) * ODD
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of rows with equal keys, in batches that are sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        values = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for a, z in zip([0, *cuts[:-1]], cuts, strict=False):
            yield tuple(values[a].tolist()), table.slice(a, z - a)
        rest = table.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield tuple(rest.column(k)[0].as_py() for k in keys), rest


class Links:
    """Union-find over the ids of one task's group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, pairs: np.ndarray) -> list[tuple[int, int]]:
        """Of the pairs, those that joined what wasn't joined before."""
        out = []
        for i, j in pairs.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((i, j))
        return out


def in_blocks(rows: DataFrame, group: str, node: str, blocks: Column, sizes: DataFrame, total: int | None = None) -> DataFrame:
    """``rows`` with ``own``, ``first`` and ``second``: a copy for each pair of blocks of its group that its own is in.

    ``sizes`` has the rows of each group, and what ``blocks`` needs to say into how many it goes."""
    sized = joined_by_count(rows, sizes, group, "rows", total).withColumn("__blocks", blocks.cast("int"))
    own = F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("__blocks")).cast("int")
    sized = sized.withColumn("own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return sized.select(*rows.columns, "own", F.least("own", "__other").alias("first"), F.greatest("own", "__other").alias("second"))


def compared(rows: DataFrame, group: str, task: Callable, schema: str) -> DataFrame:
    """``task`` on each pair of blocks of each group; a task reads the groups dealt to it one after another."""
    keys = [group, "first", "second"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lambda batches: (b for k, g in grouped(batches, keys) if g.num_rows > 1 for b in task(k, g)), schema)


def alike(batches: Iterator[pa.RecordBatch], likely: float) -> Iterator[pa.RecordBatch]:
    """Rows with whether their signature, the last but one column, is like that of their bucket's leader, the last."""
    for batch in batches:
        own, first = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[-2:])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array((own == first).mean(axis=1) >= likely)], [*batch.schema.names[:-2], "like"])


def led(placed: DataFrame, texts: DataFrame, total: int, block: int, likely: float) -> tuple[DataFrame, DataFrame]:
    """Edges of rows to the leader that they are like, and the rows that are still to be compared, with the blocks of each.

    ``placed`` is (node, tree, bucket), of ``total`` rows, and ``texts`` has each node's signature. A row that is like the
    leader is in a block of its own; one that isn't is in all of them, so what is shuffled is a row each, and for each that
    is left over one a block. Where these are more than one in ``block``, all pairs of blocks are compared."""
    signs = texts.select("node", "signature")
    leaders = placed.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("node").alias("leader")).where("rows > 1")
    leaders = leaders.join(signs.select(F.col("node").alias("leader"), F.col("signature").alias("sign")), "leader")
    both = joined_by_count(placed, leaders, "bucket", "rows", total).join(signs, "node").select("bucket", "tree", "node", "leader", "signature", "sign")
    checked = written(both.mapInArrow(lambda batches: alike(batches, likely), "bucket long, tree int, node long, leader long, like boolean"), "led")
    edges = checked.where("like AND node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    rest = checked.groupBy("bucket").agg(F.count("*").alias("rows"), F.count_if(~F.col("like")).alias("others")).where("others > 0")
    sized = joined_by_count(checked, rest, "bucket", "rows").withColumn("__blocks", F.ceil(F.col("rows") / block).cast("int"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("__blocks")).cast("int")
    sized = sized.withColumns({"own": own, "few": F.col("others") * block <= F.col("rows")})
    # with few left over a task has a block and all of these; they are compared among themselves in the first one
    every = F.sequence(F.lit(0), F.col("__blocks") - 1)
    sized = sized.withColumn("__other", F.explode(F.when(F.col("few") & F.col("like"), F.array("own")).otherwise(every)))
    first, second = F.least("own", "__other"), F.greatest("own", "__other")
    pairs = sized.select(
        "bucket", F.when(F.col("few"), F.col("__other")).otherwise(first).alias("first"), F.when(F.col("few"), F.lit(LEFT)).otherwise(second).alias("second"),
        F.when(F.col("few") & ~F.col("like"), F.lit(LEFT)).otherwise(F.col("own")).alias("own"), "tree", "node",
    )
    return edges, pairs.join(signs, "node").select(*pairs.columns, "signature")


def spanning(key: tuple, rows: pa.Table, trees: int, depth: int, shortest: int, likely: float) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest over a subtrie's likely pairs: between its two blocks or within its one; or, where the
    second block is LEFT, of those that are left over, whose own block is that too, with all rows."""
    node, own = rows.column("node").to_numpy(), rows.column("own").to_numpy()
    tree = rows.column("tree")[0].as_py()
    signs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(len(node), trees * depth)
    labels = signs[:, tree * depth : (tree + 1) * depth]
    left_over = own == LEFT
    order = np.lexsort(labels.T[::-1])
    node, own, signs, labels, left_over = node[order], own[order], signs[order], labels[order], left_over[order]
    # with one more row than there are, for each row how much of its label it shares with the row before it
    shared = np.concatenate([[-1], np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1), [-1]])
    root = np.arange(len(node))
    if key[2] == LEFT and not left_over.all():  # the others are like their leader, and so are one group
        root[~left_over] = np.flatnonzero(~left_over)[0]
    edges = []
    for length in range(depth, shortest - 1, -1):
        cuts = np.flatnonzero(shared < length)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for i in range(a, z - 1):
                if (root[a:z] == root[a]).all():  # what has been put together is not compared again
                    break
                others = np.arange(i + 1, z)
                others = others[root[others] != root[i]]
                if key[2] == LEFT:
                    others = others[left_over[others] | left_over[i]] if key[1] == 0 else others[left_over[others] != left_over[i]]
                elif key[1] != key[2]:
                    others = others[own[others] != own[i]]
                for j in others[(signs[others] == signs[i]).mean(axis=1) >= likely].tolist() if len(others) else ():
                    if root[i] != root[j]:
                        edges.append((i, j))
                        root[root == root[j]] = root[i]
    if edges:
        e = node[np.array(edges)]
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a set and that of its group's first text don't share, and how much of the latter is missing in it."""
    for batch in by_bytes(batches, 2):
        sets, firsts = ([np.frombuffer(s, np.uint64) for s in batch.column(k).to_pylist()] for k in (2, 3))
        other = [np.setxor1d(s, f, assume_unique=True) for s, f in zip(sets, firsts, strict=True)]
        sizes, first = np.array([len(s) for s in sets]), np.array([len(f) for f in firsts])
        # of the first text's shingles f, m are missing, and of the set's s, s - (f - m) are its own; in all, d
        missing = [(len(d) + int(f) - int(s)) // 2 for d, s, f in zip(other, sizes, first, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d.tobytes() for d in other], pa.binary()), pa.array(sizes), pa.array(first), pa.array(missing, pa.int64())], ["group", "node", "other", "size", "first_size", "missing"])


def verified(key: tuple, rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of a group's texts between two blocks or within one: (a, null, links of a) and spanning edges (a, b, 0).

    Two sets share what the first text has and neither misses, and what they differ in from it alike."""
    node, own, sizes, missing = (rows.column(c).to_numpy() for c in ("node", "own", "size", "missing"))
    others = [np.frombuffer(s, np.uint64) for s in rows.column("other").to_pylist()]
    values, column = np.unique(np.concatenate(others), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1  # what one text alone has can't be shared
    place = np.cumsum(shared) - 1
    who = np.repeat(np.arange(len(node)), [len(s) for s in others])[shared[column]]
    column = place[column[shared[column]]]
    left = np.flatnonzero(own == key[1])
    right = left if key[1] == key[2] else np.flatnonzero(own == key[2])
    if not len(left) or not len(right):
        return
    both = rows.column("first_size")[0].as_py() - missing[left][:, None] - missing[right][None, :].astype(np.float64)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):  # a part of the shingles at a time, so that the matrix stays small
        inside = (column >= at) & (column < at + 4096)
        matrix = np.zeros((len(node), 4096), np.float32)
        matrix[who[inside], column[inside] - at] = 1
        both += matrix[left] @ matrix[right].T
    linked = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-6
    linked &= node[left][:, None] != node[right][None, :]
    counts = np.zeros(len(node), np.int64)
    counts[left] += linked.sum(axis=1)
    if key[1] != key[2]:
        counts[right] += linked.sum(axis=0)
    i, j = np.nonzero(linked)
    edges = Links(len(node)).join(np.stack([left[i], right[j]], axis=1))
    some = np.flatnonzero(counts)
    if len(some):
        e = np.array(edges, np.int64).reshape(-1, 2)
        a, b = np.concatenate([node[some], node[e[:, 0]]]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[e[:, 1]])])
        yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([counts[some], np.zeros(len(e), np.int64)]))], ["a", "b", "links"])


def ngram_join(docs: DataFrame, ngram: int = 5, threshold: float = 0.8, trees: int = 16, depth: int = 8, recall: float = 0.999, likely: float | None = None, block: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id (the least id with this text) and n_links (different texts that this one is linked to)."""
    likely = threshold - 0.15 if likely is None else likely
    forest = Forest(trees, depth)
    length = forest.shortest(threshold, recall, likely)
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            out: list[list] = [[], [], [], []]
            for t in batch.column(1).to_pylist():
                s = shingles(t, ngram)
                out[0].append(xxh3_128_digest((t or "").encode("utf-8", "replace")))
                out[1].append(len(s))
                signature = forest.signature(s) if len(s) else None
                out[2].append(None if signature is None else signature.astype(np.uint16).tobytes())
                out[3].append(None if signature is None else forest.buckets(signature, length).tolist())
            types = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["node", "digest", "size", "signature", "buckets"])

    signed = written(rows.mapInArrow(sign, "node long, digest binary, size long, signature binary, buckets array<long>"), "signed")
    usable = signed.where("size > 0 AND node IS NOT NULL")
    texts = written(usable.groupBy("digest").agg(F.min("node").alias("node"), F.min_by(F.struct("signature", "buckets"), "node").alias("s"), F.count("*").alias("copies")).select("digest", "node", "copies", "s.*"), "texts")

    placed = texts.select("node", F.posexplode("buckets").alias("tree", "bucket"))
    near, left = led(placed, texts, trees * texts.count(), block, likely)
    edges = near.unionByName(compared(left, "bucket", lambda k, g: spanning(k, g, trees, depth, length, likely), "a long, b long"))
    groups = connected_components(edges)

    # rows with a text of some group; of copies, the one that stands for them
    wanted = written(texts.select("node").distinct().join(groups, "node").select("node", F.col("root").alias("group")), "groups")
    discard(groups)
    counted = wanted.groupBy("group").agg(F.count("*").alias("rows"))
    parts = joined_by_count(wanted, counted, "group", "rows").withColumn("parts", F.ceil(F.col("rows") / block)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4):
            sets = [shingles(t, ngram).tobytes() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], ["group", "node", "parts", "part", "shingles"])

    own = rows.join(parts, "node").dropDuplicates(["node", "text"]).select("group", "node", "parts", "part", "text")
    sets = written(own.mapInArrow(shingled, "group long, node long, parts long, part long, shingles binary"), "shingles")
    # the first text's set goes once to each part of its group, so that a large group is no single task's
    firsts = sets.where("node = group").groupBy("group", "parts").agg(F.min("shingles").alias("first")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    apart = sets.join(firsts, ["group", "part"]).select("group", "node", "shingles", "first").mapInArrow(differences, "group long, node long, other binary, size long, first_size long, missing long")
    apart = written(apart, "differences")
    discard(sets, wanted)
    # a large group makes a few pairs of blocks for each task, so that tasks are even
    spread = math.ceil(math.sqrt(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    weights = apart.groupBy("group").agg(F.count("*").alias("rows"), F.sum(F.length("other")).alias("bytes")).where("rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / 1024), F.ceil(F.col("bytes") / BLOCK_BYTES), F.least(F.ceil(F.col("rows") / 32), F.lit(spread)), F.lit(1))
    pairs = in_blocks(apart, "group", "node", blocks, weights)
    checked = written(compared(pairs, "group", lambda k, g: verified(k, g, threshold), "a long, b long, links long"), "verified")
    discard(apart)
    classes = connected_components(checked.where("b IS NOT NULL").select("a", "b"))
    counts = checked.where("b IS NULL").groupBy(F.col("a").alias("copy_id")).agg(F.sum("links").alias("n_links"))

    # of each text, and then of each row by its text; a text of very many copies is split off
    known = counts.join(classes.select(F.col("node").alias("copy_id"), F.col("root").alias("class_id")), "copy_id", "full")
    table = texts.select("digest", F.col("node").alias("copy_id"), "copies").join(known, "copy_id", "left").select("digest", "copies", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    members = joined_by_count(usable.select("node", "digest"), table, "digest", "copies").select("node", "class_id", "copy_id", "n_links")
    alone = signed.where("size = 0 OR node IS NULL").select("node", F.col("node").alias("class_id"), F.col("node").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    out = members.unionByName(alone)
    return out.select(F.col("node").cast(docs.schema[doc_id].dataType).alias("doc_id"), "class_id", "copy_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that no other of their class precedes, with all their columns."""
    joined = ngram_join(docs, doc_id=doc_id, **options)
    later = joined.where(F.col("class_id") != F.col("doc_id").cast("long")).select(F.col("doc_id").alias("__later")).distinct()
    return docs.join(later, docs[doc_id] == F.col("__later"), "left_anti")
