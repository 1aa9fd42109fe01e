"""Operators on embeddings against brute force, and their defined results for odd inputs."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm.hard_negatives import Keyed, augmented, distances, hard_negatives, pivots_of
from ferrule.llm.oracle import oracle_sql
from ferrule.llm.queries import queries
from ferrule.llm.vector_codes import nearest, vector_codes
from ferrule.llm.vector_graph import Shard, nearest_neighbours

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, id string, score int, rank int, shard string, v int"


def table(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, k, "x", 1, 2, "y", 3) for i, v, k in rows], SCHEMA)


def odd_rows(d=16):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=d).tolist(), int(rng.integers(3))) for i in range(120)]
    rows += [rows[20], rows[20], (200, rows[20][1], 1), (201, rows[20][1], 0)]  # repeated rows, and equal vectors
    rows += [(None, rng.normal(size=d).tolist(), 1), (300, None, 1), (320, [], 1), (340, [NAN] * d, 0), (360, [None] + [1.0] * (d - 1), 1), (380, [INF] + [0.0] * (d - 1), 2)]
    rows += [(400, [0.0] * d, 1), (420, [1.0] * (d - 3), 1), (440, rng.normal(size=d).tolist(), None), (-20, rng.normal(size=d).tolist(), 2)]
    return rows


def kept(rows, d=16):
    return [(i, v, k) for i, v, k in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def neighbours(rows, every, k):
    """Brute force: of rows that share an id, the best score."""
    good = [(i, np.array(v)) for i, v, _ in kept(rows) if i is not None and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            best = {}
            for j, v in good:
                if j != i:
                    best[j] = max(best.get(j, -INF), float(q @ v))
            out[i] = sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def test_neighbours_of_odd_rows(spark):
    got = nearest_neighbours(table(spark, odd_rows()), lambda i: i % 20 == 0, k=20, shard_rows=50).collect()
    want = neighbours(odd_rows(), 20, 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    for i, rows in want.items():
        assert [j for j, _ in found[i]] == [j for j, _ in rows]
        assert np.allclose([s for _, s in found[i]], [s for _, s in rows], atol=1e-12)


def test_neighbours_of_few_and_no_rows(spark):
    few = [(20 * k, [float(k == j) + 0.1 for j in range(4)], 0) for k in range(4)]
    assert nearest_neighbours(table(spark, few), lambda i: i % 20 == 0).count() == 12
    assert nearest_neighbours(table(spark, few[:1]), lambda i: i % 20 == 0).count() == 0
    empty = nearest_neighbours(table(spark, []), lambda i: i % 20 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_recall_of_the_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = queries()["op11_nearest_neighbours"](spark, sf).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = np.where(ids == ids[k], -INF, x @ x[k])
        hits += len(found[ids[k]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.99 * 20 * (ids % 20 == 0).sum()


@pytest.mark.parametrize("kind", ["even", "copies", "lengths"])
def test_recall_of_a_shard(kind):
    """Rows that lie evenly, a third of rows near one vector, and vectors of very different lengths."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    if kind == "copies":
        x[:1400] = x[0] + 0.01 * rng.normal(size=(1400, 32))
        x[1400:1700] = x[0]
    if kind == "lengths":
        x *= rng.lognormal(0, 1, size=(4000, 1))
    ids, shard = np.arange(4000), Shard.made(np.arange(4000), x)
    assert sorted(i for b in shard.bands for i in b.ids.tolist()) == ids.tolist()  # every row is indexed
    asked = ids[::40]
    i, other, score = shard.best(asked, x[asked], 20, 192)
    hits = 0
    for k, q in enumerate(asked):
        exact = np.where(ids == q, -INF, x @ x[q])
        assert np.allclose(score[i == k], exact[other[i == k]])
        hits += min(20, (score[i == k] >= np.sort(exact)[-20] - 1e-9).sum())
    assert hits >= 0.95 * 20 * len(asked)


def brute_negatives(rows, every, positives=5, negatives=3):
    good = sorted({(i, k, tuple(math.floor(256 * x) for x in v)) for i, v, k in kept(rows) if i is not None and k is not None})
    out = []
    for i, k, a in good:
        if i % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, m) for j, m, v in good if j != i)
        for s, p, _ in [x for x in scores if x[2] == k][:positives]:
            fit = [(n, j) for n, j, m in scores if m != k and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(i, p, r + 1, j, -s, -n) for r, (n, j) in enumerate(fit[:negatives])]
    return sorted(out)


def test_negatives_of_odd_rows(spark):
    got = hard_negatives(table(spark, odd_rows()), lambda i: i % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(odd_rows(), 20)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert hard_negatives(table(spark, []), lambda i: i % 20 == 0).count() == 0
    assert hard_negatives(table(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1)]), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("dims", [2, 24])
def test_intervals_end_early_and_lose_nothing(dims):
    """Clusters: an anchor's search reads a part of the chunks, and finds what reading all of them finds."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, dims)) * 2000
    x = np.floor(centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, dims)) * 20)
    most = float((x * x).sum(axis=1).max())
    long = augmented(x, most)
    pivots = pivots_of(long[:2000], 32)
    far = distances(long, pivots)
    pivot, key = far.argmin(axis=1), far.min(axis=1)
    order = np.lexsort((key, pivot))
    chunks = []
    for p in range(len(pivots)):
        own = order[pivot[order] == p]
        for at in range(0, len(own), 64):
            c = own[at : at + 64]
            chunks.append([c, c % 5, x[c], np.array([p]), np.array([key[c[0]], key[c[-1]]])])
    shard, ids = Keyed(chunks, pivots, most), np.arange(0, 6000, 100)
    low, high = np.full((len(ids), 1), -INF), np.full((len(ids), 1), INF)
    at, _, other, score = shard.best(ids, ids % 5, x[ids], True, low, high, 5)
    for k, i in enumerate(ids):
        exact = x @ x[i]
        fit = np.flatnonzero((np.arange(6000) % 5 == i % 5) & (np.arange(6000) != i))
        fit = fit[np.lexsort((fit, -exact[fit]))[:5]]
        assert sorted(other[at == k].tolist()) == sorted(fit.tolist()) and sorted(score[at == k]) == sorted(exact[fit])
    if dims == 2:
        assert shard.scanned < 0.5 * len(ids) * len(chunks)


def brute_codes(rows, parts, entries, rounds):
    good = sorted(((i, tuple(v), k, [math.floor(256 * x) for x in v]) for i, v, k in kept(rows)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][3]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[list(cut(r[3])[p]) for r in good[:entries]] for p in range(parts)]
    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in good:
                own.setdefault(near(cut(r[3])[p], books[p])[0], []).append(cut(r[3])[p])
            books[p] = [[sum(c) // len(c) for c in zip(*own[e], strict=True)] if e in own else book for e, book in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(r[0], r[2], [near(part, books[p]) for p, part in enumerate(cut(r[3]))]) for r in good]
    total = {}
    for _, k, found in coded:
        total[k] = total.get(k, 0) + sum(f for _, f in found)
    return sorted((repr(i), "".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found), total[k], sha) for i, k, found in coded)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(16, 64, 2), (4, 5, 3), (2, 200, 1)])
def test_codes_of_odd_rows(spark, parts, entries, rounds):
    got = vector_codes(table(spark, odd_rows()), parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == brute_codes(odd_rows(), parts, entries, rounds)


def test_codes_of_nothing_and_errors(spark):
    assert vector_codes(table(spark, [])).count() == 0
    assert vector_codes(table(spark, [(1, None, 1), (2, [NAN] * 16, 2)])).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(table(spark, [(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(ValueError, match="not less than"):
        vector_codes(table(spark, [(1, [1e9] * 16, 1)]))


def test_nearest_takes_the_first_of_equal_entries():
    index, far = nearest(np.array([[0, 5], [0, 5]]), np.array([[1, 0], [0, 1], [5, 5]]))
    assert index.tolist() == [0, 2] and far.tolist() == [1, 0]


def test_parts_of_a_query_agree_with_sql_on_one_table(spark, sf):
    """Codes and hard negatives, on a table of which a third is near one vector and some labels are null."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    near = F.transform("embedding", lambda x: F.floor(x * 4) / 4)
    path = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/vectors"
    rows.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, near).otherwise(F.col("embedding"))).withColumn("label", F.expr("nullif(label, 4)")).write.mode("overwrite").parquet(path + "/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet/*.parquet')")
    for name in ("op12_hard_negatives", "op13_vector_codes"):
        df = queries()[name](spark, path)
        sql = duck.sql(oracle_sql()[name])
        assert df.columns == sql.columns
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, sql.fetchall()))
