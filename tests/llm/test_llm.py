"""Each operator against a brute-force version, SQL, or a round trip; and its defined results for odd inputs."""

import collections
import datetime
import gzip
import hashlib
import random
import re
import zlib
from base64 import b32encode

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferrule.llm import chat, common, components, decontam, licenses, ngram_join, packing, pii, queries, tokens, warc
from ferrule.llm import line_dedup as lines
from ferrule.llm.common import by_bytes
from ferrule.llm.line_dedup import line_dedup
from ferrule.llm.oracle import oracle_sql
from ferrule.llm.quality import QualityRules, quality_filter, quality_rules

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (None, "no id here at all"), (6, "ünï ḉödé 漢字 🙂 é"), (7, "a<|endoftext|>b")]


def documents(spark, rows=ODD):
    """With null languages and extra columns whose names clash with the operators' own."""
    data = [(i, t, None, "s", 0 if t is None else len(t), "x", 9) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, node string, row int")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf, duck, name):
    df, sql = queries.queries()[name](spark, sf), duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    order = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert got == sorted(repr([r[i] for i in order]) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == (1 if name.startswith("op7") else 0)


# -- 1 lines --
def brute_lines(rows, least):
    """All runs of lines against all earlier places, by definition."""
    order = sorted(rows)
    lines = {i: t.split("\n") for i, t in order}
    seen, gone = {}, collections.defaultdict(set)
    for i, _ in order:
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines[i]]
        for a in range(len(n)):
            for z in range(a, len(n)):
                if n[a] and n[z] and sum(n[a : z + 1]) >= least:
                    run = tuple(lines[i][a : z + 1])
                    if run in seen and seen[run] < (i, a):
                        gone[i].update(range(a, z + 1))
                    seen.setdefault(run, (i, a))
    return {i: "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i, _ in order}


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["", " ", "a b c", "d e", "f", "g h i j", "k l m n o", "p q"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6).collect()}
    assert got == brute_lines(rows, 6)


def test_lines_whose_hashes_collide_stay(spark, monkeypatch):
    """With 3 values for the first hash of a line or text nearly all of them collide; the second one tells them apart."""
    rows = [(i, "\n".join(f"a{i} b{i} c{k} d{i * k}" for k in range(12))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + "\nend") for i in range(5)]
    before = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6).collect()}
    monkeypatch.setattr(lines, "first_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(3)))
    after = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6).collect()}
    assert before == after and all(after[i] == t for i, t in rows if i < 100) and all(after[100 + i] == "end" for i in range(5))


def test_lines_are_matched_by_fingerprints(spark, monkeypatch):
    """Fewer fingerprints than windows are stored, and nothing is deleted without them."""
    rng = random.Random(4)
    shared = [" ".join(f"s{k}w{i}" for i in range(9)) for k in range(12)]
    rows = [(i, "\n".join([*(f"own {i} {j} {rng.random()}" for j in range(20)), *shared, *(f"more {i} {j} {rng.random()}" for j in range(20))])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lined = lines.line_table(docs, 30, "doc_id", "text")
    marks = lines.fingerprints(lined)
    assert marks.count() < lined.selectExpr("sum(size(windows)) AS n").first().n / 2
    assert marks.count() > lines.matched(marks).count() >= 12
    assert {r.doc_id: r.n_removed for r in line_dedup(docs, min_words=30).collect()} == {i: 12 if i else 0 for i, _ in rows}
    all_of_them = lines.fingerprints
    monkeypatch.setattr(lines, "fingerprints", lambda lined: all_of_them(lined).where("mark IS NULL"))
    assert {r.n_removed for r in line_dedup(docs, min_words=30).collect()} == {0}


def test_a_line_of_all_documents_is_split_off(spark, monkeypatch):
    """The same rows, whether keys are shuffled or split off."""
    rows = [(i, f"every document has these five words\nown words of {i % 7} here") for i in range(40)]
    want = brute_lines(rows, 6)
    for shares in (512, 2):
        monkeypatch.setattr(common, "SHARES", shares)
        assert {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6).collect()} == want


def test_lines_odd(spark):
    rows = {(r.doc_id, r.text): r for r in line_dedup(documents(spark)).collect()}
    assert rows[1, None].n_removed == 0 and rows[4, "one"].n_removed == 0 and rows[5, LONG].n_lines == 1
    twice = line_dedup(spark.createDataFrame([(2, LONG), (3, LONG), (3, LONG), (None, LONG)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, 0), (2, 1), (3, 1), (3, 1)]


# -- 2 WARC --
def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nü"), (None, "n", "same"), (6, "big", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived(pages, archive_bytes=100_000).collect()}
    for page, _, html in rows:
        body = (html or "").encode()
        assert got[page].payload_bytes == len(body) and got[page].payload_digest == b32encode(hashlib.sha1(body).digest()).decode()
    assert (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[2].record_type == "response" and got[None].refers_to == 2
    assert (got[3].record_type, got[3].refers_to) == ("revisit", 4) and got[5].html == rows[4][2]
    assert {r.record_type for r in warc.archived(pages, min_bytes=10).collect()} == {"response"}


def test_warc_members(spark, tmp_path):
    """Each record can be read from its own begin; revisits name the record that they refer to; a warcinfo comes first."""
    rows = [(k, f"http://h/{k}", "x" * 10 * k if k % 3 else "same") for k in range(60)] + [(99, "http://big", "é" * 9000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", archive_bytes=20_000, date="2024-01-02T03:04:05Z")
    found, targets = {}, {}
    for path in sorted((tmp_path / "w").glob("part-*")):
        data = path.read_bytes()
        every = list(warc.records(data))
        if not every:
            continue
        assert every[0][0]["WARC-Type"] == "warcinfo" and all(h["WARC-Date"] == "2024-01-02T03:04:05Z" for h, _ in every)
        starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", data)]
        alone = [next(warc.records(data[a:]))[0]["WARC-Record-ID"] for a in starts if zlib.decompressobj(31).decompress(data[a : a + 200])[:5] == b"WARC/"]
        assert alone == [h["WARC-Record-ID"] for h, _ in every]
        found |= {h["WARC-Record-ID"]: h for h, _ in every}
        targets |= {h["WARC-Record-ID"]: h["WARC-Refers-To"] for h, _ in every if h["WARC-Type"] == "revisit"}
    assert len(targets) == 19 and {found[t]["X-Page-ID"] for t in targets.values()} == {"57"} and all(found[t]["WARC-Type"] == "response" for t in targets.values())
    assert {(r.page_id, r.html) for r in warc.read_archives(spark, f"file://{tmp_path}/w").where("record_type = 'response'").collect()} == {(k, h) for k, _, h in rows if k % 3 or k in (57, 99)}


def test_archives_are_read_in_ranges(spark, tmp_path):
    """One archive by many tasks, each of which has whole records; gzip and the parser read it as one file too."""
    rng = random.Random(4)
    rows = [(k, f"http://h/{k}", "".join(chr(rng.randrange(32, 1200)) for _ in range(rng.randrange(4000)))) for k in range(300)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    paths = [p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size]
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in paths)
    assert whole.count(b"WARC-Record-ID") == 300 + len(paths) and sum(len(list(warc.records(p.read_bytes()))) for p in paths) == 300 + len(paths)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = warc.read_archives(spark, f"file://{tmp_path}/w")
        got = read.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.task for r in got}) > 5 * len(paths)
    assert sorted((r.page_id, r.url, r.html) for r in got) == sorted(rows)


@pytest.mark.parametrize("often", [100, 1000])
def test_each_record_has_an_id_of_its_own(spark, tmp_path, monkeypatch, often):
    """Rows that agree in page_id and payload, a third of all among them; what revisits refer to is there."""
    monkeypatch.setattr(warc, "OFTEN", often)
    rows = [(7, "u", "same")] * 700 + [(k, "u", "same" if k < 6 else "x" * (k % 50)) for k in range(1400)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    headers = [h for p in sorted((tmp_path / "w").glob("part-*")) for h, _ in warc.records(p.read_bytes()) if h["WARC-Type"] != "warcinfo"]
    ids = [h["WARC-Record-ID"] for h in headers]
    assert len(ids) == len(set(ids)) == len(rows)
    for h in headers:
        assert h.get("WARC-Refers-To", ids[0]) in ids
        assert ("X-Refers-To-Page-ID" in h) == (h["WARC-Type"] == "revisit")
    assert sum(h["WARC-Type"] == "response" and h["X-Page-ID"] == "7" for h in headers) == 700


def test_warc_odd(spark):
    """Repeated rows, clashing names, and a payload that a third of the rows have."""
    rows = [(k, "u", "hot" if k % 3 == 0 else f"p{k}", "d", "i", 1) for k in range(30)] + [(1, "u", "p1", "d", "i", 1), (1, "u", "other", "d", "i", 1)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key string, bytes int")).collect()
    assert len(got) == 32 and sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    assert {r.refers_to for r in got if r.page_id % 3 == 0} == {27, None} and sum(r.record_type == "revisit" for r in got) == 9


# -- 3 near duplicates --
def brute_links(rows, n=5, s=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "replace").split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b])}


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(6)]
    rows = [(k, " ".join(edited(rng, base[k % 6], rng.randrange(4)))) for k in range(90)] + [(200 + k, " ".join(f"u{rng.randrange(900)}" for _ in range(80))) for k in range(20)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, None), (303, ""), (304, "")]
    got = {r.doc_id: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    first: dict = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    distinct = [(i, t) for t, i in first.items() if t]
    links = brute_links(distinct)
    degree = collections.Counter(x for pair in links for x in pair)
    root = {i: i for i, _ in distinct}
    for a, b in sorted(links):
        ra, rb = root[a], root[b]
        root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    for i, t in rows:
        want = (i, i, 0) if not t else (root[first[t]], first[t], degree[first[t]])
        assert (got[i].class_id, got[i].copy_id, got[i].n_links) == want
    assert len(links) > 50


def test_links_odd(spark):
    got = ngram_join.ngram_join(documents(spark)).collect()
    assert len(got) == len(ODD) and {r.n_links for r in got} == {0}
    assert ngram_join.one_of_each(documents(spark)).count() == len(ODD)


def test_prefix_shortens_until_recall():
    f = ngram_join.Forest(16, 8)
    assert f.shortest(0.8, 0.999, 0.65) == 4 and f.shortest(0.95, 0.99, 0.8) == 8 and f.shortest(0.1, 0.999, 0.0) == 1
    assert 0.999 < f.recall(0.8, 4, 0.65) < f.recall(0.8, 4, 0.0) < 1


def test_recall_just_above_the_threshold(spark):
    """Pairs of texts of their own, with a similarity from 0.8 to 0.83."""
    rng = random.Random(11)
    rows, near = [], []
    while len(near) < 150:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 300))]
        other = edited(rng, words, max(1, len(words) // 50))
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
        if 0.8 <= len(a & b) / len(a | b) < 0.83:
            near.append(len(rows))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k + 1] == k for k in near) >= 0.99 * len(near)
    assert all(got[k] == k for k in near)


def test_subtrie_compares_what_is_not_put_together(monkeypatch):
    """Texts that share a whole label are put together there, and of each such node one text is compared further on."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 60_000, (3, 16), dtype=np.uint16)
    base[1:, :6] = base[0, :6]  # three nodes of one subtrie: they share 6 of 8 values of the first tree
    signs = np.repeat(base, 50, axis=0)
    signs[:, 8:] = base[0, 8:]  # and enough of the rest
    rows = pa.table({"node": np.arange(150), "own": np.zeros(150, np.int64), "tree": np.zeros(150, np.int64), "signature": [x.tobytes() for x in signs]})
    edges = [e for b in ngram_join.spanning((0, 0, 0), rows, 2, 8, 4, 0.65) for e in zip(*(c.to_pylist() for c in b.columns))]
    assert len(edges) == 149 and len({x for e in edges for x in e}) == 150
    assert [e for b in ngram_join.spanning((0, 0, 0), rows, 2, 8, 7, 0.65) for e in b.column(0).to_pylist()].__len__() == 147
    assert not list(ngram_join.spanning((0, 0, 1), rows, 2, 8, 4, 0.65))  # one block alone has no pair between two


def test_large_groups_in_blocks(spark, monkeypatch):
    """Links of one group, counted in many pairs of blocks, with rows that share an id."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 200)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(1, 3)))) for k in range(70)]
    got = {r.doc_id: r for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    degree = collections.Counter(x for pair in brute_links(rows) for x in pair)
    assert {k: r.n_links for k, r in got.items()} == {k: degree[k] for k, _ in rows} and sum(degree.values()) > 1000


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        ra, rb = root[a], root[b]
        root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


# -- 4 packing, 9 counts --
def check_sequences(df, capacity=2048):
    df = df.sort_values(["sequence_id", "offset"])
    assert ((df.groupby("sequence_id").length.cumsum() - df.length) == df.offset).all() and df.groupby("sequence_id").length.sum().max() <= capacity
    return df.sequence_id.nunique(), -(-df.length.sum() // capacity)


def test_pieces_and_sequences(spark, sf, texts, monkeypatch):
    library = Tokenizer.from_file(BYTE)
    for fan_in, tasks, chunk, block, loss in ((2, 8, 40, 4, 0.03), (8, 8, packing.CHUNK, packing.BLOCK, 0.01)):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        monkeypatch.setattr(packing, "BLOCK", block)
        df = packing.best_fit_packing(spark.read.parquet(f"{sf}/documents.parquet").repartition(tasks), BYTE, fan_in=fan_in).toPandas()
        for doc, own in df.groupby("doc_id"):
            ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
            own = own.sort_values("piece")
            assert list(own.start) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
            assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == list(own.ids_crc32)
        assert set(df.doc_id) == set(texts)
        made, bound = check_sequences(df)
        assert made <= (1 + loss) * bound + 1


def test_sequences_are_few(spark, sf):
    df = packing.best_fit_packing(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").repartition(4), BYTE).toPandas()
    made, bound = check_sequences(df)
    assert made <= 1.01 * bound


def test_packing_odd(spark):
    got = packing.best_fit_packing(documents(spark), BYTE).collect()
    assert sorted(r.length for r in got if r.doc_id in (1, 2)) == [1, 1] and sum(r.doc_id == 4 for r in got) == 2


def test_packing_of_sources_with_lengths_of_their_own(spark):
    """Half the partitions hold texts of some 60 tokens, the others of some 40: one of each fills a sequence of 100."""
    n = 400
    texts = spark.range(0, 2 * n, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é\n"), F.when(F.col("id") < n, 29).otherwise(19)).alias("text"))
    got = packing.best_fit_packing(texts, BYTE, capacity=100).collect()
    lengths = {r.doc_id >= n: r.length for r in got}
    assert len(got) == 2 * n and lengths[False] > 50 > lengths[True] > 33 and sum(lengths.values()) <= 100
    assert len({r.sequence_id for r in got}) < 1.1 * n  # three halves of n where each source is packed by itself


def test_packing_joins_all_underfull_bins(spark, monkeypatch):
    """Chunks of one piece: each bin climbs, and only the tree puts them together."""
    monkeypatch.setattr(packing, "CHUNK", 1)
    texts = spark.range(0, 600, 1, 8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é\n"), (F.col("id") % 3 + 9).cast("int")).alias("text"))
    df = packing.best_fit_packing(texts, BYTE, capacity=100, fan_in=2).toPandas()
    made, _ = check_sequences(df, 100)
    assert len(df) == 600 and made <= 1.05 * len(one_by_one(df.length.tolist(), 100))


def one_by_one(sizes, capacity):
    """The fills of a best fit, the largest items first."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 100), st.integers(1, 12)), max_size=80))
def test_best_fit(sizes):
    bins, offsets = packing.best_fit(np.array(sizes, np.int64), 100)
    fill = collections.Counter()
    for b, o, s in sorted(zip(bins.tolist(), offsets.tolist(), sizes)):
        assert o == fill[b]
        fill[b] += s
    assert sorted(100 - f for f in fill.values()) == one_by_one(sizes, 100)
    ranges = packing.fit(np.bincount(np.array(sizes, np.int64), minlength=1), 100)[1]
    assert [f for first, n, f in ranges for _ in range(n)] == [fill[b] for b in range(len(fill))]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def counts_of(texts):
    values, sizes = tokens.own(WORD, tokens.Counts).prefixes(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])]


def every_prefix(library, text):
    return [len(e) for e in library.encode_batch([text[:k] for k in range(1, len(text) + 1)], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aàeéñ sT'd19 \n\t.,!-_—漢ß²\xa0<|>endoftextİẹ́rvl")), max_size=40))
def test_tokens_are_the_librarys(libraries, text):
    ids, words = libraries
    assert tokens.own(BYTE, tokens.Ids).of(text) == ids.encode(text, add_special_tokens=False).ids
    assert counts_of([text]) == [every_prefix(words, text)]


@pytest.mark.parametrize("text", ["a <|endoftext|>b<|startoftext|>", "x!<|endoftext|>'re don't we've I'LL", "<|ENDOFTEXT|> <|end", " 'r 're\n\n'", "é" * 60 + "!", "-=" * 40, "漢字仮名" * 20, "é" * 70, "thonre" * 12 + " " + "thonre" * 12])
def test_hard_texts(libraries, text):
    assert tokens.own(BYTE, tokens.Ids).of(text) == libraries[0].encode(text, add_special_tokens=False).ids
    assert counts_of([text, "", text]) == [every_prefix(libraries[1], text), [], every_prefix(libraries[1], text)]


def test_prefixes_of_documents(libraries, texts):
    """All prefixes of short documents and of the begins of others, and some prefixes of all."""
    rng = random.Random(4)
    whole = [t or "" for t in texts.values()]
    for text, got in zip(whole, counts_of(whole), strict=True):
        assert len(got) == len(text) and got[:200] == every_prefix(libraries[1], text[:200])
        some = [rng.randrange(1, len(text) + 1) for _ in range(5)] + [len(text)] if text else []
        assert [got[k - 1] for k in some] == [len(libraries[1].encode(text[:k], add_special_tokens=False)) for k in some]


def test_a_word_of_ten_thousand_characters(libraries):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghiknorst") for _ in range(10_000))
    got = counts_of([text])[0]
    for k in (1, 47, 48, 49, 50, 1000, 5555, 9999, 10_000):
        assert got[k - 1] == len(libraries[1].encode(text[:k], add_special_tokens=False))


def test_all_code_points(libraries):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ids = tokens.own(BYTE, tokens.Ids)
    assert ids.encoding is not None
    for at in range(0, len(points), 20_000):
        text = "".join(f"a{c}1 {c}{c}b\n" for c in points[at : at + 20_000])
        assert ids.of(text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_library(tmp_path):
    """Without the merge that makes a token whole, merging by rank would differ."""
    import json

    with open(BYTE, encoding="utf-8") as f:
        whole = json.load(f)
    whole["model"]["merges"][1000], whole["model"]["merges"][40_000] = whole["model"]["merges"][40_000], whole["model"]["merges"][1000]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(whole))
    ids = tokens.Ids(str(path))
    assert ids.encoding is None and ids.of("the cat") == Tokenizer.from_file(str(path)).encode("the cat").ids


def test_marks_after_contractions(libraries):
    """20,000 units with marks after contractions, at every prefix: a prefix may have a contraction that the whole has not."""
    rng = random.Random(21)
    marks = ["\u0301", "\u0308", "\u0327", "\u0323", "\u030c", "\u0338", "\u200d"]
    ends = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'LL", "'", "''", "!'", "\u2019s"]
    texts = []
    for _ in range(20_000):
        words = []
        for _ in range(rng.randrange(1, 3)):
            w = rng.choice(["it", "o", "don", "e\u0301", "", "5", "\u1100\u1161", "\u0130"]) + rng.choice(ends)
            at = rng.randrange(len(w) + 1)
            words.append(w[:at] + rng.choice(marks) + w[at:] + rng.choice(["", rng.choice(marks), "x", "s", "-", "e" + rng.choice(marks)]))
        texts.append(rng.choice(["", " "]).join(words))
    for part in range(0, len(texts), 500):
        some = texts[part : part + 500]
        got = counts_of(some)
        begins = [t[: k + 1] for t in some for k in range(len(t))]
        flat = iter([len(e) for e in libraries[1].encode_batch(begins, add_special_tokens=False)])
        for text, own in zip(some, got, strict=True):
            assert own == [next(flat) for _ in text], text


def test_prefix_table_answers(spark):
    df = tokens.prefix_counts(documents(spark), WORD)
    rows = {r.doc_id: r for r in df.collect()}
    assert (rows[1].n_tokens, rows[2].n_bytes, rows[5].n_tokens) == (0, 0, len(Tokenizer.from_file(WORD).encode(LONG, add_special_tokens=False).ids))
    assert rows[1].prefix_tokens == [] and len(rows[5].prefix_tokens) == len(LONG) and len(rows[6].prefix_tokens) == len(ODD[7][1])
    text = "the cat internationalization of tokenizers"
    library = Tokenizer.from_file(WORD)
    want = every_prefix(library, text)
    one = tokens.prefix_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), WORD)
    got = one.select(*(tokens.longest_prefix(n).alias(f"b{n}") for n in range(9)), *(tokens.tokens_before(k).alias(f"p{k}") for k in (0, 1, 10, len(text), 99))).first()
    assert [got[f"b{n}"] for n in range(9)] == [max([k for k, c in enumerate(want, 1) if c <= n], default=0) for n in range(9)]
    assert [got[f"p{k}"] for k in (0, 1, 10, len(text), 99)] == [0, want[0], want[9], want[-1], want[-1]]


def test_memory_of_units_forgets(monkeypatch, libraries):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counts = tokens.Counts(WORD)
    for k in range(30):
        text = f" alpha{k % 7} beta gamma{k % 3}"
        values, _ = counts.prefixes(pa.array([text]))
        assert values.tolist() == every_prefix(libraries[1], text)


def test_batches_go_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 3, None, "", "b" * 50, "c", "d" * 9])], ["i", "t"])
    cut = list(by_bytes(iter([batch, batch.slice(0, 0)]), 1, 10))
    assert [b.column(0).to_pylist() for b in cut] == [[0, 1, 2], [3], [4, 5]]


# -- 5 licenses --
def license_body(name):
    return max((x.text for x in licenses.TEMPLATES if x.license_id == name), key=len)


def test_licenses(spark):
    noise = " ".join(f"n{k}" for k in range(90))
    mit = license_body("MIT")
    rows = [(1, f"{noise} Released under the MIT license {noise}"), (2, f"{noise} {mit} {noise}"), (3, noise), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "licensed under the GNU General Public License, version 2."), *[(10 + i if i else None, t) for i, t in ODD]]
    got = {(r.doc_id, r.license_id) for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (4, "GPL-3.0"), (5, "GPL-2.0")}


NOTICES = {
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
}


@pytest.mark.parametrize("name", sorted({x.license_id for x in licenses.TEMPLATES if "|" not in x.license_id}))
def test_each_license_is_named_rightly(spark, name):
    noise = " ".join(f"n{k}" for k in range(60))
    rows = [(1, f"{noise} {license_body(name)} {noise}"), (2, f"{NOTICES.get(name, license_body(name))} {noise}".upper())]
    got = [(r.doc_id, r.license_id) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(1, name), (2, name)]


def test_shared_notices_name_all_they_can_mean(spark):
    """What tells the licenses apart is missing or changed: the set, or nothing, but never one of them."""
    gpl = NOTICES["GPL-3.0-or-later"]
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows = [(1, bsd), (2, gpl.replace("version 3", "version 7")), (3, NOTICES["AGPL-3.0-or-later"].replace("version 3", "version three")), (4, "licensed under the GNU General Public License, version 9."), (5, gpl.replace("General", "Special"))]
    got = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "BSD-2-Clause|BSD-3-Clause|BSD-4-Clause", 2: "GPL-2.0|GPL-2.0-or-later|GPL-3.0|GPL-3.0-or-later", 3: "AGPL-3.0|AGPL-3.0-or-later"}


def test_neighbouring_licenses_both_stay(spark):
    both = f"{license_body('MIT')} {license_body('ISC')} {license_body('BSD-3-Clause')} {license_body('BSD-2-Clause')}"
    got = sorted(r.license_id for r in licenses.license_scan(spark.createDataFrame([(1, both)], "doc_id long, text string")).collect())
    assert got == ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT"]
    thrice = " ".join(["Released under the MIT License."] * 3)
    assert licenses.license_scan(spark.createDataFrame([(1, thrice)], "doc_id long, text string")).count() == 3


def test_ties_between_templates(spark):
    text = " ".join(f"w{k}" for k in range(20))
    got = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), [("B", text), ("A", text), ("A", text)]).collect()
    assert [r.license_id for r in got] == ["B"]  # of equal ones the first template's
    with pytest.raises(ValueError, match="templates of more than"):
        licenses.Templates([("L", "w " * (licenses.MOST_WORDS + 1))], 0.8)


def test_licenses_against_brute_force(spark, sf, texts):
    """Notices that stand whole in a text are found there, or a license that has the same words and says more."""
    got = {(r.doc_id, r.license_id) for r in licenses.license_scan(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    have = {i: set(licenses.shingle_sequence(licenses.words_of(t or "")).tolist()) for i, t in texts.items()}
    for x in licenses.TEMPLATES:
        own = set(licenses.shingle_sequence(licenses.words_of(x.text)).tolist())
        for i, there in have.items():
            if own <= there and "|" not in x.license_id:
                assert any(d == i and name == x.license_id for d, name in got)
    for i, name in got:  # and no license is named without 0.8 of some template of it
        assert any(len(own & have[i]) >= 0.8 * len(own) for x in licenses.TEMPLATES if x.license_id == name for own in [set(licenses.shingle_sequence(licenses.words_of(x.text)).tolist())])
    assert got


def test_licenses_both_ways(spark):
    """Templates with words changed, of containments around 0.8: what is found has the containment that is said, and all
    that has 0.8 or more, and the words that it must have, is found."""
    rng = random.Random(12)
    library = [x for x in licenses.TEMPLATES if len(licenses.words_of(x.text)) > 40 and "|" not in x.license_id]
    sets = [(x.license_id, set(licenses.shingle_sequence(licenses.words_of(x.text)).tolist())) for x in licenses.TEMPLATES]
    rows, want = [], {}
    for k in range(160):
        x = rng.choice(library)
        own = set(licenses.shingle_sequence(licenses.words_of(x.text)).tolist())
        words = edited(rng, x.text.split(), rng.randrange(max(2, len(x.text.split()) // 16)))
        share = len(own & set(licenses.shingle_sequence(licenses.words_of(" ".join(words))).tolist())) / len(own)
        spelt = b" ".join(licenses.words_of(" ".join(words)))
        told = all(b" ".join(licenses.words_of(p)) in spelt for p in x.required)
        noise = [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(300))]
        rows.append((k, " ".join([*noise, *words, *noise[:50]])))
        want[k] = (x.license_id, share, told)
    got = collections.defaultdict(dict)
    for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = licenses.words_of(rows[r.doc_id][1])[r.start_word : r.end_word]
        there = set(licenses.shingle_sequence(words).tolist())
        assert any(n == r.license_id and abs(len(t & there) / len(t) - r.containment) < 1e-5 for n, t in sets) and r.containment >= 0.8
        got[r.doc_id][r.license_id] = r.containment
    for k, (name, share, told) in want.items():
        if share >= 0.8 and told:
            assert name in got[k] and got[k][name] >= 0.8
        elif not told and sum(x.license_id == name for x in licenses.TEMPLATES) == 1:
            assert name not in got[k]
    assert 30 < sum(s >= 0.8 and told for _, s, told in want.values()) < 155


def test_recall_where_words_are_inserted(spark):
    """Inserted stretches beyond a window, up to the template's own length in all: nine of ten are found."""
    rng = random.Random(13)
    library = [x for x in licenses.TEMPLATES if len(licenses.words_of(x.text)) > 40 and "|" not in x.license_id]
    rows, want = [], {}
    for k in range(200):
        x = rng.choice(library)
        words, room = x.text.split(), len(x.text.split())
        told = [licenses.words_of(p) for p in x.required]
        cuts = sorted(rng.sample(range(1, len(words)), rng.randrange(1, 3)), reverse=True)
        for at in cuts:
            words[at:at] = [f"i{rng.randrange(10**6)}" for _ in range(rng.randrange(room // len(cuts)))]
        spelt = licenses.words_of(" ".join(words))
        own = set(licenses.shingle_sequence(licenses.words_of(x.text)).tolist())
        if len(own & set(licenses.shingle_sequence(spelt).tolist())) >= 0.8 * len(own) and all(b" ".join(p) in b" ".join(spelt) for p in told):
            rows.append((k, " ".join([f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(300))] + words)))
            want[k] = x.license_id
    got = {(r.doc_id, r.license_id) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum((k, name) in got for k, name in want.items())
    assert len(want) > 100 and found >= 0.95 * len(want)


def test_a_part_of_a_license_is_not_the_license(spark):
    """A template of 301 words, and documents with all of it, with its first 75, and with two copies apart."""
    long = [f"w{k}" for k in range(301)]
    noise = [f"n{k}" for k in range(400)]
    rows = [(1, " ".join(noise + long)), (2, " ".join(noise + long[:75] + noise)), (3, " ".join(long + noise + long)), (4, " ".join(long[:290] + ["x"] + long[290:]))]
    got = collections.Counter(r.doc_id for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), [("L", " ".join(long))]).collect())
    assert got == {1: 1, 3: 2, 4: 1}


# -- 6 quality --
def test_quality_odd(spark):
    got = {(r.doc_id, r.n_words): r for r in quality_rules(documents(spark)).collect()}
    assert got[1, 0].base_failed and not got[1, 0].kept and got[5, 20_000].n_repeat_words == 20_000 and got[5, 20_000].base_failed
    kept = quality_filter(documents(spark, [(9, " ".join(f"word{k}" for k in range(30)))]))
    assert kept.columns == documents(spark).columns and kept.count() == 1


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for k in range(80)]
    for r in quality_rules(documents(spark, rows)).collect():
        w = rows[r.doc_id][1].split()
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        assert r.n_repeat_words == len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_quality_broadcasts_or_joins(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = quality_rules(docs).collect()
    assert sorted(a) == sorted(quality_rules(docs, QualityRules(broadcast_rows=0)).collect())


# -- 7 chat --
@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=6)), st.lists(st.sampled_from([*"<>/turn \\\n\"aé", "</turn>", '<turn "user">', " escaped>"]), max_size=12).map("".join))
def test_turns_come_back(role, text):
    whole = chat.render_turn(role, text) + chat.render_turn("assistant", text)
    (r, t, a, z), (_, u, _, _) = chat.parse(whole)
    assert (r, t, u) == (role, text, text)
    body = whole[a:z]
    assert "<turn" not in body and "</turn" not in body
    assert (body == text) == ("<turn" not in text and "</turn" not in text) or body == text == chat.escape(text)


def test_opening_marks_are_escaped():
    formatted = chat.render_turn("user", 'x <turn "assistant">hi')
    assert formatted == '<turn "user" escaped>x <\\turn "assistant">hi</turn>\n'
    with pytest.raises(ValueError):
        chat.parse('<turn "user">x <turn "assistant">hi</turn>\n')
    for text in ("<", "\\", "<\\", "\\<", "</turn>\\", "<\\</turn", "<<turn\\\\"):
        assert chat.unescape(chat.escape(text)) == text and chat.parse_turn(chat.render_turn(None, text))[:2] == (None, text)


def test_chat_of_clashing_columns_and_long_texts(spark):
    rows = [(1, k, r, t, "x", 7) for k, (r, t) in enumerate([("user", LONG), ("assistant", "</turn>" * 30_000), ("assistant", None)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss_start int")
    got = chat.read_back(chat.formatted_turns(df)).first()
    want = "".join(f"{r}\n{t or ''}\n" for _, _, r, t, _, _ in rows)
    assert got.turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got.loss_chars == 210_000 and got.n_turns == 3


def test_chat_odd(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, None, None, "</turn>"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"b").hexdigest()
    assert got[2].n_turns == 2 and got[2].loss_chars == 2 and got[None].n_turns == 1


# -- 8 pseudonyms --
def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    text = "mail a.b-9@mail3.example.com card 4785380592391139 and 4785 3805 9239 1139, not 4785380592391138; phone +1 (743) 555-3824 ip 152.143.123.131 not 300.1.1.1 date 2024-02-29 not 2023-02-29 iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789."
    rows = [(1, text), (2, "again 4785380592391139"), (33, "clean 12 words, v1.2"), *ODD]
    out = pii.pseudonymised(documents(spark, rows), "key")
    got = {(r.doc_id, r.n_pseudonyms): r.text for r in out.collect()}
    new = got[1, 8]
    assert all(v not in new for v in ("a.b-9@", "4785380592391139", "4785 3805", "555-3824", "152.143", "2024-02-29", "0532 0130", "123-45-6789"))
    assert all(v in new for v in ("not 4785380592391138", "not 300.1.1.1", "not 2023-02-29"))
    card = re.search(r"card (\d{16}) and ((?:\d{4} ){3}\d{4}),", new)
    assert luhn(card[1]) and card[2].replace(" ", "") == card[1] and got[2, 1] == f"again {card[1]}"
    iban = re.search(r"iban (DE[\d ]+) ssn", new)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[33, 0] == "clean 12 words, v1.2" and got[1, 0] is None and got[5, 0] == LONG
    other = pii.pseudonymised(documents(spark, rows[:1]), "other").first().text
    assert other != new


class Brute:
    """The pseudonyms in plain Python, value by value, from the definitions."""

    def __init__(self, key):
        self.key = key

    def stream(self, *what, digits=8):
        return int(hashlib.sha256(f"{self.key}/{'/'.join(map(str, what))}".encode()).hexdigest()[:digits], 16)

    def string(self, kind, value):
        a, b = value[: len(value) // 2], value[len(value) // 2 :]

        def moved(c, by):
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(first) < size:
                    return chr((ord(c) - ord(first) + by) % size + ord(first))
            return c

        for r in range(8):
            turned = lambda x, other, r=r: "".join(moved(c, self.stream(kind, r, len(a), len(b), other, i)) for i, c in enumerate(x))  # noqa: B023, E731
            a, b = (turned(a, b), b) if r % 2 == 0 else (a, turned(b, a))
        return a + b

    def pair(self, kind, a, b, size_a, size_b):
        for r in range(16):
            a, b = ((a + self.stream(kind, r, b, digits=12)) % size_a, b) if r % 2 == 0 else (a, (b + self.stream(kind, r, a, digits=12)) % size_b)
        return a, b

    @staticmethod
    def back(value, pattern, new):
        rest = iter(new)
        return re.sub(pattern, lambda _: next(rest), value)

    def email(self, v):
        return self.back(v, "[A-Za-z0-9]", self.string("email", re.sub("[^A-Za-z0-9]", "", v)))

    def iban(self, v):
        n = v.replace(" ", "")
        if not iban_ok(v):
            return None
        body = self.string("iban", n[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + n[:2] + "00")) % 97
        return self.back(v, "[A-Z0-9]", f"{n[:2]}{check:02d}{body}")

    def card(self, v):
        d = re.sub("[^0-9]", "", v)
        if len(d) < 13 or not luhn(d):
            return None
        body = d[0] + self.string("card", d[1:-1])
        return self.back(v, "[0-9]", next(body + c for c in "0123456789" if luhn(body + c)))

    def ssn(self, v):
        bad, d = r"^(000|666|9)|^...00|0000$", v.replace("-", "")
        if re.search(bad, d):
            return None
        d = self.string("ssn", d)
        while re.search(bad, d):
            d = self.string("ssn", d)
        return self.back(v, "[0-9]", d)

    def phone(self, v):
        d = re.sub("[^0-9]", "", v)
        code = re.match(rf"(?:{pii.COUNTRY_CODES}|[0-9]{{3}})", d)[0] if v.startswith("+") else ""
        if not 7 <= len(d) <= 15:
            return None
        kind, n = d[len(code) :][:1] in "23456789" and len(d) > len(code), self.string("phone", d[len(code) :])
        while (n[:1] in "23456789" and bool(n)) != kind:
            n = self.string("phone", n)
        return self.back(v, "[0-9]", code + n)

    def ipv4(self, v):
        o = [int(x) for x in v.split(".")]
        if max(o) > 255:
            return None
        a, b = self.pair("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def date(self, v):
        x, sep = re.split("[./-]", v), re.search("[./-]", v)[0]
        year_first = len(x[0]) == 4
        high = not year_first and sep != "." and int(x[0]) > 12
        order = "ymd" if year_first else "dmy" if sep == "." or high else "mdy"
        part = dict(zip(order, map(int, x)))
        first = datetime.date(1900, 1, 1)
        try:
            day = (datetime.date(part["y"], part["m"], part["d"]) - first).days
        except ValueError:
            return None
        while True:
            a, b = self.pair("date", day % 17, day // 17, 17, 4297)
            day = b * 17 + a
            d = first + datetime.timedelta(day)
            own = {"y": d.year, "m": d.month, "d": d.day}
            text = sep.join(str(own[k]).zfill(len(w)) for k, w in zip(order, x))
            if len(text) == len(v) and (not high or d.day > 12):
                return text

    def pseudonym(self, v):
        for name, pattern in pii.PATTERNS.items():
            if re.fullmatch(pattern, v, re.ASCII) and (new := getattr(self, name)(v)) is not None:
                return new
        return None

    def ibans(self, text):
        out = set()
        for m in re.finditer(pii.IBAN_RUN, text, re.ASCII):
            words, n = m[1].split(" "), pii.IBAN_LENGTHS.get(m[1][:2])
            ends = [" ".join(words[:k]) for k in range(len(words), 0, -1)]
            ok = [v for v in ends if 15 <= len(v.replace(" ", "")) <= 34 and iban_ok(v)]
            fits = [v for v in ok if len(v.replace(" ", "")) == n] or (ok if n is None else [v for v in ok if v == m[1]])
            out.update(fits[:1])
        return sorted(out, key=lambda v: (-len(v), v))

    def text(self, t):
        if t is None:
            return None, 0
        found = self.ibans(t)
        known = rf"(?:(?<!\w)(?:{'|'.join(found)})(?!\w))|" if found else ""
        n = 0

        def new(m):
            nonlocal n
            p = self.pseudonym(m[0])
            n += p is not None
            return m[0] if p is None else p

        return re.sub(rf"(?:{pii.PATTERNS['email']})|{known}{pii.OTHERS}", new, t, flags=re.ASCII), n


def test_pseudonyms_against_brute_force(spark, sf, texts):
    rng = random.Random(14)
    made = [
        lambda: f"{rng.randrange(1000):03d}-{rng.randrange(100):02d}-{rng.randrange(10000):04d}", lambda: f"+{rng.choice([1, 44, 49, 358, 7])} ({rng.randrange(100, 1000)}) {rng.randrange(100, 1000)} {rng.randrange(1000, 10000)}",
        lambda: f"{rng.randrange(200, 1000)}-{rng.randrange(1000):03d}-{rng.randrange(10000):04d}", lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{rng.choice('abXY')}.{rng.randrange(99)}@mail{rng.randrange(9)}.org",
        lambda: f"{rng.randrange(1890, 2110)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 33):02d}", lambda: f"{rng.randrange(1, 32)}.{rng.randrange(1, 14)}.{rng.randrange(1900, 2100)}", lambda: f"{rng.randrange(1, 32):02d}/{rng.randrange(1, 32):02d}/{rng.randrange(1900, 2100)}",
        lambda: "4" + "".join(str(rng.randrange(10)) for _ in range(15)), lambda: "GB82 WEST 1234 5698 7654 32", lambda: f"DE{rng.randrange(10, 99)}37040044053201{rng.randrange(1000, 9999)}",
    ]
    rows = [(10_000 + k, " ".join(rng.choice(["on", "is", "A", "12", "no."]) + " " + rng.choice(made)() for _ in range(12))) for k in range(150)]
    rows += list(texts.items())
    brute = Brute("key")
    want = {i: brute.text(t) for i, t in rows}
    got = {r.doc_id: (r.text, r.n_pseudonyms) for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert [(i, got[i], want[i]) for i in want if got[i] != want[i]] == []
    assert sum(n for _, n in want.values()) > 800


def test_pseudonyms_are_permutations(spark):
    days = spark.range(73_049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    assert days.select(pii.pseudonym(F.lit("k"), F.col("v")).alias("p")).distinct().count() == 73_049
    codes = spark.range(1000).select(pii.string_feistel(F.lit("k"), "x", F.lpad(F.col("id").cast("string"), 3, "0")).alias("p"))
    assert codes.distinct().count() == 1000 and codes.where("p NOT RLIKE '^[0-9]{3}$'").count() == 0


def test_pseudonyms_are_valid_and_different(spark):
    """Social security numbers stay such, phone numbers keep country code and first digit's kind, and none meet."""
    k = F.lit("k")
    ids = spark.range(3000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 665 + 1, F.col("id") % 99 + 1, F.col("id") * 3 % 9999 + 1).alias("v")).distinct()
    out = ids.withColumn("p", pii.pseudonym(k, F.col("v")))
    assert out.where(r"p NOT RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' OR p RLIKE '^(000|666|9)|-00-|-0000$' OR p IS NULL").count() == 0
    assert out.select("p").distinct().count() == ids.count()
    n = F.lpad((F.col("id") * 7919 % 1_000_000).cast("string"), 6, "0")
    numbers = spark.range(2000).select(F.concat(F.lit("2"), F.substring(n, 1, 2), F.lit("-"), F.substring(n, 3, 3), F.lit("-5"), F.substring(n, 4, 3)).alias("v"))
    out = numbers.withColumn("p", pii.pseudonym(k, F.col("v")))
    assert out.where(r"p NOT RLIKE '^[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}$' OR p IS NULL").count() == 0
    assert out.select("p").distinct().count() == numbers.distinct().count()
    for v, like in (("+49 30 123456", r"\+49 \d\d \d{6}"), ("+1 (743) 555-3824", r"\+1 \([2-9]\d\d\) \d{3}-\d{4}"), ("+358 40 123 4567", r"\+358 \d\d \d{3} \d{4}"), ("+17435553824", r"\+1[2-9]\d{9}")):
        new = spark.range(1).select(pii.pseudonym(k, F.lit(v)).alias("p")).first().p
        assert new is None or (re.fullmatch(like, new) and new != v), (v, new)


def test_the_key_is_not_in_the_plan(spark):
    out = pii.pseudonymised(documents(spark, [(1, "ssn 123-45-6789")]), "very-secret")
    plans = out._jdf.queryExecution().toString() + out._jdf.queryExecution().optimizedPlan().toString()
    assert "very-secret" not in plans and out.first().n_pseudonyms == 1


def test_formats_that_overlap(spark):
    """The first format in their order takes a value that has several, wherever it begins."""
    rows = [(1, "2024-02-29"), (2, "a@1.2.3.4"), (3, "1.2.2024 1.2.3.4"), (4, "4785380592391139"), (5, "4785380592391139 4785380592391139"), (6, "10.11.2012")]
    got = {r.doc_id: (r.text, r.n_pseudonyms) for r in pii.pseudonymised(documents(spark, rows), "key").collect()}
    assert [got[k][1] for k in range(1, 7)] == [1, 1, 2, 1, 2, 1]
    assert re.fullmatch(r"[a-z]@[0-9.]+", got[2][0]) and got[5][0] == f"{got[4][0]} {got[4][0]}"


def iban_ok(v):
    v = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_ibans_end_where_they_end(spark):
    """What follows an IBAN may look like its part; in the other texts, what precedes a card looks like an IBAN."""
    rows = [
        (1, "DE89370400440532013000 BIC COBADEFFXXX", r"(DE\d{20}) BIC COBADEFFXXX"), (2, "GB82WEST12345698765432 A man", r"(GB\d\d[A-Z]{4}\d{14}) A man"),
        (3, "DE89 3704 0044 0532 0130 00 12 euros", r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) 12 euros"), (4, "to DE89370400440532013000.", r"to (DE\d{20})\."),
        (5, "DE88370400440532013000 BIC", None), (6, "AB12 4785 3805 9239 1139 X", r"AB12 (\d{4} \d{4} \d{4} \d{4}) X"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymised(documents(spark, [r[:2] for r in rows]), "key").collect()}
    for k, text, pattern in rows:
        if pattern is None:
            assert got[k].text == text and got[k].n_pseudonyms == 0
            continue
        new = re.fullmatch(pattern, got[k].text)
        assert new and new[1] not in text and got[k].n_pseudonyms == 1, got[k].text
        assert luhn(new[1].replace(" ", "")) if k == 6 else iban_ok(new[1])
    assert got[4].text[3:-1] == got[1].text[:22]
    # lengths are the registry's, and each country has one
    assert len(pii.IBAN_LENGTHS) == 89 and pii.IBAN_LENGTHS["DE"] == 22


def test_dates_in_all_orders(spark):
    rows = [
        (1, "at 2024-02-29T10:00:00Z", r"at (\d{4}-\d\d-\d\d)T10:00:00Z"), (2, "on 12/31/1999, 1", r"on (\d\d/\d\d/\d{4}), 1"), (3, "am 1.2.2024.", r"am (\d\.\d\.\d{4})\."),
        (4, "le 31/12/1999", r"le (\d\d/\d\d/\d{4})"), (5, "2/9/2024", r"(\d/\d/\d{4})"), (6, "13-10-2001 x", r"(\d\d-\d\d-\d{4}) x"),
    ]
    same = [(11, "30.2.2024"), (12, "13/13/2024"), (13, "v1.2.2024"), (14, "1.2.2024x"), (15, "2023-02-29T10:00:00Z")]
    got = {r.doc_id: r for r in pii.pseudonymised(documents(spark, [r[:2] for r in rows] + same), "key").collect()}
    for k, text, pattern in rows:
        new = re.fullmatch(pattern, got[k].text)
        assert new and new[1] not in text and got[k].n_pseudonyms == 1, got[k].text
    assert int(got[4].text[3:5]) > 12 and int(got[6].text[:2]) > 12
    assert all(got[k].text == text for k, text in same)


def test_each_way_to_write_dates_is_permuted(spark):
    d = F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(4000).select(d.alias("d"))
    for way, which in (("d.M.yyyy", "true"), ("dd/MM/yyyy", "day(d) > 12"), ("M/dd/yyyy", "true")):
        out = days.where(which).select(F.date_format("d", way).alias("v")).withColumn("p", pii.pseudonym(F.lit("k"), F.col("v")))
        r = out.agg(F.count("*").alias("n"), F.countDistinct("p").alias("p"), F.count_if(F.length("v") == F.length("p")).alias("same")).first()
        assert r.n == r.p == r.same


# -- 10 decontamination --
def test_masks_fit_between_any_substitutions():
    for a in range(13):
        for b in range(13):
            assert any(all(m[i] == "0" or at + i not in (a, b) for i in range(len(m))) for m in decontam.MASKS for at in range(13 - len(m) + 1))


def test_overlaps_against_brute_force(spark):
    rng = random.Random(7)
    items = [(k, " ".join(f"t{rng.randrange(40)}" for _ in range(n))) for k, n in enumerate([30, 20, 13, 12, 8, 6, 5, 4, 0])] + [(9, None), (0, "other text of item zero with more than five words")]
    rows = []
    for k in range(60):
        w = [f"t{rng.randrange(40)}" for _ in range(40)]
        own = items[k % 8][1].split()
        a = rng.randrange(max(1, len(own) - 12))
        w[10 : 10 + len(own)] = edited(rng, own[a:] or own, rng.randrange(4)) if own else []
        rows.append((k, " ".join(w).upper() if k % 3 else ", ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows + [(None if i is None else 100 + i, t) for i, t in ODD])
    want = set()
    for i, t in rows:
        d = decontam.words_of(t)
        for item, text in items:
            q = decontam.words_of(text or "")
            n = min(13, len(q))
            if len(q) >= 5 and any(sum(x == y for x, y in zip(d[a : a + n], q[b : b + n])) >= n - (2 if n == 13 else 0) for a in range(len(d) - n + 1) for b in range(len(q) - n + 1)):
                want.add((i, item))
    for block in (10_000_000, 200):
        assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench, block_chars=block).collect()} == want
        kept = decontam.decontaminated(docs, bench, block_chars=block)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.where("doc_id < 100").collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert len(want) > 20


def test_an_index_has_few_bytes():
    rng = random.Random(2)
    for items in ([(k, " ".join(rng.choice("abcdefgh") for _ in range(500))) for k in range(40)], [(0, " ".join(f"w{rng.randrange(9000)}" for _ in range(30_000)))]):
        assert decontam.SeedIndex(items).nbytes <= decontam.WORD_BYTES * sum(len(t.split()) for _, t in items) + 10_000


def test_a_large_benchmark_is_joined_in_one_scan(spark, sf, texts):
    """Documents are read once whatever the benchmark, and the join finds what the index finds."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    count = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            count.add(b.num_rows)
            yield b

    counted = docs.select("doc_id", "text").mapInArrow(seen, "doc_id long, text string")
    more = bench.unionByName(spark.createDataFrame([(9000 + k, " ".join(f"q{k}w{j}" for j in range(4 + k % 12))) for k in range(200)], "item_id long, text string"))
    want = sorted(map(tuple, decontam.overlaps(docs, more).collect()))
    got = sorted(map(tuple, decontam.overlaps(counted, more, block_chars=10).collect()))
    assert got == want and len(want) >= 3
    assert count.value == len(texts)


def test_odd_rows_of_a_joined_benchmark(spark):
    """Repeated documents and ids, nulls, and a passage that a third of the documents hold."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [(k, f"n{k} {item.replace('eta', 'x', 1)} m{k}" if k % 3 == 0 else f"clean text number {k}") for k in range(60)]
    rows += [(3, item), (3, item), (None, item), (61, None), (62, ""), (63, "one two three four five")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(1, item), (1, item), (1, "one two three four five"), (2, None), (None, item), (3, "w x y z")], "item_id long, text string")
    for block in (10, 10**6):
        got = sorted(((r.doc_id, r.item_id, r.matched_words) for r in decontam.overlaps(docs, bench, block_chars=block).collect()), key=repr)
        kept = sorted(((r.doc_id, r.text) for r in decontam.decontaminated(docs, bench, block_chars=block).collect()), key=repr)
        if block == 10:
            first = got, kept
    assert first == (got, kept) and len(kept) == 42 and len(got) == 2 * 23 + 1


def test_buckets_of_near_copies_are_linear(spark):
    """What is shuffled for a bucket of near copies grows as they do, also where some of its texts are like no other."""
    sizes = []
    for n in (1000, 2000, 4000):
        rng = np.random.default_rng(1)
        base = rng.integers(0, 1 << 16, 128).astype(np.uint16)
        signs = np.tile(base, (n, 1))
        signs[np.arange(n), rng.integers(4, 128, n)] ^= 1  # near copies
        signs[: n // 500, 4:] = rng.integers(0, 1 << 16, (n // 500, 124))  # and others in the same bucket
        texts = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(signs[::-1])], "node long, signature binary")
        edges, left = ngram_join.led(texts.select("node", F.lit(0).alias("tree"), F.lit(5).cast("long").alias("bucket")), texts, n, 128, 0.65)
        assert edges.count() == n - n // 500 - 1
        sizes.append(left.count())
        more = ngram_join.compared(left, "bucket", lambda k, g: ngram_join.spanning(k, g, 16, 8, 4, 0.65), "a long, b long")
        assert more.count() == 0
    assert sizes[0] < 1.1 * 1000 and sizes[2] < 4.4 * sizes[0]


def test_texts_that_are_left_over_find_their_like(spark, monkeypatch):
    """A bucket whose leader is like most: a text that is like one of the others, but not like the leader, is linked to it."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 16, 128).astype(np.uint16)
    signs = [base.copy() for _ in range(300)]
    for k in range(1, 300):
        signs[k][rng.choice(np.arange(4, 128), 3, replace=False)] ^= 1
    signs[150][60:100] ^= 1  # 0.67 like the leader
    signs.append(signs[150].copy())
    signs[300][100:128] ^= 1  # like text 150 at 0.78, like the leader at less than 0.5
    signs.append(rng.integers(0, 1 << 16, 128).astype(np.uint16))
    signs[301][:4] = base[:4]
    texts = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(signs)], "node long, signature binary")
    edges, left = ngram_join.led(texts.select("node", F.lit(0).alias("tree"), F.lit(5).cast("long").alias("bucket")), texts, 302, 128, 0.65)
    more = ngram_join.compared(left, "bucket", lambda k, g: ngram_join.spanning(k, g, 16, 8, 4, 0.65), "a long, b long").collect()
    assert edges.count() == 299 and [sorted(r) for r in more] == [[150, 300]]
