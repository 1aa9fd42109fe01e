"""Stages on their own input, against what they must do by definition; results don't depend on the path taken."""

import collections
import os

import pytest

import corpus_pipeline as cp
from ferrule.llm import decontam
from ferrule.llm.common import written
from tests.llm.test_llm import ODD, brute_lines, brute_links, documents


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), name)
        out.append((name, docs))
    return out


def test_shape(stages):
    first = stages[0][1]
    assert [n for n, _ in stages[1:]] == ["quality", "lines", "near_duplicates", "decontamination", "packing"] and cp.ORACLE_SQL is None
    assert all(df.dtypes == first.dtypes for _, df in stages[1:-1])


def test_stages(spark, sf, stages):
    rows = [{r.doc_id: r.text for r in df.collect()} for _, df in stages[:-1]]
    kept = {r.doc_id for r in __import__("ferrule.llm.quality", fromlist=["x"]).quality_rules(stages[0][1]).where("kept").collect()}
    assert set(rows[1]) == kept
    want = brute_lines(list(rows[1].items()), 50)
    assert rows[2] == {i: t for i, t in want.items() if t.strip() or t == rows[1][i]}
    assert not brute_links(list(rows[3].items())) and set(rows[3]) <= set(rows[2])
    gone = set(rows[2]) - set(rows[3])
    links = brute_links(list(rows[2].items()))
    assert gone <= {b for _, b in links} | {i for i in gone if collections.Counter(rows[2].values())[rows[2][i]] > 1}
    leaks = {r.doc_id for r in decontam.overlaps(stages[3][1], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(rows[4]) == set(rows[3]) - leaks
    packed = stages[5][1].toPandas()
    assert set(packed.doc_id) == set(rows[4]) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_is_the_stages_in_order(spark, sf, stages):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    out = cp.run(spark, sf)
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before)
    assert left.count("decontamination") == 1 and not {"quality", "measures", "lines", "signed"} & set(left)
    got = out.toPandas()
    want = stages[-1][1].toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))


PROSE = " ".join(f"word{k}" for k in range(60)) + "."
OTHER = "\n".join(" ".join(f"line{k}of{j}" for k in range(30)) for j in range(4))


def test_stages_on_odd_rows(spark, sf):
    """Null ids, texts and languages, empty and long texts, repeated rows, and columns whose names clash."""
    odd = [*ODD, (20, PROSE), (20, PROSE), (21, PROSE), (22, OTHER), (23, OTHER + "\nmore"), (None, PROSE + " again"), (24, f"{PROSE} x")]
    docs = documents(spark, odd)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = [r.asDict() for r in out.collect()]
        ids = collections.Counter(r["doc_id"] for r in rows)
        if name == "quality":
            assert ids == {20: 2, 21: 1, 22: 1, 23: 1, 24: 1, None: 1}  # the long text doesn't tell what they should be like
        elif name == "lines":
            # a null id comes first; of the others with one text the least id, whose rows are one place
            assert ids[20] == 2 and 21 not in ids and ids[24] == 1 and [r["text"] for r in rows if r["doc_id"] == 23] == ["more"]
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
        elif name == "near_duplicates":
            assert ids[20] == 2 and 21 not in ids and 24 not in ids and 22 in ids and 23 not in ids and ids[None] == 2 and ids[4] == 2
        else:
            assert ids == collections.Counter(i for i, _ in odd)
    packed = cp.STAGES[-1][1](spark, docs, sf).toPandas()
    assert len(packed[packed.piece == 0]) == len(odd) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_on_empty_tables(spark, sf):
    docs = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0
