"""Deduplication of repeated runs of lines by winnowing, with DataFrame functions only.

A run is a series of neighbouring lines of one document with ``min_words`` words or more, whose first and last lines have
words. A line is deleted when it lies in a run that also occurs earlier in the corpus, in the order of (document, line).

1. Winnowing: the windows of a document are its shortest runs, forwards and backwards from each line. In each of them the
   line with the least hash, of equal ones the first, is selected. What is stored is a fingerprint for each selected line:
   its hash and place. Equal runs select the same line, so a repeated run is sure to share one with its earlier copy.
2. Positions: fingerprints with equal hashes are joined, by way of their pre-aggregated count; those that occur once are
   done with.
3. Extension: each matched fingerprint is extended on line hashes both ways, to all windows that selected it. The windows
   of a hash are aggregated to the first place that has them. A longer repeated run is the union of such windows, so a
   match is extended to its maximum, and no pair of copies is ever formed: the work is linear in the lines, however often
   one of them occurs. Where no fingerprint is matched nothing is extended or compared.
4. Later places of a window are deleted; the rest of a document is joined again.

What is deleted goes by 128 bits: lines and runs have two 64-bit hashes of different seeds, and texts too. Of 10**15 runs
two different ones agree in both with a probability of 10**-9. Fingerprints go by one hash, since a chance match there only
extends what is then told apart.

A line or run that very many documents share is a hot key of two joins, which ``joined_by_count`` splits off.

Defined results: a null text counts as an empty one and stays null; rows that agree in id and text are one place, and
each of them gets that place's result; of rows that agree in the id alone, that with the lesser text hash comes first; a
null id comes before all others. White space counts when lines are compared. Only the id and text columns are read;
other columns pass through, but for ``n_lines`` and ``n_removed``, which take the place of any that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import SEPARATORS, joined_by_count, let, written
from ferrule.plans.store import discard

#: Lines whose words are added up at a time; a document's sums cost its lines times this, at most.
BLOCK = 64


def below(values: Column, goal: Column) -> Column:
    """How many entries of a sorted array are less than ``goal``, by halving steps."""
    steps = F.filter(F.array(*(F.lit(1 << s) for s in range(30, -1, -1))), lambda p: p <= F.size(values))
    return F.aggregate(steps, F.lit(0), lambda at, p: F.when((at + p <= F.size(values)) & (F.get(values, at + p - 1) < goal), at + p).otherwise(at))


def sums_before(words: Column) -> Column:
    """For each place from 0 to the size, the sum of the entries before it; in blocks, so that it isn't quadratic."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    whole = lambda i: F.floor(i / BLOCK).cast("int")

    def of(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), whole(F.size(w))), lambda b: add(F.slice(w, b * BLOCK + 1, BLOCK)))
        starts = let(blocks, lambda x: F.transform(x, lambda _, b: add(F.slice(x, 1, b))))
        return let(starts, lambda s: F.transform(F.sequence(F.lit(0), F.size(w)), lambda i: F.get(s, whole(i)) + add(F.slice(w, whole(i) * BLOCK + 1, i % BLOCK))))

    return let(words, of)


def windows_of(hashes: Column, words: Column, min_words: int) -> Column:
    """The shortest runs forwards from each line and backwards from each line, as structs: a and z, the first and last
    line from 0, and p, the line that is selected in it."""

    def of(e: Column) -> Column:
        sums, w, h = e["sums"], e["words"], e["hashes"]
        lines = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) > 0)
        forward = F.transform(lines, lambda i: F.struct(i.alias("a"), (below(sums, F.get(sums, i) + min_words) - 1).alias("z")))
        back = F.transform(lines, lambda j: F.struct((below(sums, F.get(sums, j + 1) - min_words + 1) - 1).alias("a"), j.alias("z")))
        both = F.sort_array(F.filter(F.concat(forward, back), lambda r: (r["a"] >= 0) & (r["z"] < F.size(w))))
        runs = let(both, lambda b: F.filter(b, lambda r, i: (i == 0) | (F.get(b, i - 1) != r)))
        selected = lambda r: let(F.slice(h, r["a"] + 1, r["z"] - r["a"] + 1), lambda x: r["a"] + F.array_position(x, F.array_min(x)).cast("int") - 1)
        return F.transform(runs, lambda r: F.struct(r["a"].alias("a"), r["z"].alias("z"), selected(r).alias("p")))

    return F.when(F.aggregate(words, F.lit(0), lambda s, x: s + x) >= min_words, let(F.struct(sums_before(words).alias("sums"), words.alias("words"), hashes.alias("hashes")), of))


def two_hashes(x: Column) -> Column:
    """128 bits as two hashes of different seeds."""
    return F.struct(first_hash(x).alias("one"), F.xxhash64(F.lit(7), x).alias("two"))


def first_hash(x: Column) -> Column:
    return F.xxhash64(x)


def line_table(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """A row for each document: id, key (two hashes of the text), two hashes of each of its lines, and its windows (null where it is
    too short for one)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    # a line's words: what its separators part, when those at the ends are taken off
    count = lambda x: let(F.regexp_replace(x, rf"^{SEPARATORS}|{SEPARATORS}$", ""), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SEPARATORS))))
    both = let(lines, lambda x: F.struct(F.transform(x, lambda y: first_hash(y)).alias("hashes"), F.transform(x, lambda y: F.xxhash64(F.lit(7), y)).alias("others"), F.transform(x, count).alias("words")))
    found = let(both, lambda x: F.struct(x["hashes"].alias("hashes"), x["others"].alias("others"), windows_of(x["hashes"], x["words"], min_words).alias("windows")))
    rows = docs.select(F.col(doc_id).alias("id"), two_hashes(F.coalesce(F.col(text), F.lit(""))).alias("key"), found.alias("l"))
    return rows.select("id", "key", "l.*")


def fingerprints(lined: DataFrame) -> DataFrame:
    """A row for each selected line of each document: id, key, p and its hash, the mark."""
    selected = F.array_distinct(F.transform("windows", lambda w: w["p"]))
    return lined.select("id", "key", F.explode(F.transform(selected, lambda p: F.struct(p.alias("p"), F.get("hashes", p).alias("mark")))).alias("f")).select("id", "key", "f.*")


def matched(marks: DataFrame) -> DataFrame:
    """The fingerprints whose hash has another place too."""
    place = F.struct("id", "key", "p")
    often = marks.groupBy("mark").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    return joined_by_count(marks, often.where(~F.col("first").eqNullSafe(F.col("last"))).select("mark", "n"), "mark", "n").drop("n")


def extended(lined: DataFrame, found: DataFrame) -> DataFrame:
    """The windows that the matched fingerprints extend to: id, key, a, z and two hashes of all its lines, the run."""
    places = found.groupBy("id", "key").agg(F.collect_set("p").alias("places")).select(F.col("id").alias("__id"), F.col("key").alias("__key"), "places")
    rows = lined.join(places, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")))
    own = F.filter("windows", lambda w: F.array_contains("places", w["p"]))
    part = lambda c, w: F.slice(c, w["a"] + 1, w["z"] - w["a"] + 1)
    run = lambda w: F.struct(F.xxhash64(part("hashes", w)).alias("one"), F.xxhash64(F.lit(7), part("others", w)).alias("two"))
    runs = F.transform(own, lambda w: F.struct(w["a"].alias("a"), w["z"].alias("z"), run(w).alias("run")))
    return rows.select("id", "key", F.explode(runs).alias("r")).select("id", "key", "r.*")


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Of the runs, those that occur at an earlier place too."""
    place = F.struct("id", "key", "a")
    firsts = runs.groupBy("run").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    return joined_by_count(runs, firsts.select("run", "n", "first"), "run", "n").where(~place.eqNullSafe(F.col("first"))).select("id", "key", "a", "z")


def line_dedup(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the later copies of repeated runs; n_lines and n_removed are added."""
    lined = written(line_table(docs, min_words, doc_id, text), "lines")
    marks = written(fingerprints(lined), "fingerprints")
    runs = written(extended(lined, matched(marks)), "runs")
    discard(lined, marks)
    gone = repeated_runs(runs)
    gone = gone.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.struct(F.col("gone.a").alias("a"), F.col("gone.z").alias("z")).alias("__gone"))
    keyed = docs.withColumn("__text_key", two_hashes(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(gone, (F.col("__text_key") == F.col("__key")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def stays(gaps: Column, i: Column) -> Column:
        # runs that begin later end later, so that the last to begin by line i reaches it if any does
        return let(below(gaps["a"], i + 1), lambda k: (k == 0) | (F.get(gaps["z"], k - 1) < i))

    rest = let(F.col("__gone"), lambda g: F.filter(lines, lambda _, i: stays(g, i)))
    rest = let(rest, lambda r: F.struct(F.array_join(r, "\n").alias("text"), (F.size(lines) - F.size(r)).cast("long").alias("removed")))
    out = joined.withColumn("__rest", F.when(F.col("__gone").isNotNull(), rest))
    replaced = {text: F.when(F.col("__rest").isNotNull(), F.col("__rest.text")).otherwise(F.col(text)), "n_lines": F.size(lines).cast("long"), "n_removed": F.coalesce("__rest.removed", F.lit(0).cast("long"))}
    return out.withColumns(replaced).drop("__id", "__key", "__gone", "__text_key", "__rest")
