"""The evolutionary search: islands as partitions, one Spark job for each iteration.

Each island holds the bounded training sample and runs a whole iteration in its task; random numbers come from (seed,
population, iteration), so a task that runs again gives the same members. What the islands return is merged by the
relational steps in ``front``, and stored before the next iteration. All islands of an iteration see the same histogram
and the same migrants, so the result doesn't depend on which of them ends first.

Where the sample isn't all of the data, a member has two losses. Inside an iteration all decisions go by the sample's,
``own_loss``: a child and its parent are always measured alike. After it, the constants of drawn members are optimised over
all rows, all of them in step (``scoring.search_constants``), and the members and the best ``Options.candidates`` formulas of
each complexity are scored on all rows in one pass. Where rows repeat, equal ones are one row with a weight in these scans.
Hall of fame, migrants and front go by those losses. They are kept with the members, so a snapshot reads no row of the data.

With ``path`` a search outlives its driver: after each iteration its tables are written there, and then a manifest, by a
rename, that says which they are. ``SearchEngine.resume`` goes on from the last manifest; older iterations are deleted.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.evolve.island import Island, Member, Sample, decayed
from ferrule.functions.losses import cost_of
from ferrule.functions.scalar import BUILTIN
from ferrule.functions.state_losses import StateLoss
from ferrule.operators import front
from ferrule.operators.constraints import size_limit
from ferrule.operators.metrics import metrics
from ferrule.operators.options import Options
from ferrule.operators.scoring import baseline_loss, score_many, search_constants
from ferrule.plans.compile import evaluate
from ferrule.plans.expr import Const, Expr
from ferrule.plans.store import discard, remove, stored, text_file, written_whole
from ferrule.sources.dataset import Dataset, bootstrap, bounded_sample, exact_split, packed

MEMBERS = "pop long, id long, parent long, birth long, arrival long, expr string, complexity int, loss double, cost double, own_loss double, own_cost double, kind string, serial long, evals double"


def _row(pop: int, arrival: int, m: Member, kind: str, serial: int, evals: float) -> tuple:
    return (pop, m.id, m.parent, m.birth, arrival, json.dumps(m.expr.to_row()), m.complexity, m.loss, m.cost, m.loss, m.cost, kind, serial, evals)


def _member(r, ops) -> Member:
    """A member as islands see it, by its loss on the sample; NaN where that is still to be found."""
    return Member(int(r.id), None if pd.isna(r.parent) else int(r.parent), int(r.birth), Expr.from_row(json.loads(r.expr), ops), int(r.complexity), float(r.own_loss), float(r.own_cost))


def fingerprint(data: Dataset) -> str:
    """Roles, number of rows and a sum of the rows' hashes: the same for the same rows in any order."""
    row = data.project().agg(F.count("*").alias("n"), F.sum(F.xxhash64(*data.x, data.y, *([data.w] if data.w else [])).cast("decimal(20,0)")).alias("h")).first()
    return json.dumps([list(data.x), data.y, data.w, row.n, str(row.h)])


def described(o: Options) -> str:
    """A digest of the options, by which a resumed search is told from another one."""
    plain = {f.name: str(getattr(o, f.name)) for f in fields(o) if f.name not in ("operators", "loss", "niterations")}
    return hashlib.sha256(json.dumps([plain, sorted(o.operators.ops), o.loss.name]).encode()).hexdigest()


def settled(loss: float | None) -> float:
    """A loss over all rows to 12 digits, since partial sums are added up in any order; infinite where there is none."""
    return float(f"{loss:.12g}") if loss is not None and np.isfinite(loss) else np.inf


class Speed:
    """Evaluations a second: the mean of the last 20 readings, and a moving average that weighs a new one by 0.2."""

    def __init__(self):
        self.last: list[float] = []
        self.smooth: float | None = None

    def add(self, reading: float) -> None:
        self.last = [*self.last[-19:], reading]
        self.smooth = reading if self.smooth is None else 0.2 * reading + 0.8 * self.smooth

    @property
    def mean(self) -> float:
        return sum(self.last) / len(self.last) if self.last else 0.0


class SearchEngine:
    """A search that is stepped: ``step(n)`` runs n iterations, ``snapshot()`` shows where it is."""

    def __init__(self, data: Dataset, options: Options | None = None, validation_fraction: float = 0.0, key: str | None = None, path: str | None = None, _from: dict | None = None):
        self.options = options or Options()
        self.spark = data.df.sparkSession
        self.path, self.split_by = path and path.rstrip("/"), (validation_fraction, key)
        self.data, self.validation = data, None
        if validation_fraction > 0:
            if key is None:
                raise ValueError("a split needs a key column")
            halves = stored(exact_split(data.df, validation_fraction, key, self.options.seed), "split")
            self.data = Dataset(halves.where("NOT is_val"), data.x, data.y, data.w)
            self.validation = Dataset(halves.where("is_val"), data.x, data.y, data.w)
        if _from is None:
            total = self.data.project().count()
            x, y, w = bounded_sample(self.data, self.options.sample_rows, self.options.seed, total)
            self.sampled = len(y) < total
        else:
            total, self.sampled = None, _from["sampled"]
            x, y, w = self._kept_sample()
        # what losses over all rows are added up from: a state may take weights for something else than how often a row comes
        self.rows = packed(self.data, total) if self.sampled and not isinstance(self.options.loss, StateLoss) else self.data
        baseline = baseline_loss(self.rows, self.options.loss) if _from is None else _from["baseline"]
        self.baseline = None if baseline is None else settled(baseline)
        self.sample = Sample(x, y, w, baseline=self.baseline)
        self.shared = self.spark.sparkContext.broadcast(self.sample)
        self.iteration, self.total_evals, self.speed = 0, 0.0, Speed()
        self.freq = np.ones(self.options.maxsize)
        self.members: DataFrame | None = None
        self.members_of: DataFrame | None = None  # the stored table that the members are in
        self.hof: DataFrame | None = None
        self.tops: dict[int, list[Member]] = {}
        self.ops = BUILTIN | self.options.operators.ops
        self.data_print = fingerprint(self.data) if self.path else None
        if self.path and _from is None:
            self._keep_sample()
            self._keep()
        if _from is not None:
            self._restore(_from)

    # -- a search that outlives its driver --
    def _keep_sample(self) -> None:
        """The sample's rows in their order, since another session may draw others; at most ``sample_rows``."""
        s = self.sample
        rows = pd.DataFrame({**{f"x{k}": v for k, v in enumerate(s.x)}, "y": s.y, **({} if s.w is None else {"w": s.w}), "row": np.arange(len(s.y))})
        self.spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{self.path}/sample")

    def _kept_sample(self) -> tuple:
        rows = self.spark.read.parquet(f"{self.path}/sample").toPandas().sort_values("row")
        return rows[[f"x{k}" for k in range(len(self.data.x))]].to_numpy(np.float64).T.copy(), rows["y"].to_numpy(np.float64), rows["w"].to_numpy(np.float64) if "w" in rows else None

    def _keep(self) -> None:
        """Tables first, then the manifest that names them; only then what it no longer names goes."""
        tables = {}
        for name, df in (("members", self.members), ("hof", self.hof)):
            if df is not None:
                tables[name] = f"{name}-{self.iteration}"
                df.write.mode("overwrite").parquet(f"{self.path}/{tables[name]}")
        manifest = {
            "iteration": self.iteration, "total_evals": self.total_evals, "freq": self.freq.tolist(), "speed": [self.speed.last, self.speed.smooth], "baseline": self.baseline, "sampled": self.sampled,
            "tables": tables, "options": described(self.options), "data": self.data_print, "split": list(self.split_by),
        }
        written_whole(self.spark, f"{self.path}/manifest.json", json.dumps(manifest))
        for name in tables if self.iteration > 1 else ():
            remove(self.spark, f"{self.path}/{name}-{self.iteration - 1}")

    @classmethod
    def resume(cls, data: Dataset, options: Options, path: str) -> SearchEngine:
        """The search that was kept at ``path``, in a session of its own, where its last whole iteration left it.

        Data and options must be those that it began with (``niterations`` may grow)."""
        kept = json.loads(text_file(data.df.sparkSession, f"{path.rstrip('/')}/manifest.json"))
        if kept["options"] != described(options):
            raise ValueError("the search was kept with other options")
        engine = cls(data, options, *kept["split"], path=path, _from=kept)
        if engine.data_print != kept["data"]:
            raise ValueError("the search was kept with other data")
        return engine

    def _restore(self, kept: dict) -> None:
        self.iteration, self.total_evals, self.freq = kept["iteration"], kept["total_evals"], np.array(kept["freq"])
        self.speed.last, self.speed.smooth = kept["speed"]
        if kept["tables"]:
            # copied, since the next iteration deletes what the manifest named
            self.members, self.hof = (stored(self.spark.read.parquet(f"{self.path}/{kept['tables'][k]}"), k) for k in ("members", "hof"))
            self.members_of = self.members
            self._take_tops()

    def _take_tops(self) -> None:
        """Each population's best, from which others draw migrants; bounded by populations * topn."""
        self.tops = {}
        for r in front.top_members(self.members, self.options.topn).collect():
            self.tops.setdefault(int(r["pop"]), []).append(_member(r, self.ops))

    @property
    def is_finished(self) -> bool:
        return self.iteration >= self.options.niterations

    @property
    def total_cycles(self) -> int:
        return self.options.niterations * self.options.populations

    def step(self, n: int = 1) -> SearchEngine:
        for _ in range(n):
            if self.is_finished:
                break
            self._iterate()
        return self

    def run(self) -> SearchEngine:
        return self.step(self.options.niterations)

    def _iterate(self) -> None:
        began, before = time.monotonic(), self.total_evals
        self._run_islands()
        if self.path:
            self._keep()
        self.speed.add((self.total_evals - before) / max(time.monotonic() - began, 1e-9))

    def _cost(self, loss: float, size: int) -> float:
        o = self.options
        return float(cost_of(loss, size, o.parsimony, self.baseline if o.use_baseline else None))

    def _optimised(self, out: DataFrame) -> DataFrame:
        """``out`` with better constants, over all rows, of members that are drawn for it; these then count as new ones.

        Members are bounded by populations * population_size."""
        o = self.options
        rows = out.where("kind = 'member'").orderBy("pop", "arrival").collect()
        rng = np.random.default_rng([o.seed, self.iteration, 2])
        drawn = [r for r in rows if rng.random() < o.optimizer_probability]
        exprs = [Expr.from_row(json.loads(r.expr), self.ops) for r in drawn]
        some = [k for k, e in enumerate(exprs) if e.count(Const)]
        found = search_constants(self.rows, [exprs[k] for k in some], o.loss, o.optimizer_iterations, o.optimizer_nrestarts, o.seed + self.iteration, o.optimizer_f_calls_limit) if some else []
        better, serial = {}, {r["pop"]: r.serial for r in rows}
        for k, (e, _) in zip(some, found, strict=True):
            if e != exprs[k]:
                r = drawn[k]
                serial[r["pop"]] += 1
                better[r.id] = (r.id, (r["pop"] << 32) + serial[r["pop"]], serial[r["pop"]], json.dumps(e.to_row()))
        if not better:
            return out
        table = self.spark.createDataFrame(list(better.values()), "__old long, __id long, __birth long, __expr string")
        last = self.spark.createDataFrame(list(serial.items()), "pop long, __serial long")
        mine = F.col("__id").isNotNull()
        unknown = F.lit(float("nan"))  # the sample's loss of new constants is for the island to find
        both = out.join(F.broadcast(table), (F.col("id") == F.col("__old")) & (F.col("kind") == "member"), "left").join(F.broadcast(last), "pop")
        new = {"parent": F.when(mine, F.col("id")).otherwise(F.col("parent")), "id": F.coalesce("__id", "id"), "birth": F.coalesce("__birth", "birth"), "expr": F.coalesce("__expr", "expr"), "serial": F.col("__serial")}
        new |= {c: F.when(mine, unknown).otherwise(F.col(c)) for c in ("own_loss", "own_cost")}
        return both.select(*((new[c] if c in new else F.col(c)).alias(c) for c in out.columns))

    def _on_all_rows(self, out: DataFrame) -> DataFrame:
        """Members, and the best few formulas of each complexity, with loss and cost over all rows."""
        o = self.options
        rank = F.dense_rank().over(Window.partitionBy("kind", "complexity").orderBy("cost", "expr"))
        kept = out.withColumn("__rank", rank).where((F.col("kind") == "member") | (F.col("__rank") <= o.candidates)).drop("__rank")
        # bounded by populations * population_size + maxsize * candidates
        rows = kept.select("expr", "complexity").distinct().orderBy("complexity", "expr").collect()
        losses = {r.k: r.loss for r in score_many(self.rows, [Expr.from_row(json.loads(r.expr), self.ops) for r in rows], o.loss).collect()}
        scored = [(r.expr, r.complexity, loss := settled(losses[k]), self._cost(loss, r.complexity)) for k, r in enumerate(rows)]
        table = self.spark.createDataFrame(scored, "expr string, complexity int, loss double, cost double")
        return kept.drop("loss", "cost").join(F.broadcast(table), ["expr", "complexity"]).select(*out.columns)

    def _batches(self) -> dict[int, list[Sample]]:
        """Two minibatches for each island, drawn with replacement from all rows; bounded by populations * batch_size."""
        o = self.options
        frame = bootstrap(self.data.project(), 2 * o.populations * o.batch_size, o.seed + 7919 * (self.iteration + 1)).toPandas()
        order = np.random.default_rng([o.seed, self.iteration, 3]).permutation(len(frame))
        out = {}
        for pop in range(o.populations):
            parts = [frame.iloc[order[(2 * pop + k) * o.batch_size : (2 * pop + k + 1) * o.batch_size]] for k in (0, 1)]
            out[pop] = [Sample(p[list(self.data.x)].to_numpy(np.float64).T.copy(), p[self.data.y].to_numpy(np.float64), p[self.data.w].to_numpy(np.float64) if self.data.w else None, self.baseline) for p in parts]
        return out

    def _run_islands(self) -> None:
        iteration, shared, ops = self.iteration, self.shared, self.ops
        # constants are optimised after the iteration, over all rows, where the sample isn't all of them
        everywhere = self.sampled and self.options.should_optimize_constants
        o = replace(self.options, should_optimize_constants=False) if everywhere else self.options
        share = self.freq / self.freq.sum()
        maxsize = size_limit(o.maxsize, o.warmup_maxsize_by, iteration / max(1, o.niterations))
        tops = self.tops if o.migration else {}
        elite = [_member(r, ops) for r in self.pareto_members().collect()] if self.hof is not None and o.hof_migration else []

        def live(pop: int, frame: pd.DataFrame | None) -> pd.DataFrame:
            old = [] if frame is None else [_member(r, ops) for r in frame.sort_values("arrival").itertuples()]
            island = Island(o, shared.value, pop, iteration, old, share, 0 if frame is None else int(frame["serial"].max()), maxsize, batches.value.get(pop))
            if not old:
                island.start()
            else:
                island.migrate([m for q, best in tops.items() if q != pop for m in best], o.fraction_replaced)
                island.migrate(elite, o.fraction_replaced_hof)
            island.iterate()
            rows = [_row(pop, k, m, "member", island.serial, island.evals if k == 0 else 0.0) for k, m in enumerate(island.members)]
            rows += [_row(pop, k, m, "best", island.serial, 0.0) for k, m in enumerate(m for few in island.best.values() for m in few)]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])

        # bounded by populations * population_size
        old = {} if self.members is None else {int(pop): frame for pop, frame in self.members.toPandas().groupby("pop")}
        held = self.spark.sparkContext.broadcast(old)
        batches = self.spark.sparkContext.broadcast(self._batches() if self.sampled and o.batching else {})

        def islands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for pop in frame["id"].tolist():
                    yield live(pop, held.value.get(pop))

        # a partition an island, whatever the members' table weighs: adaptive execution would run them all in one task
        out = stored(self.spark.range(0, o.populations, 1, o.populations).mapInPandas(islands, MEMBERS), "members")
        held.destroy()
        batches.destroy()
        made = [out]
        if everywhere:
            out = stored(self._optimised(out), "members")
            made.append(out)
        if self.sampled:
            out = stored(self._on_all_rows(out), "members")
            made.append(out)
        self.iteration += 1
        before = (self.members_of, self.hof)
        self.members_of = out
        self.members = out.where("kind = 'member'")
        # members too: on all rows, one of them may be better than those that were best on the sample
        # what fails on some row is no candidate
        found = (out if self.sampled else out.where("kind = 'best'")).where(F.col("loss") < float("inf")).withColumn("arrival", F.col("pop") * 1_000_000 + F.col("arrival") + 1 + self.iteration * 10**12)
        self.hof = stored(front.best_by_complexity(found if self.hof is None else self.hof.unionByName(found), o.maxsize), "hof")
        discard(*made[:-1], *(t for t in before if t is not None))  # what these were made from
        self._take_tops()
        # bounded by maxsize
        sizes = {r["complexity"]: r["n"] for r in self.members.groupBy("complexity").agg(F.count("*").alias("n")).collect()}
        for size, n in sizes.items():
            if 0 < size <= o.maxsize:
                self.freq[size - 1] += n
        self.freq = decayed(self.freq)
        self.total_evals += self.members.agg(F.sum("evals")).first()[0] or 0.0

    # -- results --
    def hall_of_fame(self) -> DataFrame:
        return self.hof.select("complexity", "loss", "cost", "id", "expr")

    def pareto_members(self) -> DataFrame:
        return front.pareto_front(self.hof)

    def pareto_front(self) -> DataFrame:
        """The front: complexity, loss, cost, equation and id. Losses over all rows are kept with the members."""
        return self._shown([(r, Expr.from_row(json.loads(r.expr), self.ops), r.loss) for r in self.pareto_members().orderBy("complexity").collect()])

    def _shown(self, rows: list[tuple]) -> DataFrame:
        names = list(self.data.x)
        shown = [(int(r.complexity), float(loss), self._cost(loss, int(r.complexity)), e.text(names=names), int(r.id)) for r, e, loss in rows if np.isfinite(loss)]
        return front.pareto_front(self.spark.createDataFrame(shown, "complexity int, loss double, cost double, equation string, id long"))

    def best(self) -> DataFrame:
        return front.global_best(self.hof)

    def snapshot(self, k: int | None = None) -> dict:
        """Where the search is, with the front, or with its ``k`` most complex members alone."""
        done = self.iteration * self.options.populations
        shown = None if self.hof is None else self.pareto_front()
        if shown is not None and k is not None:
            shown = front.front_tail(shown, k)
        rows = [] if shown is None else [r.asDict() for r in shown.orderBy("complexity").collect()]
        return {"total_cycles": self.total_cycles, "cycles": done, "evals": self.total_evals, "evals_per_second": self.speed.mean, "finished": self.is_finished, "front": rows}

    def snapshot_json(self, k: int | None = None) -> str:
        """The snapshot as JSON; numbers that aren't finite are null."""
        plain = lambda v: {a: plain(b) for a, b in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else None if isinstance(v, float) and not np.isfinite(v) else v
        return json.dumps(plain(self.snapshot(k)))

    def refined_front(self, iterations: int | None = None) -> DataFrame:
        """The front with constants that were optimised over all rows, all members in step: a scan for each step."""
        rows = self.pareto_members().orderBy("complexity").collect()
        found = search_constants(self.rows, [Expr.from_row(json.loads(r.expr), self.ops) for r in rows], self.options.loss, iterations or self.options.optimizer_iterations)
        return self._shown([(r, e, settled(loss)) for r, (e, loss) in zip(rows, found, strict=True)])

    def split(self) -> DataFrame:
        """All rows with ``is_val``: which of them are for validation."""
        if self.validation is None:
            return self.data.df.withColumn("is_val", F.lit(False))
        return self.data.df.unionByName(self.validation.df)

    def evaluate_member(self, member: int, which: str = "train") -> DataFrame:
        """Metrics of a member on the rows for training (``train``) or validation (``val``)."""
        if which not in ("train", "val"):
            raise ValueError("which is train or val")
        data = self.data if which == "train" else self.validation
        if data is None:
            raise ValueError("there are no rows for validation")
        row = front.by_id(self.hof, self.members.select(*self.hof.columns), member).first()
        if row is None:
            raise KeyError(f"there is no member {member}")
        df = evaluate(data.project(), _member(row, self.ops).expr, data.x)
        return metrics(df, "yhat", data.y, data.w)


def equation_search(data: Dataset, options: Options | None = None, **more) -> SearchEngine:
    return SearchEngine(data, options, **more).run()


def show_front(front_rows: list, width: int = 80) -> str:
    """The front as a text table: Complexity, Loss, Equation, wrapped at ``width`` columns (80 at least)."""
    width = max(80, width)
    head = f"{'Complexity':<12}{'Loss':<14}Equation"
    lines = ["-" * width, head, "-" * width]
    for r in front_rows:
        text, room = r["equation"], width - 26
        chunks = [text[i : i + room] for i in range(0, len(text), room)] or [""]
        lines.append(f"{r['complexity']:<12}{r['loss']:<14.5e}{chunks[0]}")
        lines += [" " * 26 + c for c in chunks[1:]]
    return "\n".join([*lines, "-" * width])
