"""What holds for the pieces of a search by definition or for any draw: small inputs, each with its expected rows as SQL."""

from collections import Counter
from collections.abc import Callable

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.evolve import mutate as mu
from ferrule.evolve.island import Island, Member, Sample, decayed
from ferrule.evolve.optim import bfgs, newton
from ferrule.functions.scalar import BUILTIN, AmbiguousOperator, OperatorSet, UnknownOperator, register, registry
from ferrule.operators.constraints import complexity, satisfies, size_limit
from ferrule.operators.options import MutationWeights, Options, defaults
from ferrule.operators.search import Speed, show_front
from ferrule.operators.session import selected
from ferrule.oracle import OPERATORS
from ferrule.plans.expr import SCHEMA, Const, Expr, Var, build, lit, var
from ferrule.plans.simplify import simplify
from ferrule.queries import TREES
from ferrule.sources import dataset as ds
from tests.test_queries import plain

def tree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([{"tree": k, **e.to_row()} for k, e in TREES.items()], f"tree string, {SCHEMA}")


CUSTOM = Options(complexity_of_constants=3, variable_complexities={1: 2}, operator_complexity_overrides={"cos": 4, "mul": 2}, maxsize=16, maxdepth=4)
LIMITED = Options(op_constraints={"mul": (None, 4)}, nested_constraints={"exp": {"neg": 0}})

#: Trees and draws.
TRIALS = 300
NAMES = ["+", "sub", "*", "/", "cos", "exp", "max", "fma"]


def seeded_trees(seed: int, n: int = TRIALS) -> list[Expr]:
    rng = np.random.default_rng(seed)
    ops = OperatorSet.from_names(NAMES)
    return [mu.random_expr(rng, ops, 3, 1 + k % 25) for k in range(n)]


def small_sample() -> Sample:
    x = np.random.default_rng(1).normal(size=(2, 60))
    return Sample(x, 2.0 * x[0] + x[1] ** 2, None, 3.0)


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each mutation over seeded trees: results that are no trees, and results that break the mutation's own rule."""
    ops, rng = OperatorSet.from_names(NAMES), np.random.default_rng(2)
    shape = lambda e: Counter(type(n).__name__ if not hasattr(n, "name") else n.name for n in e.nodes)
    arities = lambda e: [getattr(n, "arity", 0) for n in e.nodes]
    differ = lambda a, b: sum(x != y for x, y in zip(a.nodes, b.nodes, strict=True))
    steps = {
        "mutate_constant": (lambda e: mu.mutate_constant(rng, e, Options(), 1.0), lambda a, b: a.nodes == b.nodes and sum(x != y for x, y in zip(a.consts, b.consts, strict=True)) <= 1),
        "mutate_operator": (lambda e: mu.mutate_operator(rng, e, ops), lambda a, b: arities(a) == arities(b) and differ(a, b) <= 1),
        "mutate_feature": (lambda e: mu.mutate_feature(rng, e, 3), lambda a, b: arities(a) == arities(b) and differ(a, b) == 1),
        "swap_operands": (lambda e: mu.swap_operands(rng, e), lambda a, b: shape(a) == shape(b)),
        "rotate_tree": (lambda e: mu.rotate_tree(rng, e), lambda a, b: shape(a) == shape(b) and sorted(a.consts) == sorted(b.consts)),
        "add_node": (lambda e: mu.add_node(rng, e, ops, 3), lambda a, b: len(b.nodes) > len(a.nodes)),
        "insert_node": (lambda e: mu.insert_node(rng, e, ops, 3), lambda a, b: 0 < len(b.nodes) - len(a.nodes) <= 3),
        "delete_node": (lambda e: mu.delete_node(rng, e), lambda a, b: len(b.nodes) < len(a.nodes)),
        "randomize": (lambda e: mu.random_expr(rng, ops, 3, len(e.nodes)), lambda a, b: len(b.nodes) <= len(a.nodes)),
        "simplify": (lambda e: simplify(e)[0], lambda a, b: len(b.nodes) <= len(a.nodes)),
    }
    rows = []
    for name, (step, rule) in steps.items():
        made = [(e, step(e)) for e in seeded_trees(3)]
        invalid = sum(m is not None and not (m.is_valid and all(n.slot < len(m.consts) for n in m.nodes if isinstance(n, Const))) for _, m in made)
        rows.append((name, len(made), invalid, sum(m is not None and not rule(e, m) for e, m in made)))
    return spark.createDataFrame(rows, "mutation string, trees int, invalid int, broken int")


def crossovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of trees that change subtrees keep their nodes between them."""
    rng, left, right = np.random.default_rng(4), seeded_trees(5), seeded_trees(6)
    made = [(a, b, *mu.crossover(rng, a, b)) for a, b in zip(left, right, strict=True)]
    kept = sum(len(a.nodes) + len(b.nodes) == len(x.nodes) + len(y.nodes) and x.is_valid and y.is_valid for a, b, x, y in made)
    return spark.createDataFrame([(len(made), kept)], "pairs int, kept int")


def random_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random trees by the size that is asked for: never larger, and of that size where operators of one argument are."""
    trees = seeded_trees(7)
    rows = [(1 + k % 25, len(e.nodes), e.is_valid) for k, e in enumerate(trees)]
    df = spark.createDataFrame(rows, "size int, nodes int, valid boolean")
    return df.groupBy("size").agg(F.count("*").alias("n"), F.count_if(F.col("nodes") != F.col("size")).alias("other"), F.every("valid").alias("valid"))


def optimisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minima of a quadratic of 16 constants, and of one of a single constant."""
    goal = np.arange(1.0, 17.0)
    found, _ = bfgs(lambda c: (float((goal * (c - goal) ** 2).sum()), 2 * goal * (c - goal)), np.zeros(16), 60)
    one, _ = newton(lambda c: (float((c[0] - 7) ** 2), np.array([2 * (c[0] - 7)])), 0.0, 20)
    return spark.createDataFrame([*(("bfgs", k, round(float(v), 3)) for k, v in enumerate(found)), ("newton", 0, round(one, 3))], "method string, slot int, value double")


def size_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, size_limit(30, 0.5, k / 20)) for k in range(21)], "step int, most int")


def conditioned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which mutations are left out for a tree: without sense, or too large."""
    rows = []
    for name, e in {"constant": lit(1.0), **TREES}.items():
        for most in (30, len(e.nodes)):
            w = mu.conditioned(MutationWeights(), e, Options(), 3, most)
            rows.append((name, most, ",".join(sorted(k for k, v in w.items() if v == 0.0 and k != "optimize"))))
    return spark.createDataFrame(rows, "tree string, most int, left_out string")


def weighted_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by weight: whether their shares are within 4 standard deviations; those of weight 0 never come."""
    rng, weights = np.random.default_rng(8), {"a": 1.0, "b": 2.0, "none": 0.0, "c": 5.0}
    n = 20_000
    got = Counter(mu.weighted_choice(rng, list(weights), list(weights.values())) for _ in range(n))
    near = lambda k, p: abs(got[k] - n * p) <= 4 * (n * p * (1 - p)) ** 0.5
    return spark.createDataFrame([(k, near(k, w / 8)) for k, w in weights.items()], "name string, near boolean")


def frequency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies beyond the window add up to it after the decay, and keep their order and their least, 1."""
    out = [decayed(np.arange(1.0, 31.0) * scale) for scale in (1.0, 1000.0, 1e6)]
    rows = [(k, bool(x.sum() <= 100_000.001), bool((np.diff(x) >= 0).all()), bool(x.min() >= 1.0)) for k, x in enumerate(out)]
    return spark.createDataFrame(rows, "scale int, within boolean, ordered boolean, floor boolean")


def island_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for a population through cycles, migration and the end of an iteration."""
    o = Options(operators=OperatorSet.from_names(["+", "*", "cos"]), population_size=20, ncycles_per_iteration=15, maxsize=9, fraction_replaced=0.5, optimizer_probability=0.5)
    island = Island(o, small_sample(), 3, 0, [], np.ones(9) / 9)
    island.start()
    first = min(m.loss for m in island.members)
    rows = [("start", len(island.members), all(m.parent is None for m in island.members))]
    oldest = min(m.birth for m in island.members)
    for _ in range(60):
        island.cycle(0.5)
    rows.append(("cycle", len(island.members), min(m.birth for m in island.members) > oldest and len({m.id for m in island.members}) == 20))
    pool = [Member(900 + k, None, 1, var(0) * lit(2.0), 3, 9.0, 9.0) for k in range(5)]
    island.migrate(pool, 0.5)
    came = [m for m in island.members if m.parent is not None and m.parent >= 900 and m.parent < 905]
    rows.append(("migrate", len(island.members), bool(came) and all(m.id >> 32 == 3 for m in came)))
    island.iterate()
    rows.append(("iterate", len(island.members), all(m.complexity == complexity(m.expr, o) <= 9 for m in island.members)))
    rows.append(("best", 20, min(m.loss for few in island.best.values() for m in few) <= first))
    before = island.member(var(0) * lit(1.0) + lit(0.5), None)
    after = island.optimised(before)
    rows.append(("optimise", 20, after.loss < before.loss and after.birth > before.birth))
    cheap = [island.tournament().cost for _ in range(400)]
    rows.append(("tournament", 20, float(np.mean(cheap)) < float(np.mean([m.cost for m in island.members if np.isfinite(m.cost)]))))
    again = [Island(o, small_sample(), 3, 0, [], np.ones(9) / 9) for _ in range(2)]
    for i in again:
        i.start()
        i.iterate()
    rows.append(("repeat", 20, again[0].members == again[1].members))
    return spark.createDataFrame([(a, b, bool(c)) for a, b, c in rows], "step string, members int, holds boolean")


def tree_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, e.is_leaf, e.max_arity, any(isinstance(n, Var) for n in e.nodes), any(isinstance(n, Const) for n in e.nodes), ",".join(map(str, e.sizes()))) for k, e in TREES.items()]
    return spark.createDataFrame(rows, "tree string, is_leaf boolean, max_arity int, has_vars boolean, has_consts boolean, sizes string")


def tree_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants that are set, shared, left unused, and numbered anew."""
    pool = Expr((Const(3), Const(1), BUILTIN["add"], Const(3), BUILTIN["mul"]), (10.0, 20.0, 30.0, 40.0))
    small = pool.compressed()
    rows = [("pool", str(pool), len(pool.consts)), ("compressed", str(small), len(small.consts)), ("set", str(small.with_constants((1.5, 2.0))), 2)]
    return spark.createDataFrame(rows, "case string, formula string, consts int")


def tree_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas by Python's operators and by builders."""
    x, y = var(0), var(1)
    rows = [
        ("mixed", (x + 1.0) * y), ("reverse", 1.0 - x), ("quotient", 2.0 / (x - y)), ("negative", -(x * 2.0)), ("unary", build("tanh", build("abs", x))),
        ("ternary", build("clamp", x, 0.0, 1.0)), ("nary", build("max", x, build("min", y, 3.0))),
    ]
    return spark.createDataFrame([(k, str(e), len(e.nodes)) for k, e in rows], "case string, formula string, nodes int")


def operator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by name, display or infix; unknown and ambiguous ones; what is shown for an operator that isn't there."""
    every = OperatorSet(tuple(BUILTIN.values()))

    def found(token: str, arity: int | None) -> str:
        try:
            return every.lookup(token, arity).name
        except UnknownOperator:
            return "unknown"
        except AmbiguousOperator as e:
            return "one of " + " ".join(sorted(e.candidates))

    rows = [(token, arity, found(token, arity)) for token, arity in ((" COS ", None), ("+", None), ("-", None), ("-", 1), ("-", 2), ("fma", 2), ("nothing", None), ("Atan2", None))]
    rows.append(("no_such_op", None, every.describe("no_such_op")["display"]))
    return spark.createDataFrame(rows, "token string, arity int, found string")


def operator_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets, sets by arity, and custom operators, which work like the others."""
    square = register("square", 1, lambda m, v: v * v, [lambda m, v: v * 2.0])
    sets = {k: OperatorSet.preset(k) for k in ("basic", "trig", "explog")} | {"default": OperatorSet.default(), "by_arity": OperatorSet.from_names_by_arity(["cos"], ["max"], ["fma"]), "custom": OperatorSet([square, "add"])}
    return spark.createDataFrame([(k, " ".join(sorted(s.ops)), len(s.by_arity(2))) for k, s in sets.items()], "set string, operators string, binary int")


def search_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings 1 to 25: the mean of the last 20, and a moving average."""
    speed, rows = Speed(), []
    for k in range(1, 26):
        speed.add(float(k))
        rows.append((k, round(speed.mean, 6), round(speed.smooth, 6)))
    return spark.createDataFrame(rows, "reading int, mean double, smooth double")


def selected_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that is shown for a choice: of the front, else the best where it is the chosen one, or none is chosen."""
    shown, best = [{"id": 1}, {"id": 2}], {"id": 9}
    found = [(c, selected(shown, b, c)) for c in (None, 1, 9, 7) for b in (best, None)]
    return spark.createDataFrame([(k, c, m and m["id"]) for k, (c, m) in enumerate(found)], "n int, chosen int, shown int")


def random_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal and Poisson numbers of an island's generator: whether mean and variance are near what they should be."""
    rng = Island(Options(), small_sample(), 0, 0, [], np.ones(30) / 30).rng
    n = 40_000
    normal, poisson = rng.standard_normal(n), rng.poisson(2.5, n)
    near = lambda v, goal: bool(abs(v - goal) < 0.05)
    return spark.createDataFrame([("normal", near(normal.mean(), 0), near(normal.var(), 1)), ("poisson", near(poisson.mean(), 2.5), near(poisson.var(), 2.5))], "draws string, mean boolean, variance boolean")


def role_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that can't be: which of them are refused."""
    two = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    cases = {
        "one_column": lambda: ds.with_roles(two.select("a")), "no_rows": lambda: ds.with_roles(two.limit(0)), "unknown_y": lambda: ds.with_roles(two, y="z"), "unknown_w": lambda: ds.with_roles(two, w="z"),
        "unknown_x": lambda: ds.with_roles(two, x=["z"]), "w_is_y": lambda: ds.with_roles(two, y="c", w="c"), "x_has_y": lambda: ds.with_roles(two, y="c", x=["a", "c"]),
        "x_has_w": lambda: ds.with_roles(two, y="c", w="b", x=["a", "b"]), "no_x": lambda: ds.with_roles(two.select("a", "b"), y="b", w="a"), "fine": lambda: ds.with_roles(two, x=["b", "a", "a"]),
    }

    def outcome(make: Callable) -> str:
        try:
            return ",".join(make().x)
        except ds.DatasetError:
            return "refused"

    return spark.createDataFrame([(k, outcome(v)) for k, v in cases.items()], "roles string, x string")


def default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ds.default_data(spark)
    off = F.abs(F.col("y") - (2.0 * F.cos("x0") + F.col("x1") * F.col("x1") - 2.0))
    return df.agg(F.count("*").alias("n"), F.count_if(off > 1e-9).alias("off"), (F.stddev("x0").between(0.7, 1.3) & F.stddev("x1").between(0.7, 1.3)).alias("normal"))


def front_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = show_front([{"complexity": 3, "loss": 0.5, "equation": "x0 * " + "x1 + " * 14 + "2"}, {"complexity": 12, "loss": 1.25e-7, "equation": "x0"}])
    return spark.createDataFrame([(k, line.rstrip()) for k, line in enumerate(shown.splitlines())], "line int, text string")


def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and depth by SQL over the node arrays; the depth is a stack machine."""
    of = lambda kind: F.size(F.filter("nodes", lambda n: n["kind"] == kind))
    step = lambda s, n: F.concat(F.array(1 + F.coalesce(F.array_max(F.slice(s, 1, n["arity"])), F.lit(0))), F.slice(s, n["arity"] + 1, F.size(s)))
    depth = F.aggregate("nodes", F.array().cast("array<int>"), lambda s, n: F.when(n["arity"] > 0, step(s, n)).otherwise(F.concat(F.array(F.lit(1)), s)))
    left = F.aggregate("nodes", F.lit(0), lambda s, n: s + 1 - n["arity"])
    return tree_table(spark, sf_dir).select("tree", F.size("nodes").alias("n_nodes"), of("op").alias("n_ops"), of("var").alias("n_vars"), of("const").alias("n_consts"), F.get(depth, F.lit(0)).alias("depth"), (left == 1).alias("valid"))


def tree_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, str(e), str(simplify(e)[0])) for k, e in TREES.items()], "tree string, formula string, simplified string")


def op_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark)


def option_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defaults(spark)


def complexity_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, complexity(e), complexity(e, CUSTOM), satisfies(e, CUSTOM), satisfies(e, LIMITED)) for k, e in TREES.items()]
    return spark.createDataFrame(rows, "tree string, plain int, custom int, satisfies_custom boolean, satisfies_limited boolean")


def listed(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


LEAF = "mutate_operator,simplify,swap_operands"
#: What is left out for each tree: what a leaf can't have, and what a tree of the most nodes can't.
LEFT_OUT = [("constant", 1, f"delete_node,mutate_feature,{LEAF}"), ("leaf", 1, f"delete_node,mutate_constant,{LEAF}"), ("readme", 6, ""), ("fma", 6, ""), ("nested", 12, ""), ("sum", 5, ""), ("difference", 5, "")]
#: Options and their defaults.
DEFAULTS = """
seed 0
niterations 100
populations 31
population_size 27
ncycles_per_iteration 380
batch_size 50
complexity_of_constants 1
complexity_of_variables 1
maxsize 30
maxdepth 30
warmup_maxsize_by 0.0
parsimony 0.0
adaptive_parsimony_scaling 1040.0
crossover_probability 0.0259
perturbation_factor 0.129
probability_negate_constant 0.00743
tournament_selection_n 15
tournament_selection_p 0.982
alpha 3.17
optimizer_nrestarts 2
optimizer_probability 0.14
optimizer_iterations 8
optimizer_f_calls_limit 10000
fraction_replaced 0.00036
fraction_replaced_hof 0.0614
topn 12
use_frequency true
use_frequency_in_tournament true
skip_mutation_failures true
annealing true
should_optimize_constants true
migration true
hof_migration true
use_baseline true
should_simplify true
batching false
sample_rows 100000
candidates 5
weight_mutate_constant 0.0346
weight_mutate_operator 0.293
weight_mutate_feature 0.1
weight_swap_operands 0.198
weight_rotate_tree 4.26
weight_add_node 2.47
weight_insert_node 0.0112
weight_delete_node 0.87
weight_simplify 0.00209
weight_randomize 0.000502
weight_do_nothing 0.273
weight_optimize 0.0
"""


def expected() -> dict[str, str]:
    out: dict[str, str] = {}
    out["mutations"] = listed("mutation, trees, invalid, broken", *(f"'{n}', 300, 0, 0" for n in "mutate_constant mutate_operator mutate_feature swap_operands rotate_tree add_node insert_node delete_node randomize simplify".split()))
    out["crossovers"] = listed("pairs, kept", "300, 300")
    out["random_trees"] = "SELECT size::INTEGER AS size, 12::BIGINT AS n, 0::BIGINT AS other, true AS valid FROM range(1, 26) AS t(size)"
    out["optimisers"] = "SELECT 'bfgs' AS method, k::INTEGER AS slot, (k + 1)::DOUBLE AS value FROM range(16) AS t(k) UNION ALL SELECT 'newton', 0, 7.0"
    out["size_warmup"] = "SELECT k::INTEGER AS step, (CASE WHEN k <= 10 THEN 3 + 27 * k // 10 ELSE 30 END)::INTEGER AS most FROM range(21) AS t(k)"
    out["conditioned_weights"] = listed("tree, most, left_out", *(f"'{n}', 30, '{x}'" for n, _, x in LEFT_OUT), *(f"'{n}', {k}, '{x or 'add_node,insert_node'}'" for n, k, x in LEFT_OUT))
    out["weighted_choices"] = listed("name, near", *(f"'{n}', true" for n in ("a", "b", "none", "c")))
    out["frequency_decay"] = "SELECT k::INTEGER AS scale, true AS within, true AS ordered, true AS floor FROM range(3) AS t(k)"
    out["island_life"] = listed("step, members, holds", *(f"'{n}', 20, true" for n in "start cycle migrate iterate best optimise tournament repeat".split()))
    out["tree_shapes"] = listed(
        "tree, is_leaf, max_arity, has_vars, has_consts, sizes", "'leaf', true, 0, true, false, '1'", "'readme', false, 2, true, true, '1,1,1,3,4,6'", "'fma', false, 3, true, true, '1,1,1,4,1,6'",
        "'nested', false, 2, true, true, '1,1,3,4,5,1,2,1,4,1,6,12'", "'sum', false, 2, true, true, '1,1,3,1,5'", "'difference', false, 2, true, true, '1,1,1,3,5'",
    )
    out["tree_constants"] = listed('"case", formula, consts', "'pool', '(40 + 20) * 40', 4", "'compressed', '(40 + 20) * 40', 2", "'set', '(1.5 + 2) * 1.5', 2")
    out["tree_algebra"] = listed(
        '"case", formula, nodes', "'mixed', '(x0 + 1) * x1', 5", "'reverse', '1 - x0', 3", "'quotient', '2 / (x0 - x1)', 5", "'negative', '-(x0 * 2)', 4", "'unary', 'tanh(abs(x0))', 3",
        "'ternary', 'clamp(x0, 0, 1)', 4", "'nary', 'max(x0, min(x1, 3))', 5",
    )
    out["operator_lookup"] = listed(
        "token, arity, found", "' COS ', NULL, 'cos'", "'+', NULL, 'add'", "'-', NULL, 'one of neg sub'", "'-', 1, 'neg'", "'-', 2, 'sub'", "'fma', 2, 'unknown'", "'nothing', NULL, 'unknown'", "'Atan2', NULL, 'atan2'",
        "'no_such_op', NULL, 'unknown_op'",
    )
    out["operator_sets"] = listed(
        '"set", operators, binary', "'basic', 'add cos div mul sub', 4", "'trig', 'add cos div mul sin sub', 4", "'explog', 'add cos div exp log mul sub', 4", "'default', 'add div mul sub', 4", "'by_arity', 'cos fma max', 1",
        "'custom', 'add square', 1",
    ).replace("binary)", '"binary")')
    out["search_speed"] = """
WITH RECURSIVE s(reading, smooth) AS (SELECT 1, 1.0::DOUBLE UNION ALL SELECT reading + 1, 0.2 * (reading + 1) + 0.8 * smooth FROM s WHERE reading < 25)
SELECT reading, round((greatest(1, reading - 19) + reading) / 2, 6)::DOUBLE AS mean, round(smooth, 6) AS smooth FROM s"""
    out["selected_member"] = listed("n, chosen, shown", "0, NULL, 9", "1, NULL, NULL", "2, 1, 1", "3, 1, 1", "4, 9, 9", "5, 9, NULL", "6, 7, NULL", "7, 7, NULL")
    out["random_draws"] = listed("draws, mean, variance", "'normal', true, true", "'poisson', true, true")
    out["role_errors"] = listed("roles, x", *(f"'{n}', 'refused'" for n in "one_column no_rows unknown_y unknown_w unknown_x w_is_y x_has_y x_has_w no_x".split()), "'fine', 'a,b'")
    out["default_rows"] = "SELECT 100::BIGINT AS n, 0::BIGINT AS off, true AS normal"
    rule = "-" * 80
    table = [rule, "Complexity  Loss          Equation", rule, "3           5.00000e-01   x0 * x1 + x1 + x1 + x1 + x1 + x1 + x1 + x1 + x1 + x1 +", " " * 27 + "x1 + x1 + x1 + x1 + 2", "12          1.25000e-07   x0", rule]
    out["front_table"] = listed("line, text", *(f"{k}, '{line}'" for k, line in enumerate(table)))
    out["tree_counts"] = """
SELECT * FROM (VALUES ('leaf', 1, 0, 1, 0, 1, true), ('readme', 6, 3, 2, 1, 4, true), ('fma', 6, 2, 3, 1, 3, true), ('nested', 12, 7, 4, 1, 5, true),
  ('sum', 5, 2, 1, 2, 3, true), ('difference', 5, 2, 1, 2, 3, true)) AS t(tree, n_nodes, n_ops, n_vars, n_consts, depth, valid)"""
    out["tree_strings"] = """
SELECT * FROM (VALUES ('leaf', 'x0', 'x0'), ('readme', 'l_quantity * cos(l_discount - 3.2)', 'l_quantity * cos(l_discount - 3.2)'),
  ('fma', 'fma(l_quantity, l_discount, l_tax) / 2.5', 'fma(l_quantity, l_discount, l_tax) / 2.5'),
  ('nested', 'exp(-(l_discount * l_discount)) + (max(sin(l_quantity), l_discount) * 0.5)', 'exp(-(l_discount * l_discount)) + (max(sin(l_quantity), l_discount) * 0.5)'),
  ('sum', '(l_quantity + 1) + 2', 'l_quantity + 3'), ('difference', '1 - (2 - l_quantity)', 'l_quantity - 1')) AS t(tree, formula, simplified)"""
    both = {"add", "mul", "min", "max"}
    infix = {"neg": "-", "add": "+", "sub": "-", "mul": "*", "div": "/"}
    rows = ", ".join(f"('{n}', {len(p) - 1}, {repr(infix[n]) if n in infix else 'NULL'}, '{infix.get(n, n)}', {n in both}, {n in both}, 1)" for n, p in OPERATORS.items())
    out["op_registry"] = f"SELECT * FROM (VALUES {rows}) AS t(name, arity, infix, display, commutative, associative, complexity)"
    out["complexity_custom"] = """
SELECT * FROM (VALUES ('leaf', 1, 1, true, true), ('readme', 6, 13, true, true), ('fma', 6, 9, true, true), ('nested', 12, 19, false, false),
  ('sum', 5, 9, true, true), ('difference', 5, 9, true, true)) AS t(tree, plain, custom, satisfies_custom, satisfies_limited)"""
    out["option_defaults"] = "SELECT * FROM (VALUES " + ", ".join(f"('{line.split()[0]}', '{line.split()[1]}')" for line in DEFAULTS.strip().splitlines()) + ") AS t(name, value)"
    return out


PIECES = (mutations, crossovers, random_trees, optimisers, size_warmup, conditioned_weights, weighted_choices, frequency_decay, island_life, tree_shapes, tree_constants, tree_algebra, operator_lookup, operator_sets, search_speed, selected_member, random_draws, role_errors, default_rows, front_table, tree_counts, tree_strings, op_registry, option_defaults, complexity_custom)


@pytest.mark.parametrize("piece", PIECES, ids=lambda f: f.__name__)
def test_piece(spark, sf, piece):
    df, sql = piece(spark, sf), duckdb.sql(expected()[piece.__name__])
    assert sorted(df.columns) == sorted(sql.columns)
    order, other = ([list(c).index(n) for n in sorted(c)] for c in (df.columns, sql.columns))
    got = sorted([plain(r[i]) for i in order] for r in map(tuple, df.collect()))
    assert got == sorted([plain(r[i]) for i in other] for r in sql.fetchall())
