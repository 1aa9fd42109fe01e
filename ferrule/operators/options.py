"""Options of a search, with their defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from ferrule.functions.losses import Loss, mse
from ferrule.functions.state_losses import StateLoss
from ferrule.functions.scalar import OperatorSet


@dataclass(frozen=True)
class MutationWeights:
    mutate_constant: float = 0.0346
    mutate_operator: float = 0.293
    mutate_feature: float = 0.1
    swap_operands: float = 0.198
    rotate_tree: float = 4.26
    add_node: float = 2.47
    insert_node: float = 0.0112
    delete_node: float = 0.870
    simplify: float = 0.00209
    randomize: float = 0.000502
    do_nothing: float = 0.273
    optimize: float = 0.0


@dataclass(frozen=True)
class Options:
    operators: OperatorSet = field(default_factory=OperatorSet.default)
    loss: Loss | StateLoss = field(default_factory=mse)
    weights: MutationWeights = MutationWeights()
    seed: int = 0
    niterations: int = 100
    populations: int = 31
    population_size: int = 27
    ncycles_per_iteration: int = 380
    batch_size: int = 50
    complexity_of_constants: int = 1
    complexity_of_variables: int = 1
    maxsize: int = 30
    maxdepth: int = 30
    warmup_maxsize_by: float = 0.0
    parsimony: float = 0.0
    adaptive_parsimony_scaling: float = 1040.0
    crossover_probability: float = 0.0259
    perturbation_factor: float = 0.129
    probability_negate_constant: float = 0.00743
    tournament_selection_n: int = 15
    tournament_selection_p: float = 0.982
    alpha: float = 3.17
    optimizer_nrestarts: int = 2
    optimizer_probability: float = 0.14
    optimizer_iterations: int = 8
    optimizer_f_calls_limit: int = 10_000
    fraction_replaced: float = 0.00036
    fraction_replaced_hof: float = 0.0614
    topn: int = 12
    use_frequency: bool = True
    use_frequency_in_tournament: bool = True
    skip_mutation_failures: bool = True
    annealing: bool = True
    should_optimize_constants: bool = True
    migration: bool = True
    hof_migration: bool = True
    use_baseline: bool = True
    should_simplify: bool = True
    batching: bool = False
    variable_complexities: Mapping[int, int] = field(default_factory=dict)
    operator_complexity_overrides: Mapping[str, int] = field(default_factory=dict)
    #: operator -> the most complexity of each argument (None: any)
    op_constraints: Mapping[str, tuple[int | None, ...]] = field(default_factory=dict)
    #: operator -> {operator inside: how often at most}
    nested_constraints: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    #: rows of the training sample that each island holds
    sample_rows: int = 100_000
    #: how many different formulas of a complexity an island hands on, to be scored on all rows
    candidates: int = 5


def defaults(spark):
    """A row for each scalar option: name and value, as text."""
    plain = [(f.name, str(getattr(Options(), f.name)).lower() if isinstance(getattr(Options(), f.name), bool) else str(getattr(Options(), f.name))) for f in fields(Options) if isinstance(getattr(Options(), f.name), (bool, int, float))]
    weights = [(f"weight_{f.name}", str(getattr(MutationWeights(), f.name))) for f in fields(MutationWeights)]
    return spark.createDataFrame(plain + weights, "name string, value string")
