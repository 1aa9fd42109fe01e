"""An island: the evolution of one population over a training sample in memory, in NumPy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np

from ferrule.evolve import mutate as mu
from ferrule.evolve.optim import answered, trials_of
from ferrule.functions.losses import cost_of
from ferrule.operators.constraints import complexity, satisfies
from ferrule.operators.options import Options
from ferrule.plans.compile import numpy_eval, numpy_grad
from ferrule.plans.expr import Const, Expr
from ferrule.plans.program import Program
from ferrule.plans.simplify import simplify

@dataclass(frozen=True)
class Member:
    id: int
    parent: int | None
    birth: int
    expr: Expr
    complexity: int
    loss: float
    cost: float


@dataclass
class Sample:
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray | None
    baseline: float | None = None

    def batch(self, rng: np.random.Generator, n: int) -> Sample:
        """Rows with replacement."""
        i = rng.integers(len(self.y), size=n)
        return Sample(self.x[:, i], self.y[i], None if self.w is None else self.w[i], self.baseline)


def decayed(freq: np.ndarray, window: float = 100_000.0) -> np.ndarray:
    """Frequencies taken down evenly, from those above 1, until they add up to the window at most."""
    freq = freq.copy()
    for _ in range(1000):
        over = freq.sum() - window
        high = freq > 1
        if over <= 0 or not high.any():
            break
        freq[high] = np.maximum(1.0, freq[high] - over / high.sum())
    return freq


class Island:
    def __init__(self, options: Options, sample: Sample, pop: int, iteration: int, members: list[Member], share: np.ndarray, serial: int = 0, maxsize: int | None = None, batches: list[Sample] | None = None):
        self.o, self.full, self.sample = options, sample, sample
        # drawn from ids alone, so that a task that is run again gives the same island
        self.rng = np.random.default_rng([options.seed, pop, iteration])
        self.pop, self.share = pop, share
        self.serial, self.evals = serial, 0.0
        self.members = [self.measured(m) for m in members]
        self.maxsize = maxsize or options.maxsize
        self.batches = batches  # drawn from all rows, where the sample isn't all of them
        self.best: dict[int, list[Member]] = {}

    # -- scoring --
    def score(self, expr: Expr, sample: Sample | None = None) -> tuple[float, float]:
        s = sample or self.sample
        self.evals += len(s.y) / len(self.full.y)
        value, ok = numpy_eval(expr, s.x)
        loss = self.o.loss.numpy(value, s.y, s.w) if ok else np.inf
        loss = loss if np.isfinite(loss) else np.inf
        return loss, cost_of(loss, complexity(expr, self.o), self.o.parsimony, s.baseline if self.o.use_baseline else None)

    def score_all(self, exprs: list[Expr]) -> list[tuple[float, float]]:
        """As ``score`` of each, on all of the island's rows; what the formulas share is computed once."""
        s, losses = self.full, [np.inf] * len(exprs)
        self.evals += len(exprs)

        def take(k: int, value: np.ndarray) -> None:
            loss = self.o.loss.numpy(value, s.y, s.w)
            losses[k] = loss if np.isfinite(loss) else np.inf

        Program(exprs).run(s.x, take)
        return [(loss, cost_of(loss, complexity(e, self.o), self.o.parsimony, s.baseline if self.o.use_baseline else None)) for e, loss in zip(exprs, losses, strict=True)]

    def member(self, expr: Expr, parent: int | None, scored: tuple[float, float] | None = None) -> Member:
        loss, cost = scored or self.score(expr)
        self.serial += 1
        return Member((self.pop << 32) + self.serial, parent, self.serial, expr, complexity(expr, self.o), loss, cost)

    def measured(self, m: Member) -> Member:
        """With the sample's loss where it is still to be found, as that of constants from all rows is."""
        if not np.isnan(m.loss):
            return m
        loss, cost = self.score(m.expr)
        return replace(m, loss=loss, cost=cost)

    def frequency(self, size: int) -> float:
        return max(float(self.share[size - 1]), 1e-6) if 0 < size <= len(self.share) else 1e-6

    # -- life --
    def start(self) -> None:
        while len(self.members) < self.o.population_size:
            expr = mu.first_expr(self.rng, self.o.operators, len(self.full.x), self.o.maxsize)
            self.members.append(self.member(expr, None))
        self.note(self.members)

    def note(self, members: Iterable[Member]) -> None:
        """The best few formulas of each complexity, best first; only a strictly lower cost takes a slot that is filled."""
        for m in members:
            few = self.best.get(m.complexity, [])
            if not 0 < m.complexity <= self.o.maxsize or (len(few) == self.o.candidates and not m.cost < few[-1].cost):
                continue
            if any(m.cost == o.cost and m.expr == o.expr for o in few) or not satisfies(m.expr, self.o):
                continue
            at = next((i for i, o in enumerate(few) if m.cost < o.cost), len(few))
            self.best[m.complexity] = [*few[:at], m, *few[at:]][: self.o.candidates]

    def tournament(self) -> Member:
        n = min(self.o.tournament_selection_n, len(self.members))
        some = [self.members[i] for i in self.rng.choice(len(self.members), n, replace=False)]
        scale = self.o.adaptive_parsimony_scaling if self.o.use_frequency_in_tournament else 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            score = [m.cost * np.exp(scale * self.frequency(m.complexity)) if scale else m.cost for m in some]
        p = self.o.tournament_selection_p
        odds = p * (1 - p) ** np.arange(n)
        place = int(self.rng.choice(n, p=odds / odds.sum()))
        return some[int(np.argsort(score, kind="stable")[place])]

    def replace_oldest(self, child: Member) -> None:
        at = min(range(len(self.members)), key=lambda i: (self.members[i].birth, i))
        self.members[at] = child

    def changed(self, choice: str, m: Member, temperature: float) -> Expr | None:
        o, n = self.o, len(self.full.x)
        return {
            "mutate_constant": lambda: mu.mutate_constant(self.rng, m.expr, o, temperature), "mutate_operator": lambda: mu.mutate_operator(self.rng, m.expr, o.operators),
            "mutate_feature": lambda: mu.mutate_feature(self.rng, m.expr, n), "swap_operands": lambda: mu.swap_operands(self.rng, m.expr),
            "rotate_tree": lambda: mu.rotate_tree(self.rng, m.expr), "add_node": lambda: mu.add_node(self.rng, m.expr, o.operators, n),
            "insert_node": lambda: mu.insert_node(self.rng, m.expr, o.operators, n), "delete_node": lambda: mu.delete_node(self.rng, m.expr),
            "randomize": lambda: mu.random_expr(self.rng, o.operators, n, int(self.rng.integers(1, min(self.maxsize, o.maxsize) + 1))),
            "do_nothing": lambda: m.expr,
        }[choice]()

    def next_generation(self, m: Member, temperature: float) -> tuple[Member, bool]:
        """A child by mutation and whether it is accepted; else it is the parent once more."""
        weights = mu.conditioned(self.o.weights, m.expr, self.o, len(self.full.x), self.maxsize)
        choice = mu.weighted_choice(self.rng, list(weights), list(weights.values()))
        same = (m.loss, m.cost)
        if choice == "simplify":
            expr, _ = simplify(m.expr)
            cost = cost_of(m.loss, complexity(expr, self.o), self.o.parsimony, self.sample.baseline if self.o.use_baseline else None)
            return self.member(expr, m.id, (m.loss, cost)), True
        if choice == "optimize":
            better = self.optimised(m)
            return (self.member(m.expr, m.id, same) if better.id == m.id else replace(better, parent=m.id)), True
        for _ in range(10):
            expr = self.changed(choice, m, temperature)
            if expr is not None and satisfies(expr, self.o, self.maxsize):
                break
        else:
            return self.member(m.expr, m.id, same), False
        before = self.evals
        loss, cost = self.score(expr)
        if not np.isfinite(cost):
            self.evals = before
            return self.member(m.expr, m.id, same), False
        odds = 1.0
        with np.errstate(over="ignore", invalid="ignore"):
            if self.o.annealing and self.o.alpha * temperature > 0:
                odds *= np.exp(-(cost - m.cost) / (self.o.alpha * temperature))
            if self.o.use_frequency:
                odds *= self.frequency(m.complexity) / self.frequency(complexity(expr, self.o))
        if odds < self.rng.random():
            return self.member(m.expr, m.id, same), False
        return self.member(expr, m.id, (loss, cost)), True

    def crossed(self) -> None:
        a, b = self.tournament(), self.tournament()
        for _ in range(10):
            x, y = mu.crossover(self.rng, a.expr, b.expr)
            if satisfies(x, self.o, self.maxsize) and satisfies(y, self.o, self.maxsize):
                self.replace_oldest(self.member(x, a.id))
                self.replace_oldest(self.member(y, b.id))
                return

    def cycle(self, temperature: float) -> None:
        for _ in range(-(-len(self.members) // self.o.tournament_selection_n)):
            if self.rng.random() > self.o.crossover_probability:
                child, accepted = self.next_generation(self.tournament(), temperature)
                if accepted or not self.o.skip_mutation_failures:
                    self.replace_oldest(child)
            else:
                self.crossed()

    def optimised(self, m: Member) -> Member:
        """The member with constants of less loss, if some are found; it then counts as new."""
        k = len(m.expr.consts)
        if not k:
            return m
        s = self.sample

        def objective(c: np.ndarray) -> tuple[float, np.ndarray]:
            value, grad, ok = numpy_grad(m.expr.with_constants(c), s.x)
            self.evals += 1
            if not ok:
                return np.inf, np.full(k, np.nan)
            return self.o.loss.numpy(value, s.y, s.w), grad @ self.o.loss.numpy_gradient(value, s.y, s.w)

        start = np.array(m.expr.consts)
        best, least = start, self.score(m.expr)[0]
        improved = False
        for r in range(1 + self.o.optimizer_nrestarts):
            x0 = start if r == 0 else start * (1 + 0.5 * self.rng.standard_normal(k))
            x, value = answered(trials_of(x0, self.o.optimizer_iterations, self.o.optimizer_f_calls_limit), objective)
            if np.isfinite(value) and value < least:
                best, least, improved = x, value, True
        return self.member(m.expr.with_constants(best), m.parent) if improved else m

    def drawn(self, k: int) -> Sample:
        """The rows for the cycles (0) and for the constants (1) of an iteration."""
        if not self.o.batching:
            return self.full
        return self.batches[k] if self.batches else self.full.batch(self.rng, self.o.batch_size)

    def iterate(self) -> None:
        """All cycles of an iteration, from hot to cold; then simpler forms, better constants, and full scores."""
        n = self.o.ncycles_per_iteration
        self.sample = self.drawn(0)
        for c in range(n):
            self.cycle((1 - c / max(1, n - 1)) if self.o.annealing else 1.0)
            if not self.o.batching:
                self.note(self.members)
        self.sample = self.drawn(1)
        for i, m in enumerate(self.members):
            if self.o.should_simplify:
                m = replace(m, expr=simplify(m.expr)[0])
            if self.o.should_optimize_constants and m.expr.count(Const) and self.rng.random() < self.o.optimizer_probability:
                m = self.optimised(m)
            self.members[i] = m
        self.sample = self.full
        for i, (m, (loss, cost)) in enumerate(zip(self.members, self.score_all([m.expr for m in self.members]), strict=True)):
            self.members[i] = replace(m, complexity=complexity(m.expr, self.o), loss=loss, cost=cost)
        self.note(self.members)

    def migrate(self, pool: list[Member], fraction: float) -> None:
        """A Poisson number of members give way to members of the pool, which get an id and birth of this island."""
        n = min(int(self.rng.poisson(len(self.members) * fraction)), len(self.members), len(pool))
        for _ in range(n):
            m = self.measured(pool[int(self.rng.integers(len(pool)))])
            self.serial += 1
            self.members[int(self.rng.integers(len(self.members)))] = replace(m, id=(self.pop << 32) + self.serial, parent=m.id, birth=self.serial)
