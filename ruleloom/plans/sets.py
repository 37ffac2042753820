"""Decision sets: mine rules, select some, predict by all that fit."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RuleSet
from ..operators.labels import data_to_rules, predict, rules_to_clusters
from ..operators.metrics import auc, rule_length
from ..operators.select import coverage_mistake_select
from .mining import Car, ClassAssociationMiner, RuleMiner


@dataclass
class DecisionSet:
    """Needs a miner or rules. Points are (id, label, features...)."""

    miner: RuleMiner | None = None
    given: RuleSet | None = None
    rules: RuleSet | None = field(default=None, init=False)

    def __post_init__(self):
        if (self.miner is None) == (self.given is None):
            raise ValueError("give a miner or rules")

    def select(self, points: DataFrame, rules: RuleSet) -> RuleSet:
        return rules

    def fit(self, points: DataFrame) -> DecisionSet:
        rules = self.given if self.given is not None else self.miner.fit(points)
        self.rules = self.select(points, rules).trimmed()
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        return predict(points, self.rules)

    def weighted_rule_length(self, points: DataFrame) -> DataFrame:
        return rule_length(data_to_rules(points, self.rules), rules_to_clusters(points.sparkSession, self.rules))


@dataclass
class DSCluster(DecisionSet):
    """Distorted greedy selection by coverage minus lambda times mistakes."""

    lambd: float = 1.0
    n_rules: int = 10

    def select(self, points, rules):
        rules = RuleSet(tuple(r for r in rules if r.label != -1))
        if not len(rules):
            return rules
        hits = data_to_rules(points, rules).persist()
        clusters = points.filter(F.col("label").isNotNull()).select("id", F.col("label").alias("cluster"))
        try:
            return rules.subset(coverage_mistake_select(clusters, rules_to_clusters(points.sparkSession, rules), hits, self.n_rules, self.lambd))
        finally:
            hits.unpersist()


@dataclass
class CBA(DecisionSet):
    """Classification based on associations (Liu et al. 1998): rules by
    confidence, support and length; a point belongs to the first rule that fits;
    the list is cut where its errors and those of the default class are least."""

    def __post_init__(self):
        super().__post_init__()
        if not isinstance(self.miner, ClassAssociationMiner):
            raise ValueError("CBA needs a class association miner")

    def fit(self, points):
        self.miner.fit(points)
        cars = sorted((c for c in self.miner.cars if c.label != -1), key=_rank)
        if not cars:
            raise ValueError("no class association rules were found")
        rules = RuleSet(tuple(c.rule() for c in cars))
        from ..operators.labels import rule_matches

        first = points.filter(F.col("label").isNotNull()).select(F.array_min(rule_matches(rules)).alias("r"), "label").groupBy("r", "label").count()
        counts: dict = {}
        for r in first.collect():  # rules x labels
            counts.setdefault(r["r"], {})[r["label"]] = r["count"]
        left: dict = {}
        for by in counts.values():
            for y, n in by.items():
                left[y] = left.get(y, 0) + n
        best, errors, kept = (sum(left.values()) - max(left.values(), default=0), -1, max(left, key=lambda y: (left[y], -y), default=None)), 0, []
        for i, r in enumerate(rules):
            by = counts.get(i, {})
            if not by.get(r.label):
                continue  # it is right nowhere
            kept.append(i)
            for y, n in by.items():
                left[y] -= n
                errors += n if y != r.label else 0
            default = max(left, key=lambda y: (left[y], -y))
            total = errors + sum(left.values()) - left[default]
            if total < best[0]:
                best = (total, len(kept) - 1, default)
        self.default = best[2]
        self.rules = rules.subset(kept[: best[1] + 1]).trimmed()
        return self


def _rank(c: Car):
    return (-c.confidence, -c.support, len(c.items), c.items, c.label)


@dataclass
class IDS(DecisionSet):
    """Interpretable decision sets (Lakkaraju et al. 2016): smooth local search
    over seven terms. The terms need, of the points, only counts of rules and
    of pairs of rules; the search works on these on the driver.

    With ``lambdas`` None the terms' weights are searched for by coordinate
    ascent: one after the other, each by ternary search in its range (of
    ``ranges``, 0 to 1000 each unless given) down to ``precision``, for the set
    with the greatest mean AUC, in ``max_iterations`` rounds at most."""

    lambdas: Sequence[float] | None = (1.0,) * 7
    seed: int = 0
    ranges: Sequence[tuple[float, float]] | None = None
    precision: float = 1.0
    max_iterations: int = 50

    def __post_init__(self):
        super().__post_init__()
        if self.lambdas is not None and len(self.lambdas) != 7:
            raise ValueError("lambdas has seven weights")
        self.ranges = [(0.0, 1000.0)] * 7 if self.ranges is None else [tuple(map(float, r)) for r in self.ranges]
        if len(self.ranges) != 7 or any(a > z for a, z in self.ranges):
            raise ValueError("ranges has seven pairs of a least and a greatest weight")
        if self.precision <= 0 or self.max_iterations < 1:
            raise ValueError("precision is over 0 and max_iterations over 0")

    def select(self, points, rules):
        rules = RuleSet(tuple(r for r in rules if r.label != -1))
        stats = ids_statistics(points, rules)
        if self.lambdas is not None:
            return rules.subset(sorted(ids_search(stats, self.lambdas, self.seed)))
        patterns = rule_patterns(points, rules).persist()
        found: dict[frozenset[int], float] = {}

        def score(weights: Sequence[float]) -> float:
            chosen = frozenset(ids_search(stats, weights, self.seed))
            if chosen not in found:  # many weights lead to the same set
                found[chosen] = mean_auc(patterns, stats, chosen)
            return found[chosen]

        try:
            self.weights, self.auc = coordinate_ascent(score, self.ranges, self.precision, self.max_iterations)
        finally:
            patterns.unpersist()
        return rules.subset(sorted(ids_search(stats, self.weights, self.seed)))


def rule_patterns(points: DataFrame, rules: RuleSet) -> DataFrame:
    """(rules: numbers of those that fit, label, n): all that scores of points need."""
    from ..operators.labels import rule_matches

    return points.filter(F.col("label").isNotNull()).select(rule_matches(rules).alias("rules"), "label").groupBy("rules", "label").agg(F.count("*").alias("n"))


def class_scores(patterns: DataFrame, stats: dict, chosen: Iterable[int]) -> DataFrame:
    """(class, score, positive, n): a point's score in a class is the greatest
    confidence of the chosen rules of that class that fit it, 0 without one.
    Classes are the labels of all rules and points."""
    chosen, rules = set(chosen), stats["rules"]
    classes = sorted({r.label for r in rules} | {r["label"] for r in patterns.select("label").distinct().collect()})

    def greatest(table: Column) -> Column:
        return F.aggregate("rules", F.lit(0.0), lambda a, i: F.greatest(a, F.get(table, i)))

    sides = []
    for y in classes:
        by_rule = [stats["ok"].get(i, 0) / stats["cover"][i] if i in chosen and r.label == y and stats["cover"].get(i) else 0.0 for i, r in enumerate(rules)]
        table = F.array(*map(F.lit, by_rule)) if rules else F.array().cast("array<double>")
        sides.append(F.struct(F.lit(y).alias("class"), greatest(table).alias("score")))
    each = patterns.select("label", "n", F.explode(F.array(*sides)).alias("s"))
    return each.select("s.class", "s.score", (F.col("s.class") == F.col("label")).alias("positive"), "n")


def mean_auc(patterns: DataFrame, stats: dict, chosen: Iterable[int]) -> float:
    """Mean AUC, one class against the rest, of the classes that have both."""
    return float(auc(class_scores(patterns, stats, chosen)).agg(F.avg("auc")).first()[0] or 0.0)


def coordinate_ascent(score: Callable[[Sequence[float]], float], ranges: Sequence[tuple[float, float]], precision: float, most: int) -> tuple[list[float], float]:
    """Weights within ``ranges`` and their score. Starts from the best of the
    middle of all ranges and the points where one weight is greatest and the
    others least; then each weight in turn is set by ternary search between the
    ends of its range, which count too. Of all weights met the best are kept, the
    first of equal ones. Ends when a round raises the score no more, or after
    ``most`` rounds."""
    starts = [[(a + z) / 2 for a, z in ranges], *([z if i == k else a for i, (a, z) in enumerate(ranges)] for k in range(len(ranges)))]
    best, now = max(((score(w), w) for w in starts), key=lambda x: x[0])
    for _ in range(most):
        before = best
        for k, (low, high) in enumerate(ranges):

            def tried(x: float, k: int = k) -> float:
                nonlocal best, now
                weights = [*now[:k], x, *now[k + 1 :]]
                s = score(weights)
                if s > best:
                    best, now = s, weights
                return s

            tried(low), tried(high)
            while high - low > precision:
                third = (high - low) / 3
                left, right = tried(low + third), tried(high - third)
                low, high = (low + third, high) if left < right else (low, high - third)
        if best <= before:
            break
    return now, best


def ids_search(stats: dict, lambdas: Sequence[float], seed: int = 0, delta: float = 1 / 3) -> set[int]:
    """Smooth local search (Feige, Mirrokni and Vondrak 2011) to convergence.

    A rule's weight is what it adds, on average, to a random set that has the
    rules of the current set by chance (1 + delta) / 2 and others by
    (1 - delta) / 2. A rule of positive weight comes in, one of negative weight
    goes out. Rules are drawn independently and the terms are sums over rules,
    pairs and classes, so that weights are exact and need no draws; each move
    raises the average. The best of a set drawn around the one found, of its
    complement and of itself is taken, and improved by single moves.
    """
    rng = random.Random(seed)
    n = len(stats["rules"])
    chosen: set[int] = set()
    while n:
        weights = ids_weights(stats, [(1 + delta) / 2 if i in chosen else (1 - delta) / 2 for i in range(n)], lambdas)
        top, i = max((-w if i in chosen else w, -i) for i, w in enumerate(weights))
        if top <= 1e-9:
            break
        chosen ^= {-i}
    drawn = {i for i in range(n) if rng.random() < ((1 + delta) / 2 if i in chosen else (1 - delta) / 2)}
    best = max((chosen, set(range(n)) - chosen, drawn), key=lambda c: ids_objective(stats, c, lambdas))
    # a rule of it whose own move raises the objective still moves
    while n:
        weights = ids_weights(stats, [float(i in best) for i in range(n)], lambdas)
        top, i = max((-w if i in best else w, -i) for i, w in enumerate(weights))
        if top <= 1e-9:
            break
        best = best ^ {-i}
    return best


def ids_weights(s: dict, chance: Sequence[float], lambdas: Sequence[float]) -> list[float]:
    """What each rule adds to the objective, on average over sets that have each other rule by its chance."""
    rules = s["rules"]
    same, cross = [0.0] * len(rules), [0.0] * len(rules)
    for (i, j), c in s["pairs"].items():
        to = same if rules[i].label == rules[j].label else cross
        to[i] += c * chance[j]
        to[j] += c * chance[i]
    out = []
    for i, r in enumerate(rules):
        alone = math.prod(1 - chance[j] for j, o in enumerate(rules) if j != i and o.label == r.label)
        ok, cover = s["ok"].get(i, 0), s["cover"].get(i, 0)
        terms = [-1, -len(r.conditions), -same[i], -cross[i], alone, ok - cover, ok]
        out.append(sum(w * t for w, t in zip(lambdas, terms, strict=True)))
    return out


def ids_statistics(points: DataFrame, rules: RuleSet) -> dict:
    """What the objective needs: n, lengths, labels, cover, correct cover and
    pairwise overlap of rules."""
    spark = points.sparkSession
    hits = data_to_rules(points, rules).join(points.select("id", "label"), "id")
    per = hits.join(rules_to_clusters(spark, rules), "rule_id").groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("cluster")).alias("ok")).collect()
    a = hits.select("id", F.col("rule_id").alias("i"))
    b = hits.select("id", F.col("rule_id").alias("j"))
    pairs = a.join(b, "id").filter("i < j").groupBy("i", "j").count().collect()
    return {"n": points.count(), "rules": list(rules), "cover": {r["rule_id"]: r["n"] for r in per}, "ok": {r["rule_id"]: r["ok"] for r in per}, "pairs": {(r["i"], r["j"]): r["count"] for r in pairs}, "labels": {r.label for r in rules}}


def ids_objective(s: dict, chosen: set[int], lambdas: Sequence[float]) -> float:
    """Seven terms, each larger the better: few rules, short rules, little
    overlap inside a class and between classes, classes covered, little cover
    that is wrong, and much that is right."""
    n, rules, every = s["n"], s["rules"], len(s["rules"])
    longest = max((len(r.conditions) for r in rules), default=0)
    same = sum(c for (i, j), c in s["pairs"].items() if i in chosen and j in chosen and rules[i].label == rules[j].label)
    cross = sum(c for (i, j), c in s["pairs"].items() if i in chosen and j in chosen and rules[i].label != rules[j].label)
    terms = [
        every - len(chosen), longest * every - sum(len(rules[i].conditions) for i in chosen), n * every * every - same, n * every * every - cross,
        len({rules[i].label for i in chosen}), n * every - sum(s["cover"].get(i, 0) - s["ok"].get(i, 0) for i in chosen), sum(s["ok"].get(i, 0) for i in chosen),
    ]
    return sum(w * t for w, t in zip(lambdas, terms, strict=True))
