"""Conditions, rules and tree nodes: the small state that the driver holds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For unscaling: a feature's (shift, scale), scaled = (x - shift) / scale.
Scaler = dict[str, tuple[float, float]]


@dataclass(frozen=True)
class Condition:
    """sum(weight * feature) <= threshold (direction -1) or > threshold (1)."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    threshold: float
    direction: int

    def __post_init__(self):
        if self.direction not in (-1, 1):
            raise ValueError("a direction is -1 (at most) or 1 (over)")
        if len(self.features) != len(self.weights) or not self.features:
            raise ValueError("each feature needs one weight")

    @classmethod
    def axis(cls, feature: str, threshold: float, direction: int = -1) -> Condition:
        return cls((feature,), (1.0,), float(threshold), direction)

    def turned(self, direction: int) -> Condition:
        return replace(self, direction=direction)

    @property
    def is_axis(self) -> bool:
        return len(self.features) == 1 and self.weights[0] == 1.0

    def column(self) -> Column:
        """For filters and when(): never true where a feature is null or NaN
        (there it may be null). An axis condition is a plain comparison, so
        that it reaches the Parquet scan."""
        if self.is_axis:
            value = F.col(self.features[0])
        else:
            value = reduce(lambda a, b: a + b, (F.lit(w) * F.col(f) for f, w in zip(self.features, self.weights, strict=True)))
        if self.direction < 0:
            return value <= F.lit(self.threshold)  # NaN is over everything for Spark
        return (value > F.lit(self.threshold)) & ~F.isnan(value.cast("double"))

    def evaluate(self) -> Column:
        """True or false for every row."""
        return F.coalesce(self.column(), F.lit(False))

    def sql(self) -> str:
        left = " + ".join(f'"{f}"' if w == 1 else f'{w!r} * "{f}"' for f, w in zip(self.features, self.weights, strict=True))
        return f"({left} {'<=' if self.direction < 0 else '>'} {self.threshold!r})"

    def display(self, names: dict[str, str] | None = None, scaler: Scaler | None = None) -> str:
        """Readable, with thresholds unscaled and rounded to 3 places."""
        names, scaler = names or {}, scaler or {}
        shift = sum(w * scaler[f][0] / scaler[f][1] for f, w in zip(self.features, self.weights, strict=True) if f in scaler)
        weights = [w / scaler[f][1] if f in scaler else w for f, w in zip(self.features, self.weights, strict=True)]
        threshold, direction = self.threshold + shift, self.direction
        if len(weights) == 1 and weights[0] != 0:
            if weights[0] < 0:  # dividing by a negative weight turns the relation
                direction = -direction
            threshold, weights = threshold / weights[0], [1.0]
        left = " + ".join(names.get(f, f) if w == 1 else f"{round(w, 3)} {names.get(f, f)}" for f, w in zip(self.features, weights, strict=True))
        return f"{left} {'≤' if direction < 0 else '>'} {round(threshold, 3)}"


def interval(feature: str, text: str) -> list[Condition]:
    """'(a, b]' as the two conditions > a and <= b."""
    m = re.fullmatch(r"\(\s*(\S+)\s*,\s*(\S+)\s*\]", text)
    if not m:
        raise ValueError(f"not an interval (a, b]: {text!r}")
    return [Condition.axis(feature, float(m[1]), 1), Condition.axis(feature, float(m[2]), -1)]


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions that speaks for a label."""

    conditions: tuple[Condition, ...]
    label: int

    def column(self) -> Column:
        """The conjunction, for filters and when(); see Condition.column."""
        columns = [c.column() for c in self.conditions]
        return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions) or "TRUE"

    def trimmed(self) -> Rule:
        """Without conditions at plus or minus infinity."""
        return replace(self, conditions=tuple(c for c in self.conditions if math.isfinite(c.threshold)))

    def merged(self) -> Rule:
        """One lower and one upper bound for each axis feature."""
        low: dict[str, Condition] = {}
        high: dict[str, Condition] = {}
        other = [c for c in self.conditions if not c.is_axis]
        for c in self.conditions:
            if c.is_axis:
                side = low if c.direction > 0 else high
                best = side.get(c.features[0])
                if best is None or (c.threshold > best.threshold if c.direction > 0 else c.threshold < best.threshold):
                    side[c.features[0]] = c
        return replace(self, conditions=(*low.values(), *high.values(), *other))

    def box(self) -> dict[str, tuple[float, float]]:
        """(lower, upper) bound of each axis feature."""
        out: dict[str, tuple[float, float]] = {}
        for c in self.merged().conditions:
            if c.is_axis:
                a, b = out.get(c.features[0], (-math.inf, math.inf))
                out[c.features[0]] = (c.threshold, b) if c.direction > 0 else (a, c.threshold)
        return out

    def display(self, names: dict[str, str] | None = None, scaler: Scaler | None = None) -> str:
        return f"If {' and '.join(c.display(names, scaler) for c in self.conditions) or 'anything'} then cluster {self.label}"


@dataclass(frozen=True)
class RuleSet:
    """Rules, numbered by their place."""

    rules: tuple[Rule, ...]

    def __iter__(self) -> Iterator[Rule]:
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)

    def trimmed(self) -> RuleSet:
        """Without infinite conditions, and without rules that have none left."""
        return RuleSet(tuple(t for r in self.rules if (t := r.trimmed()).conditions))

    def subset(self, ids: Sequence[int]) -> RuleSet:
        return RuleSet(tuple(self.rules[i] for i in sorted(ids)))

    @property
    def max_length(self) -> int:
        return max((len(r.conditions) for r in self.rules), default=0)

    def report(self, names: dict[str, str] | None = None, scaler: Scaler | None = None) -> str:
        return "\n".join(r.display(names, scaler) for r in sorted(self.rules, key=lambda r: r.label))


@dataclass
class Node:
    """A node of a tree; a leaf has no condition."""

    node_id: int
    label: int | None = None
    depth: int = 0
    condition: Condition | None = None
    left: Node | None = None
    right: Node | None = None
    leaf_num: int | None = None
    size: int = 0
    cost: float = 0.0
    centers: list[int] = field(default_factory=list)

    @property
    def is_leaf(self) -> bool:
        return self.condition is None

    def walk(self) -> Iterator[Node]:
        yield self
        if not self.is_leaf:
            yield from self.left.walk()
            yield from self.right.walk()

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if n.is_leaf]

    def depth_below(self) -> int:
        return max(n.depth for n in self.walk())

    def paths(self, before: tuple[Condition, ...] = ()) -> Iterator[tuple[tuple[Condition, ...], Node]]:
        """Conditions from the root to each leaf, left side first."""
        if self.is_leaf:
            yield before, self
        else:
            yield from self.left.paths((*before, self.condition.turned(-1)))
            yield from self.right.paths((*before, self.condition.turned(1)))

    def rules(self, labels: set[int] | None = None) -> RuleSet:
        return RuleSet(tuple(Rule(p, n.label) for p, n in self.paths() if n.label is not None and (labels is None or n.label in labels)))

    def column(self, value) -> Column:
        """value(leaf) of the leaf that a row falls in: one nested CASE. A row
        with a null or NaN on its way falls in none and gives null."""
        if self.is_leaf:
            return F.lit(value(self))
        return F.when(self.condition.turned(-1).column(), self.left.column(value)).when(self.condition.turned(1).column(), self.right.column(value))

    def to_dot(self) -> str:
        lines = ["digraph tree {"]
        for n in self.walk():
            lines.append(f'  n{n.node_id} [label="{n.condition.display() if n.condition else f"cluster {n.label}"}"];')
            if n.condition:
                lines += [f"  n{n.node_id} -> n{n.left.node_id};", f"  n{n.node_id} -> n{n.right.node_id};"]
        return "\n".join([*lines, "}"])
