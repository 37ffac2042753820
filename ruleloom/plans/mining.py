"""Rule miners: class association rules and boxes around points."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import bin_of, entropy_cuts
from ..model import Condition, Rule, RuleSet
from ..operators.boxes import Blocks, Sorted, blocks_of, kind_of, meet
from ..operators.graphs import cut
from ..operators.ranking import placed


#: Points within reach of seeds that are looked at together.
WITHIN = 500_000


class RuleMiner(ABC):
    """fit(points) gives rules; points are (id, label, features...)."""

    @abstractmethod
    def fit(self, points: DataFrame) -> RuleSet: ...


@dataclass(frozen=True)
class Car:
    """A class association rule: items (feature, lower, upper], and its figures."""

    items: tuple[tuple[str, float, float], ...]
    label: int
    support: float
    confidence: float

    def rule(self) -> Rule:
        return Rule(tuple(c for f, a, z in self.items for c in (Condition.axis(f, a, 1), Condition.axis(f, z, -1))), self.label)


def _share(x: float, name: str) -> float:
    if not isinstance(x, float) or not 0 <= x <= 1:
        raise ValueError(f"{name} is a float from 0 to 1")
    return x


@dataclass
class ClassAssociationMiner(RuleMiner):
    """Level-wise search over binned features. Points are first counted by their
    bins and label: levels work on these counts, whose number is bounded by the
    bins, not by the points."""

    features: Sequence[str]
    min_support: float = 0.1
    min_confidence: float = 0.8
    max_length: int = 2
    ignore: tuple[int, ...] = (-1,)
    cuts: dict[str, list[float]] | None = None

    def __post_init__(self):
        _share(self.min_support, "min_support")
        _share(self.min_confidence, "min_confidence")
        if not isinstance(self.max_length, int) or self.max_length < 1:
            raise ValueError("max_length is a positive int")

    def fit(self, points: DataFrame) -> RuleSet:
        points = points.filter(F.col("label").isNotNull() & ~F.col("label").isin(list(self.ignore)))
        cuts = self.cuts or entropy_cuts(points, self.features, "label")
        self.cars = [self._car(r, cuts) for r in self.table(points, cuts).collect()]
        return RuleSet(tuple(c.rule() for c in self.cars))

    def _car(self, r, cuts) -> Car:
        items = []
        for i in r["items"]:
            f, k = self.features[i // 1000], i % 1000
            edges = [-np.inf, *cuts[f], np.inf]
            items.append((f, float(edges[k]), float(edges[k + 1])))
        return Car(tuple(items), r["label"], r["support"], r["confidence"])

    def table(self, points: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
        """(items, label, support, confidence); an item is 1000 * feature + bin."""
        if any(len(c) > 998 for c in cuts.values()):
            raise ValueError("a feature has over 998 cuts")
        items = F.array(*(F.lit(1000 * k) + bin_of(F.col(f), cuts[f]) for k, f in enumerate(self.features) if cuts[f]))  # a feature without cuts says nothing
        grouped = points.groupBy(items.alias("t"), "label").agg(F.count("*").alias("n")).persist()
        total = grouped.agg(F.sum("n")).first()[0] or 0
        out, frequent = None, None
        for level in range(1, min(self.max_length, len(self.features)) + 1):
            # sets of this level, by adding a later item to a frequent set of the one before
            if level == 1:
                sets = grouped.select("label", "n", F.explode(F.transform("t", lambda i: F.array(i))).alias("items"))
            else:
                known = F.array(*(F.array(*map(F.lit, s)) for s in frequent))
                fits = F.filter(known, lambda s: F.size(F.array_intersect(s, F.col("t"))) == level - 1)
                longer = F.flatten(F.transform(fits, lambda s: F.transform(F.filter("t", lambda i: i > F.element_at(s, -1)), lambda i: F.concat(s, F.array(i)))))
                sets = grouped.select("label", "n", F.explode(longer).alias("items"))
            counts = sets.groupBy("items", "label").agg(F.sum("n").alias("n"))
            whole = counts.groupBy("items").agg(F.sum("n").alias("all"))
            found = counts.join(whole, "items").select("items", "label", (F.col("n") / total).alias("support"), (F.col("n") / F.col("all")).alias("confidence"), "all")
            found = found.filter(F.col("support") >= self.min_support)
            level_rules = found.filter(F.col("confidence") >= self.min_confidence).select("items", "label", "support", "confidence")
            out = level_rules if out is None else out.union(level_rules)
            frequent = sorted({tuple(r["items"]) for r in found.select("items").distinct().collect()})
            if not frequent:
                break
        return out.orderBy(F.desc("confidence"), F.desc("support"), F.size("items"), "items", "label")


@dataclass
class PointwiseMiner(RuleMiner):
    """Grows a random box around each labelled point, in a random number of
    features, until a point of another label would come inside.

    Each side of a box moves by one value at a time. The moments at which it
    moves are those of a Poisson process of its own, so that the next side to
    move is drawn evenly, and a box can be grown against each block of points
    apart: a point comes inside when the last of its features does, and the box
    stops at the least such moment over all blocks. Every point is a seed and
    an obstacle. A box is grown against the block that its seed is in, and then
    against those that it has reached by the moment at which that one stops it;
    no other can stop it earlier. Points inside are counted by whole blocks, and
    one by one in blocks that are partly inside. Points
    without a label or with a null or NaN feature take no part, equal points of
    a label are one obstacle, and a point of another label on the seed itself
    stops nothing. Support and confidence are counted over all points.
    """

    features: Sequence[str]
    samples: int = 10
    prob_dim: float = 0.5
    prob_stop: float = 1.0
    ignore: tuple[int, ...] = (-1,)
    seed: int = 0
    block: int = 4096

    def __post_init__(self):
        _share(self.prob_dim, "prob_dim")
        _share(self.prob_stop, "prob_stop")
        if self.samples < 1:
            raise ValueError("samples is a positive int")

    def fit(self, points: DataFrame) -> RuleSet:
        """Rules in the order of label and bounds; ``cars`` has their figures."""
        found = self.table(points).orderBy("label", "lo", "hi").collect()
        self.cars = []
        for r in found:
            items = tuple((f, a, z) for f, a, z in zip(self.features, r["lo"], r["hi"], strict=True) if np.isfinite(a) or np.isfinite(z))
            if items:
                self.cars.append(Car(items, r["label"], r["support"], r["confidence"]))
        return RuleSet(tuple(c.rule() for c in self.cars)).trimmed()

    def table(self, points: DataFrame) -> DataFrame:
        """(lo, hi, label, n, support, confidence) of each different box; bounds
        (lower, upper] for each feature, infinite where it has none."""
        sound = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in self.features]
        points = points.select("id", "label", *self.features).filter(F.col("label").isNotNull())
        for c in sound:
            points = points.filter(c)
        names, d = list(self.features), len(self.features)
        cells = points.select(F.posexplode(F.array(*(F.col(f).cast("double") for f in names))).alias("feature", "value")).distinct()
        places = cut(placed(cells, "value"))
        ends = {r["feature"]: r["m"] for r in places.groupBy("feature").agg(F.max("place").alias("m")).collect()}
        at = points.select("id", "label", *(F.col(f).cast("double").alias(f) for f in names))
        for k, f in enumerate(names):
            at = at.join(places.filter(F.col("feature") == k).select(F.col("value").alias(f), F.col("place").alias(f"p{k}")), f)
        at = cut(at.select("id", "label", F.array(*(F.col(f"p{k}") for k in range(d))).alias("p")))
        total = at.count()
        last = [ends.get(k, 0) for k in range(d)]
        grow = _Growth(d, self.prob_dim, self.prob_stop, self.seed)
        blocks, rows = blocks_of(at, d, self.block)
        tasks = max(1, min(-(-total * self.samples // 1000), 8 * at.sparkSession.sparkContext.defaultParallelism))
        seeds = at.filter(~F.col("label").isin(list(self.ignore))).repartition(tasks, "id").select(F.xxhash64("id").bitwiseAND(F.lit(2**62 - 1)).alias("key"), "label", "p", F.explode(F.sequence(F.lit(0), F.lit(self.samples - 1))).alias("s"))
        seeds = cut(seeds.mapInPandas(_homes(grow, blocks), "key long, s int, label int, p array<long>, c array<int>, kb long"))
        grown = cut(meet(seeds, rows, ["key", "s"], _grown(grow, blocks, last), "key long, s int, label int, p array<long>, c array<int>, kb long, t double, a array<long>, z array<long>"))
        more = grown.filter("kb >= 0").drop("a", "z")
        stopped = meet(more, rows, ["key", "s"], _stopped(grow, blocks), "key long, s int, label int, p array<long>, t double").groupBy("key", "s", "label", "p").agg(F.min("t").alias("t"))

        def boxes(batches):
            for b in batches:
                made = [grow.box(int(s), int(key), p, t, last) for s, key, p, t in zip(b["s"], b["key"], b["p"], b["t"], strict=True)]
                yield pd.DataFrame({"label": b["label"], "a": [a for a, _ in made], "z": [z for _, z in made]})

        box = "label int, a array<long>, z array<long>"
        found = cut(grown.filter("kb < 0").select("label", "a", "z").union(stopped.mapInPandas(boxes, box)).distinct())
        parts = cut(found.mapInPandas(_whole_blocks(blocks, last), f"{box}, kb long, n long, ok long"))
        counts = parts.filter("kb < 0").drop("kb").union(meet(parts.filter("kb >= 0").drop("n", "ok"), rows, ["label", "a", "z"], _inside(blocks), f"{box}, n long, ok long"))
        counts = counts.groupBy("label", "a", "z").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
        for k in range(d):  # places back to values; -1 and the last place are no bounds
            of = places.filter(F.col("feature") == k)
            counts = counts.withColumns({"_a": F.get("a", F.lit(k)), "_z": F.get("z", F.lit(k))})
            counts = counts.join(of.select(F.col("place").alias("_a"), F.col("value").alias(f"lo{k}")), "_a", "left").join(of.select(F.col("place").alias("_z"), F.col("value").alias(f"hi{k}")), "_z", "left")
            counts = counts.withColumn(f"hi{k}", F.when(F.col("_z") < F.lit(last[k]), F.col(f"hi{k}"))).drop("_a", "_z")
        inf = float("inf")
        lo, hi = (F.array(*(F.coalesce(f"{side}{k}", F.lit(x)) for k in range(d))).alias(side) for side, x in (("lo", -inf), ("hi", inf)))
        return counts.select(lo, hi, "label", "n", (F.col("n") / max(1, total)).alias("support"), (F.col("ok") / F.col("n")).alias("confidence"))


def _homes(grow: _Growth, blocks: Blocks) -> Callable:
    """Adds a seed's chosen features (c) and the block that it is in (kb)."""

    def run(batches):
        for b in batches:
            chosen = [grow.chosen(s, key) for s, key in zip(b["s"].tolist(), b["key"].tolist(), strict=True)]
            kind = np.array([kind_of(c, blocks.d) for c in chosen], int)
            home = np.zeros(len(b), np.int64)
            for k in np.unique(kind).tolist():
                at = kind == k
                home[at] = blocks.home(k, np.stack(b["p"].to_numpy()[at])[:, blocks.axes(k)])
            yield pd.DataFrame({"key": b["key"], "s": b["s"], "label": b["label"], "p": b["p"], "c": chosen, "kb": home})

    return run


def _block(blocks: Blocks, kind: int, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of a block's rows, 0 in features that it does not have, their
    labels and numbers, in the order of the feature that spreads most."""
    axes = blocks.axes(kind)
    own = np.stack(right["p"])
    x = np.zeros((len(own), blocks.d), np.int64)
    x[:, axes] = own
    along = axes[int((own.max(0) - own.min(0)).argmax())]
    order = np.argsort(x[:, along], kind="stable")
    return x[order], right["label"].to_numpy()[order], right["n"].to_numpy()[order], along


def _stops(grow: _Growth, blocks: Blocks, left: pd.DataFrame, right: pd.DataFrame):
    """(kind, chosen, seeds, their moments, t) of the seeds that meet a block: when a point of it stops them."""
    kind = kind_of(left["c"].iloc[0].tolist(), blocks.d)
    x, y, _, along = _block(blocks, kind, right)
    for label, seeds in left.groupby("label"):
        others = Sorted(x[y != label], along)
        for c, alike in seeds.groupby(seeds["c"].map(lambda v: tuple(v.tolist()))):
            for k in range(0, len(alike), 1024):
                part = alike.iloc[k : k + 1024]
                yield kind, list(c), part, *grow.stops(part["s"].tolist(), part["key"].tolist(), np.stack(part["p"]), others, list(c))


def _grown(grow: _Growth, blocks: Blocks, last: Sequence[int]) -> Callable:
    """Boxes of the seeds of a block; a row for each other block that may stop one earlier (kb, else -1)."""

    def run(left, right):
        out = []
        for kind, chosen, seeds, draws, t in _stops(grow, blocks, left, right) if len(left) else ():
            until = t.copy()
            for i in np.flatnonzero(np.isinf(t)).tolist():
                until[i] = _bound(grow, blocks, kind, chosen, seeds["p"].iloc[i], seeds["label"].iloc[i], draws[i])
            a, z = grow.boxes(seeds["s"].tolist(), seeds["key"].tolist(), np.stack(seeds["p"]), until, last, chosen, draws)
            others = blocks.n[kind] > blocks.labelled(kind, seeds["label"].iloc[0])
            near = blocks.met(kind, a, z)[0] & others & (blocks.names[kind] != seeds["kb"].iloc[0])
            whole = ~near.any(axis=1)
            done = seeds[whole].assign(p=None, c=None, kb=-1, t=t[whole], a=list(a[whole]), z=list(z[whole]))
            row, block = np.nonzero(near)
            out += [done, seeds.iloc[row].assign(kb=blocks.names[kind][block], t=t[row], a=None, z=None)]
        columns = ["key", "s", "label", "p", "c", "kb", "t", "a", "z"]
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    return run


def _bound(grow: _Growth, blocks: Blocks, kind: int, chosen: list[int], p: np.ndarray, label: int, draws: Callable) -> float:
    """A moment just after one at which some block is inside that stops the box, if one does for sure."""
    if grow.prob_stop < 1:
        return np.inf
    at = [blocks.axes(kind).index(k) for k in chosen]
    p, lo, hi = p[chosen], blocks.lo[kind][:, at], blocks.hi[kind][:, at]
    apart = ((lo > p) | (hi < p)).any(axis=1) & (blocks.n[kind] > blocks.labelled(kind, label))
    if not apart.any():
        return np.inf
    far = np.where(apart, np.maximum(p - lo, hi - p).max(axis=1), np.iinfo(np.int64).max)
    b = int(far.argmin())
    moments = [0.0]
    for k, low, high, own in zip(chosen, lo[b].tolist(), hi[b].tolist(), p.tolist(), strict=True):
        for side, n in ((0, own - low), (1, high - own)):
            moments += [float(draws(k, side, n)[n - 1])] if n > 0 else []
    return float(np.nextafter(max(moments), np.inf))


def _stopped(grow: _Growth, blocks: Blocks) -> Callable:
    def run(left, right):
        out = [seeds.assign(t=np.minimum(t, seeds["t"])) for _, _, seeds, _, t in _stops(grow, blocks, left, right)] if len(left) else []
        columns = ["key", "s", "label", "p", "t"]
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    return run


def _whole_blocks(blocks: Blocks, last: Sequence[int]) -> Callable:
    """The points of a box in blocks that are inside (kb -1), and a row for each block that is partly so."""

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256].reset_index(drop=True)
                a, z = np.stack(part["a"]), np.stack(part["z"])
                bounded = (a > -1) | (z < np.asarray(last))
                kind = np.where(bounded.sum(1) == 1, bounded.argmax(1), blocks.d if blocks.d > 1 else 0)
                for one in np.unique(kind).tolist():
                    at = np.flatnonzero(kind == one)
                    some, every = blocks.met(one, a[at], z[at])
                    right = np.stack([blocks.labelled(one, y) for y in part["label"].to_numpy()[at].tolist()])
                    row, block = np.nonzero(some & ~every)
                    which = np.concatenate([at, at[row]])
                    n, ok = (np.concatenate([(v * every).sum(1), np.zeros(len(row), np.int64)]) for v in (blocks.n[one], right))
                    yield pd.DataFrame({**part.iloc[which].to_dict("list"), "kb": np.concatenate([np.full(len(at), -1), blocks.names[one][block]]), "n": n, "ok": ok})

    return run


def _inside(blocks: Blocks) -> Callable:
    """Counts the points of a block that are in each box."""

    def run(left, right):
        if not len(left):
            return pd.DataFrame({c: [] for c in ("label", "a", "z", "n", "ok")})
        kb = left["kb"].iloc[0]
        kind = next(k for k, names in blocks.names.items() if kb in names)
        x, y, n, along = _block(blocks, kind, right)
        a, z, label = np.stack(left["a"]), np.stack(left["z"]), left["label"].to_numpy()
        start, end = (np.searchsorted(x[:, along], side[:, along], "right") for side in (a, z))
        right_n = {k: np.where(y == k, n, 0) for k in np.unique(label).tolist()}
        rest = [k for k in blocks.axes(kind) if k != along]
        got, ok = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        if rest:
            columns = [(np.ascontiguousarray(x[:, k]), a[:, k].tolist(), z[:, k].tolist()) for k in rest]
            for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                hit = None
                for v, low, high in columns:
                    one = (v[s:e] > low[i]) & (v[s:e] <= high[i])
                    hit = one if hit is None else hit & one
                got[i], ok[i] = n[s:e] @ hit, right_n[label[i]][s:e] @ hit
        else:
            upto = np.concatenate([[0], np.cumsum(n)])
            got = upto[end] - upto[start]
            for k, v in right_n.items():
                upto, of = np.concatenate([[0], np.cumsum(v)]), label == k
                ok[of] = upto[end[of]] - upto[start[of]]
        return pd.DataFrame({"label": label, "a": left["a"], "z": left["z"], "n": got, "ok": ok})

    return run


def _generator(*words: int) -> np.random.Generator:
    """default_rng of a list of numbers, in the words that numpy makes of them."""
    out = []
    for w in words:
        out.append(w & 0xFFFFFFFF)
        while w := w >> 32:
            out.append(w & 0xFFFFFFFF)
    return np.random.default_rng(np.array(out, np.uint32))


@dataclass(frozen=True)
class _Growth:
    """The random draws of a box, the same wherever they are made."""

    d: int
    prob_dim: float
    prob_stop: float
    seed: int

    def chosen(self, s: int, key: int) -> np.ndarray:
        rng = _generator(self.seed, s, key)
        m = min(self.d, int(rng.geometric(self.prob_dim)) if self.prob_dim > 0 else self.d)
        return np.sort(rng.choice(self.d, m, replace=False)) if m < self.d else np.arange(self.d)

    def moves(self, s: int, key: int, k: int, side: int, n: int) -> np.ndarray:
        """Moments of a side's first n moves."""
        return np.cumsum(_generator(self.seed, s, key, k, side).standard_exponential(n))

    def draws(self, s: int, key: int) -> Callable:
        """moves of a box, (k, side, n), each side drawn again only for more than it has."""
        had: dict = {}

        def of(k: int, side: int, n: int) -> np.ndarray:
            got = had.get((k, side))
            if got is None or len(got) < n:
                got = had[k, side] = self.moves(s, key, k, side, max(64, n))
            return got[:n]

        return of

    def stop(self, s: int, key: int, p: np.ndarray, others: np.ndarray | Sorted, reach: int = 64, chosen: Sequence[int] | None = None, draws: Callable | None = None) -> float:
        """The first moment at which one of the others stops the box."""
        chosen = self.chosen(s, key).tolist() if chosen is None else chosen
        draws = draws or self.draws(s, key)
        others = others if isinstance(others, Sorted) else Sorted(others, 0)
        furthest = int(others.furthest(p[None], chosen)[0])
        while furthest:
            reach = min(reach, furthest)
            (start,), (end,) = others.slices(p[None], reach, chosen)
            step = others.x[start:end][:, chosen] - p[chosen]
            steps = np.abs(step)
            top = steps.max(axis=1)
            near = (top <= reach) & (top > 0)
            steps, up = steps[near], step[near] > 0
            moments = {(k, side): np.concatenate([[0.0], draws(k, side, reach)]) for k in chosen for side in (0, 1)}
            each = np.stack([np.where(up[:, i], moments[k, 1][steps[:, i]], moments[k, 0][steps[:, i]]) for i, k in enumerate(chosen)], axis=1)
            t = each.max(axis=1)
            if self.prob_stop < 1 and len(t):
                by = each.argmax(axis=1)
                coins = {(k, side): _generator(self.seed, s, key, k, side, 1).random(reach) for k in chosen for side in (0, 1)}
                t = t[[coins[chosen[i], int(up[q, i])][steps[q, i] - 1] < self.prob_stop for q, i in enumerate(by)]]
            first = float(t.min(initial=np.inf))
            if reach == furthest or first <= min(m[-1] for m in moments.values()):
                return first
            reach *= 4
        return float("inf")

    def stops(self, s: list[int], key: list[int], p: np.ndarray, others: Sorted, chosen: list[int]) -> tuple[list[Callable], np.ndarray]:
        """draws and stop of seeds with the same chosen features, whose points
        within reach are looked at together."""
        draws = [self.draws(*of) for of in zip(s, key, strict=True)]
        if self.prob_stop < 1:
            return draws, np.array([self.stop(a, k, at, others, 16, chosen, of) for a, k, at, of in zip(s, key, p, draws, strict=True)], float)
        t, furthest = np.full(len(p), np.inf), others.furthest(p, chosen)
        todo, reach = np.flatnonzero(furthest), 16
        while len(todo):
            n = min(reach, int(furthest[todo].max()))
            start, end = others.slices(p[todo], n, chosen)
            step = max(1, WITHIN // max(1, int((end - start).max())))
            later = [todo[:0]]
            for k in range(0, len(todo), step):
                part, many = todo[k : k + step], (end - start)[k : k + step]
                moments = np.zeros((len(part), len(chosen), 2, n + 1))
                for i, row in enumerate(part.tolist()):
                    for f, c in enumerate(chosen):
                        moments[i, f, 0, 1:], moments[i, f, 1, 1:] = draws[row](c, 0, n), draws[row](c, 1, n)
                seed = np.repeat(np.arange(len(part)), many)
                at = np.arange(len(seed)) + np.repeat(start[k : k + step] - np.cumsum(many) + many, many)
                away = [others.x[at, c] - p[part[seed], c] for c in chosen]
                top = np.abs(away[0])
                for one in away[1:]:
                    top = np.maximum(top, np.abs(one))
                near = np.flatnonzero((top <= n) & (top > 0))
                seed, first = seed[near], np.full(len(part), np.inf)
                if len(near):
                    each = [moments[seed, f, (one[near] > 0).astype(int), np.abs(one[near])] for f, one in enumerate(away)]
                    begin = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
                    first[seed[begin]] = np.minimum.reduceat(np.maximum.reduce(each), begin)
                t[part] = first
                later.append(part[(n < furthest[part]) & ~(first <= moments[..., -1].min((1, 2)))])
            todo, reach = np.concatenate(later), 4 * reach
        return draws, t

    def boxes(self, s: list[int], key: list[int], p: np.ndarray, t: np.ndarray, last: Sequence[int], chosen: list[int], draws: list[Callable]) -> tuple[np.ndarray, np.ndarray]:
        """Places (lower, upper] of boxes that stop at moments t."""
        a, z = np.full(p.shape, -1, np.int64), np.repeat(np.array(last, np.int64)[None], len(p), 0)
        for i, of in enumerate(zip(s, key, p, t.tolist(), strict=True)):
            a[i], z[i] = self.box(*of, last, chosen, draws[i])
        return a, z

    def box(self, s: int, key: int, p: np.ndarray, t: float, last: Sequence[int], chosen: Sequence[int] | None = None, draws: Callable | None = None) -> tuple[list[int], list[int]]:
        """Places (lower, upper] of a box that stops at moment t."""
        lower, upper = [-1] * self.d, list(last)
        draws = draws or self.draws(s, key)
        for k in self.chosen(s, key).tolist() if chosen is None else chosen:
            room = (int(p[k]), int(last[k] - p[k]))
            down, up = (n if np.isinf(t) else self._made(draws, k, side, n, t) for side, n in enumerate(room))
            lower[k], upper[k] = int(p[k]) - down - 1, int(p[k]) + up
        return lower, upper

    def _made(self, draws: Callable, k: int, side: int, room: int, t: float) -> int:
        """How many moves a side has made before moment t."""
        n = min(room, 64)
        while n:
            made = int(np.searchsorted(draws(k, side, n), t))
            if made < n or n == room:
                return made
            n = min(room, 4 * n)
        return 0
