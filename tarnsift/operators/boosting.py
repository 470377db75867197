"""Gradient boosting as grouped sums: histograms of gradients by (model, class, node, feature, bin).

Features are cut into quantile bins once, and rows that are equal in bins, label and weight go on as one with their number in
each round's draw. These cells are dealt to partitions as arrays that Spark caches, as many as their number asks for. A level
of a tree is one job: every cell adds its first and second derivative of the loss to the bins of its node, a partition's
sums are shuffled by node, and each node's best cut is found by second-order gain. Only the chosen cuts reach the driver,
so what it holds is the size of the model. The shards of an ensemble, and all classes of a softmax, grow their trees in the
same jobs.
"""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsift.operators.primitives import hash_unit
from tarnsift.operators.quantiles import exact_quantiles
from tarnsift.sources.shared import discard, stored

#: Rounds whose draws are counted in one pass over the rows; then margins are written, so that lineage holds no more rounds.
AT_ONCE = 8
#: Cells of a partition, about: what one task adds up in a level.
CELLS = 1 << 16


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.2
    min_child_weight: float = 500.0
    subsample: float = 0.2
    columns: float = 0.9
    l2: float = 1.0
    l1: float = 1.0
    max_step: float = 1.0
    bins: int = 64
    patience: int = 10
    seed: int = 42


@dataclass
class Boosted:
    """trees[m][r][k]: a tree as lists by node (root 0, children 2n + 1 and 2n + 2): feature (-1: leaf), bin and value of the cut, and
    what a leaf adds to the margin of class k."""

    cols: list[str]
    edges: list[list[float]]
    models: list
    classes: list | None
    base: list[list[float]]
    settings: Settings
    trees: list = field(default_factory=list)


def constant(values: list, kind: str) -> Column:
    """A list as one constant array: a text that is split and cast while the plan is made, however long the list is."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _counter(edges: list[list[float]]):
    """A function from columns of doubles to a matrix: per feature how many edges lie under the value; null and NaN stand before all."""
    ends = [np.array(e, dtype=float) for e in edges]

    def bins(values):
        out = np.empty((len(values[0]), len(values)), dtype=np.int32)
        for i, (v, e) in enumerate(zip(values, ends)):
            x = v.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
            out[:, i] = np.where(np.isnan(x), -1, np.searchsorted(e, x, side="left"))
        return out

    return bins


def _walker(fitted: Boosted):
    """A function from bins (a matrix) and model numbers to margins (a matrix by class): the base and then each round's leaf."""
    depth, base = fitted.settings.depth, np.array(fitted.base, dtype=float)
    models = [[[(np.array(t["feature"]), np.array(t["bin"]), np.array(t["value"])) for t in per] for per in rounds] for rounds in fitted.trees]

    def walk(x, model):
        out = base[model]
        for i, rounds in enumerate(models):
            at = np.flatnonzero(model == i)
            mine = x[at]
            rows = np.arange(len(at))
            for per in rounds if len(at) else []:
                for k, (feature, cut, value) in enumerate(per):
                    node = np.zeros(len(at), dtype=np.int64)
                    for _ in range(depth):
                        f = feature[node]
                        node = np.where(f < 0, node, 2 * node + 1 + (mine[rows, f] > cut[node]))
                    out[at, k] += value[node]
        return out

    return walk


def _lists(matrix) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def _bins(cols: list[str], edges: list[list[float]]) -> Column:
    bins, lists = _counter(edges), _lists

    @F.arrow_udf("array<int>")
    def binned(*values: pa.Array) -> pa.Array:
        return lists(bins(values))

    return binned(*[F.col(c).cast("double") for c in cols])


def _step(g: float, h: float, s: Settings) -> float:
    w = -((g > 0) - (g < 0)) * max(abs(g) - s.l1, 0.0) / (h + s.l2) if h + s.l2 > 0 else 0.0
    return s.rate * (max(-s.max_step, min(s.max_step, w)) if s.max_step > 0 else w)


def _prepared(df: DataFrame, fitted: Boosted, label: str, key: list[str], model: str | None, positive: dict) -> DataFrame:
    """model (its number), y, w, u (draws rows), x (bins)."""
    number = lambda values, c: F.array_position(F.array(*[F.lit(str(v)) for v in values]).cast("array<string>"), c.cast("string")).cast("int") - 1
    which = number(fitted.models, F.col(model)) if model else F.lit(0)
    y = number(fitted.classes, F.col(label)) if fitted.classes else F.col(label).cast("int")
    weights = [float(positive.get(i, 1.0)) for i in range(len(fitted.models))]
    rows = df.select(which.alias("model"), y.alias("y"), (hash_unit(*key, seed=fitted.settings.seed) * float(1 << 32)).cast("long").alias("u"), _bins(fitted.cols, fitted.edges).alias("x"))
    rows = rows.where((F.col("model") >= 0) & F.col("y").isNotNull() & (F.col("y") >= 0))
    w = F.lit(1.0) if fitted.classes else F.when(F.col("y") == 1, F.get(constant(weights, "double"), F.col("model"))).otherwise(1.0)
    return rows.select("model", "y", w.alias("w"), "u", "x")


def _cells(rows: DataFrame, fitted: Boosted, counts: list[Column], name: str) -> DataFrame:
    """model, y, w, x, m (margins), n0, n1, ...: rows of equal model, label, weight and bins as one, with the numbers of rows for which
    each of counts holds; stored."""
    walk, lists, width = _walker(fitted), _lists, len(fitted.cols)

    @F.arrow_udf("array<double>")
    def margin(model: pa.Array, x: pa.Array) -> pa.Array:
        return lists(walk(x.flatten().to_numpy().reshape(-1, width), model.to_numpy()))

    held = rows.groupBy("model", "y", "w", "x").agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(counts)])
    some = " or ".join(f"n{i} > 0" for i in range(len(counts)))
    return stored(held.where(some).withColumn("m", margin("model", "x")), name)


# Workers hold no copy of this package, so what is pickled there is a SimpleNamespace. A block of cells: model, y, w, x (bins, a row
# for each cell), m (margins by class), n (rows in each counted draw). A level: feature and bin by model, class and node of a
# round's trees, how deep they are; to look for cuts also the place of each open node (-1 for the others), how many there are,
# the bins of a feature, the number of the draw, the features that each place may be cut by and the settings.


def _field(trees: list, name: str) -> np.ndarray:
    return np.array([[t[name] for t in per] for per in trees])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            c = dict(zip(b.schema.names, b.columns))
            wide = {name: c.pop(name).flatten().to_numpy().reshape(b.num_rows, -1) for name in ("x", "m")}
            one = {name: c.pop(name).to_numpy() for name in ("model", "y", "w")}
            block = SimpleNamespace(**one, **wide, n=np.stack([v.to_numpy() for v in c.values()], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])


class _State:
    """Cells in packed blocks, cached, whose margins follow the trees. `rewrite` stores them, which cuts their lineage."""

    def __init__(self, cells: DataFrame):
        self.parts = max(1, -(-cells.count() // CELLS))
        self._load(cells.repartition(self.parts).mapInArrow(_blocks, "block binary"))

    def _load(self, packed: DataFrame) -> None:
        self.packed, self.before = packed, None
        few = packed.coalesce(self.parts)  # a stored table may be read in more splits than it has blocks
        self.blocks = few.rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def add(self, trees: list, depth: int) -> None:
        """Margins after one more tree for each class. Those before stay cached until the next tree, when these have been read."""
        if self.before is not None:
            self.before.unpersist()
        grow = partial(_grown, level=SimpleNamespace(feature=_field(trees, "feature"), bin=_field(trees, "bin"), depth=depth), value=_field(trees, "value"))
        self.before, self.blocks = self.blocks, self.blocks.map(grow).persist(StorageLevel.MEMORY_AND_DISK)

    def rewrite(self) -> None:
        packed = self.blocks.map(lambda b: (pickle.dumps(b),))
        packed = stored(self.packed.sparkSession.createDataFrame(packed, "block binary"), "blocks", self.packed)
        self._unpersist()
        self._load(packed)

    def _unpersist(self) -> None:
        for blocks in (self.before, self.blocks):
            if blocks is not None:
                blocks.unpersist()

    def drop(self) -> None:
        self._unpersist()
        discard(self.packed)


def _nodes(b: SimpleNamespace, k: int, level: SimpleNamespace) -> np.ndarray:
    """The node of class k's tree that each cell stands in."""
    node, rows = np.zeros(len(b.x), dtype=np.int64), np.arange(len(b.x))
    for _ in range(level.depth):
        f = level.feature[b.model, k, node]
        node = np.where(f < 0, node, 2 * node + 1 + (b.x[rows, f] > level.bin[b.model, k, node]))
    return node


def _derivatives(b: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """For each class the first and second derivative at the margins, by the weight."""
    w = b.w[:, None]
    if b.m.shape[1] == 1:
        p = 1 / (1 + np.exp(-b.m))
        return w * (p - b.y[:, None]), w * p * (1 - p)
    p = np.exp(b.m - b.m.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return w * (p - (b.y[:, None] == np.arange(b.m.shape[1]))), w * 2 * p * (1 - p)


def _sums(blocks: Iterable[SimpleNamespace], level: SimpleNamespace) -> Iterator[tuple[int, np.ndarray]]:
    """For each open node that cells stand in its place and the sums of both derivatives by feature and bin."""
    total, met = None, np.zeros(level.places, dtype=bool)
    for b in blocks:
        n, (g, h) = b.n[:, level.draw], _derivatives(b)
        total = np.zeros((2, b.x.shape[1], level.places * level.bins)) if total is None else total
        for k in range(b.m.shape[1]):
            place = level.place[b.model, k, _nodes(b, k, level)]
            at = np.flatnonzero((place >= 0) & (n > 0))
            place, times = place[at], n[at]
            met[place] = True
            for f in range(b.x.shape[1]):
                cell = place * level.bins + b.x[at, f] + 1  # nulls are bin -1
                for i, d in enumerate((g, h)):
                    total[i, f] += np.bincount(cell, d[at, k] * times, minlength=total.shape[2])
    for p in np.flatnonzero(met):
        yield int(p), total.reshape(2, total.shape[1], level.places, level.bins)[:, :, p]


def _weight(g, h, s: Settings):
    """The best step of a node, shrunk by l1, at most max_step."""
    d = h + s.l2
    w = np.where(d > 0, -np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0) / np.where(d > 0, d, 1.0), 0.0)
    return np.clip(w, -s.max_step, s.max_step) if s.max_step > 0 else w


def _value(g, h, s: Settings):
    """How much a node's best step lowers the loss, times two."""
    w = _weight(g, h, s)
    return -(2 * g * w + (h + s.l2) * w * w + 2 * s.l1 * np.abs(w))


def best_cut(sums: np.ndarray, allowed: list[int], s: Settings) -> tuple | None:
    """feature, bin, g, h of the node, and of its left side: of a node's sums by feature and bin the cut after a bin with the greatest gain,
    the first on ties; feature, bin and left side are None where no cut gains. Sums are taken to 9 decimals, so that their order
    doesn't decide."""
    upto = np.round(np.cumsum(sums[:, allowed], axis=2), 9)
    (gl, hl), (g, h) = upto, upto[:, :, -1:]
    gain = np.round(_value(gl, hl, s) + _value(g - gl, h - hl, s) - _value(g, h, s), 6)
    gain = np.where((hl >= s.min_child_weight) & (h - hl >= s.min_child_weight) & (gain > 0), gain, 0.0)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    own = (float(g[0, 0]), float(h[0, 0]))
    if not gain[i, j] > 0:
        return None, None, *own, None, None
    return allowed[i], int(j) - 1, float(g[i, 0]), float(h[i, 0]), float(gl[i, j]), float(hl[i, j])


def _cuts(sums: Iterable[tuple[int, np.ndarray]], level: SimpleNamespace) -> Iterator[tuple]:
    for place, own in sums:
        yield place, *best_cut(own, level.allowed[place], level.settings)


def _grown(b: SimpleNamespace, level: SimpleNamespace, value: np.ndarray) -> SimpleNamespace:
    """The cells with the margins after one more tree for each class."""
    added = np.stack([value[b.model, k, _nodes(b, k, level)] for k in range(b.m.shape[1])], axis=1)
    return SimpleNamespace(**vars(b) | {"m": b.m + added})


def _losses(blocks: Iterable[SimpleNamespace], models: int) -> Iterator[np.ndarray]:
    """By model the sum of the log loss, without weights, and the number of rows."""
    for b in blocks:
        if b.m.shape[1] == 1:
            m = b.m[:, 0]
            loss = np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0.0) - m * b.y
        else:
            top = b.m.max(axis=1)
            loss = np.log(np.exp(b.m - top[:, None]).sum(axis=1)) + top - b.m[np.arange(len(b.y)), b.y]
        yield np.stack([np.bincount(b.model, v * b.n[:, 0], minlength=models) for v in (loss, np.ones(len(loss)))])


def fit(train: DataFrame, cols: list[str], label: str, key: list[str], settings: Settings = Settings(), classes: list | None = None, model: str | None = None, models: list | None = None, val: DataFrame | None = None, weigh: bool = True) -> Boosted:
    """Boosted trees, one model for each value of the column `model` (few; null ones take no part), all trained in the same jobs.

    Without classes the label is 0 or 1, positives weigh negatives / positives of their model (unless weigh is false) and
    margins start at the base rate; with classes it is one of them, by softmax. Rows without a label, or of another class,
    take no part. Nulls and NaN stand before all values of a feature. Each tree sees the rows whose hash of `key` falls
    under `subsample` for its round and a share `columns` of the features. With val, a model whose log loss there
    hasn't fallen for `patience` rounds stops, and keeps the trees up to its best round. No rows give a model without trees.
    """
    models = models if models is not None else [r[0] for r in train.select(model).where(F.col(model).isNotNull()).distinct().orderBy(model).collect()] if model else [None]
    k = len(classes) if classes else 1
    found = {r["column"]: r["values"] for r in exact_quantiles(train, cols, [i / settings.bins for i in range(1, settings.bins)]).collect()}
    edges = [sorted({float(x) for x in found.get(c, [])}) for c in cols]
    fitted = Boosted(cols, edges, models, classes, [[0.0] * k for _ in models], settings, [[] for _ in models])
    positive: dict[int, float] = {}
    if not classes:
        which = F.array_position(F.array(*[F.lit(str(v)) for v in models]), F.col(model).cast("string")).cast("int") - 1 if model else F.lit(0)
        for r in train.groupBy(which.alias("m")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).collect():
            if r["m"] is not None and r["m"] >= 0 and r["p"] and r["n"]:
                fitted.base[r["m"]] = [math.log(r["p"] / r["n"])]
                positive[r["m"]] = r["n"] / r["p"] if weigh else 1.0
    rows = _prepared(train, fitted, label, key, model, positive)
    drawing = settings.subsample < 1
    rows = stored(rows, "boosting") if drawing and settings.rounds > AT_ONCE else rows
    held = _State(_cells(_prepared(val, fitted, label, key, model, {}), fitted, [F.lit(True)], "held_out")) if val is not None else None
    state = None
    best = {i: (float("inf"), 0) for i in range(len(models))}
    going = set(range(len(models)))
    for r in range(settings.rounds):
        if state is None or drawing and r % AT_ONCE == 0:
            draws = [hash_unit("u", F.lit(i), seed=settings.seed) < settings.subsample for i in range(r, min(r + AT_ONCE, settings.rounds))] if drawing else [F.lit(True)]
            if state is not None:
                state.drop()
            state = _State(_cells(rows, fitted, draws, "cells"))
        trees = _grow(state.blocks, fitted, k, r, r % AT_ONCE if drawing else 0, going)
        for i in range(len(models)):
            fitted.trees[i].append(trees[i])
        state.add(trees, settings.depth)
        if held is not None:
            held.add(trees, settings.depth)
            loss, n = sum(held.blocks.mapPartitions(partial(_losses, models=len(models))).collect(), np.zeros((2, len(models))))
            for i in [int(i) for i in np.flatnonzero(n)]:
                if i in going and loss[i] / n[i] < best[i][0]:
                    best[i] = (float(loss[i] / n[i]), r + 1)
                elif r + 1 - best[i][1] >= settings.patience:
                    going.discard(i)
        if not going:
            break
        if r % AT_ONCE == AT_ONCE - 1 and r + 1 < settings.rounds:
            for kept in [held] if drawing else [state, held]:
                if kept is not None:
                    kept.rewrite()
    for kept in (state, held):
        if kept is not None:
            kept.drop()
    if held is not None:
        fitted.trees = [t[: best[i][1]] for i, t in enumerate(fitted.trees)]
    return fitted


def _grow(blocks: RDD, fitted: Boosted, k: int, r: int, draw: int, going: set[int]) -> list:
    """One tree for each model that still learns and each class, level by level; a bare root that adds nothing for the others."""
    s = fitted.settings
    size = 2 ** (s.depth + 1) - 1
    bare = lambda: {"feature": [-1] * size, "bin": [0] * size, "cut": [0.0] * size, "value": [0.0] * size}
    trees = [[bare() for _ in range(k)] for _ in fitted.models]
    open_nodes = [(i, j, 0) for i in sorted(going) for j in range(k)]
    seen = max(1, round(s.columns * len(fitted.cols)))
    allowed = [sorted(random.Random(f"{s.seed}-{r}-{i}").sample(range(len(fitted.cols)), seen)) for i in range(len(fitted.models))]
    for depth in range(s.depth):
        if not open_nodes:
            break
        place = np.full((len(fitted.models), k, size), -1)
        for p, at in enumerate(open_nodes):
            place[at] = p
        level = SimpleNamespace(feature=_field(trees, "feature"), bin=_field(trees, "bin"), depth=depth, place=place, places=len(open_nodes), bins=max(map(len, fitted.edges)) + 2, draw=draw, allowed=[allowed[i] for i, _, _ in open_nodes], settings=SimpleNamespace(**vars(s)))
        sums = blocks.mapPartitions(partial(_sums, level=level))
        if blocks.getNumPartitions() > 1:
            sums = sums.reduceByKey(np.add, min(blocks.getNumPartitions(), len(open_nodes)), int)
        met, open_nodes = open_nodes, []
        for p, f, b, g, h, gl, hl in sorted(sums.mapPartitions(partial(_cuts, level=level)).collect(), key=lambda c: c[0]):  # one for each open node
            i, j, n = met[p]
            tree = trees[i][j]
            if f is None:
                tree["value"][n] = _step(g, h, s)
                continue
            edges = fitted.edges[f]
            tree["feature"][n], tree["bin"][n], tree["cut"][n] = f, b, edges[b] if 0 <= b < len(edges) else float("-inf")
            for child, gc, hc in ((2 * n + 1, gl, hl), (2 * n + 2, g - gl, h - hl)):
                tree["value"][child] = _step(gc, hc, s)
                open_nodes.append((i, j, child))
    return trees


def margins(df: DataFrame, fitted: Boosted, which: int = 0, out: str = "_m") -> DataFrame:
    """df with the margins of one model, an array by class."""
    bins, walk, lists = _counter(fitted.edges), _walker(fitted), _lists

    @F.arrow_udf("array<double>")
    def margin(*values: pa.Array) -> pa.Array:
        x = bins(values)
        return lists(walk(x, np.full(len(x), which)))

    return df.withColumn(out, margin(*[F.col(c).cast("double") for c in fitted.cols]))


def trees_table(df: DataFrame, fitted: Boosted) -> DataFrame:
    """model, round, class, node, feature, cut, value of all nodes that rows reach: a cut sends greater values to the right."""
    rows = []
    for m, rounds in zip(fitted.models, fitted.trees):
        for r, per in enumerate(rounds):
            for j, t in enumerate(per):
                reach = [0]
                while reach:
                    n = reach.pop()
                    inner = t["feature"][n] >= 0
                    rows.append((None if m is None else str(m), r, str(fitted.classes[j]) if fitted.classes else None, n, fitted.cols[t["feature"][n]] if inner else None, t["cut"][n] if inner else None, None if inner else t["value"][n]))
                    reach += [2 * n + 1, 2 * n + 2] if inner else []
    return df.sparkSession.createDataFrame(rows, "model string, round int, class string, node int, feature string, cut double, value double")
