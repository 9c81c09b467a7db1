"""Boosted trees with the second-order softmax loss, many models at once.

Rows with equal features, label and fold are one weighted cell, counted by Spark before
anything else.  The search over settings is fitted from at most `MOST_ROWS` labelled rows
(by the hash of the row, and fewer if the rows are very wide); up to there it sees all of
them.  Its cells travel as one broadcast block of that bounded size, every pair of settings
and fold is a task of its own, and models with fewer rounds are prefixes of the longest one.
`fit_all` fits one model from all rows: their features are cut into bins at the quantiles of
all values, and rows with equal bins and label are a cell.  Up to `MOST_ROWS` cells are fitted
in one task, more of them level by level where they are.  All rows are scored where they are.

Trees grow level by level.  A node splits where
    G_l^2 / (H_l + penalty) + G_r^2 / (H_r + penalty) - G^2 / (H + penalty)
is largest, among the borders of the features' bins; equal gains go to the first feature
and the lowest border, and both sides keep a Hessian of at least `least`.  Margins start
at 0.  Two classes have one tree a round, more have one for each class.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import named
from veritab.operators.ranks import running_totals
from veritab.session import importable, stored

#: Bound on the rows of a block that travels to one task, and on rows times features.
MOST_ROWS = 1_000_000
MOST_NUMBERS = 50_000_000
BINS = 256
#: Rounds whose margins are kept in Spark's cache before they are stored and the plan is cut.
KEPT_ROUNDS = 20
SMALLEST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    penalty: float = 1.0
    least: float = 1.0


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1.  Values up to `border` go left."""

    feature: np.ndarray
    border: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The leaf value of every row.  All rows go down together; a leaf leads to itself."""
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        feature, border = np.where(inner, self.feature, 0), np.where(inner, self.border, np.inf)
        follow = np.stack([np.where(inner, self.left, own), np.where(inner, self.right, own)], axis=1)
        flat, start, open_nodes, next_of = x.ravel(), np.arange(len(x)) * x.shape[1], own[:1][inner[:1]], follow.ravel()
        at = np.zeros(len(x), np.int64)
        while len(open_nodes):
            low = flat[start + feature[at]] <= border[at]
            at = next_of[2 * at + ~low]
            open_nodes = follow[open_nodes].ravel()
            open_nodes = open_nodes[inner[open_nodes]]
        return self.value[at]


def _quantiles(each: np.ndarray, share: np.ndarray, bins: int) -> np.ndarray:
    """The first of the sorted values that reaches each share."""
    return each[np.unique(np.searchsorted(share, np.arange(1, bins + 1) / bins - 1e-12).clip(0, len(each) - 1))]


def bin_borders(values: np.ndarray, weight: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper borders of the bins of a feature, halfway between values; weighted quantiles where there are too many values."""
    each, where = np.unique(values, return_inverse=True)
    if len(each) > bins:
        each = _quantiles(each, np.cumsum(np.bincount(where, weight)) / weight.sum(), bins)
    return (each[:-1] + each[1:]) / 2


class Splits:
    """The best split of each open node among the features tried so far."""

    def __init__(self, g: np.ndarray, h: np.ndarray, settings: Settings) -> None:
        self.g, self.h, self.settings = g, h, settings
        self.parent = g**2 / (h + settings.penalty)
        self.best, self.chosen, self.cut = np.full(len(g), SMALLEST_GAIN), np.full(len(g), -1), np.zeros(len(g), np.int64)
        self.low_g, self.low_h = np.zeros(len(g)), np.zeros(len(g))

    def try_feature(self, f: int, g: np.ndarray, h: np.ndarray) -> None:
        """`g` and `h` are the sums of the feature's bins, (nodes, bins)."""
        low_g, low_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        high_g, high_h = self.g[:, None] - low_g, self.h[:, None] - low_h
        penalty, least, own = self.settings.penalty, self.settings.least, np.arange(len(self.g))
        gain = low_g**2 / (low_h + penalty) + high_g**2 / (high_h + penalty) - self.parent[:, None]
        gain[(low_h < least) | (high_h < least)] = -np.inf
        place = gain.argmax(axis=1)
        found = gain[own, place]
        better = found > self.best + 1e-12 * np.abs(self.best)
        self.best[better], self.chosen[better], self.cut[better] = found[better], f, place[better]
        self.low_g[better], self.low_h[better] = low_g[own, place][better], low_h[own, place][better]


def grow(codes: np.ndarray, sizes: list[int], g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[Tree, np.ndarray]:
    """One tree over bin codes and the leaf values of its cells; borders are still bin numbers."""
    feature, border, left, right, value = [-1], [0.0], [0], [0], [0.0]
    node = np.zeros(len(g), np.int64)  # which of the open nodes a cell is in, -1 once its node is a leaf
    names, leaf = [0], np.zeros(len(g))
    for level in range(settings.depth + 1):
        inside = np.flatnonzero(node >= 0)
        if not len(inside):
            break
        at, gi, hi, count = node[inside], g[inside], h[inside], len(names)
        whole_g, whole_h = np.bincount(at, gi, count), np.bincount(at, hi, count)
        splits = Splits(whole_g, whole_h, settings)
        if level < settings.depth:
            for f, size in enumerate(sizes):
                if size < 2:
                    continue
                cell = at * size + codes[inside, f]
                splits.try_feature(f, *(np.bincount(cell, v, count * size).reshape(count, size) for v in (gi, hi)))
        chosen, cut = splits.chosen, splits.cut
        weights = -settings.rate * whole_g / (whole_h + settings.penalty)
        following, low_of = [], np.full(count, -1)
        for k, name in enumerate(names):
            if chosen[k] < 0:
                value[name] = float(weights[k])
                continue
            feature[name], border[name] = int(chosen[k]), float(cut[k])
            left[name], right[name] = len(feature), len(feature) + 1
            low_of[k] = len(following)
            following += [len(feature), len(feature) + 1]
            for nodes, empty in ((feature, -1), (border, 0.0), (left, 0), (right, 0), (value, 0.0)):
                nodes += [empty, empty]
        ends = low_of[at] < 0
        leaf[inside[ends]], node[inside[ends]] = weights[at[ends]], -1
        moving, own = inside[~ends], at[~ends]
        node[moving] = low_of[own] + (codes[moving, chosen[own]] > cut[own])
        names = following
    arrays = (np.array(feature), np.array(border), np.array(left), np.array(right), np.array(value))
    return Tree(*arrays), leaf


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def slopes(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted first and second derivatives of the loss, one pair for each tree of a round."""
    p, outputs, pairs = probabilities(margin), margin.shape[1], []
    for k in range(outputs):
        hit, share = (y == 1, p[:, 1]) if outputs == 1 else (y == k, p[:, k])
        # the softmax counts each pair of classes from both sides
        h = np.maximum(share * (1 - share) * (1 if outputs == 1 else 2), 1e-16)
        pairs.append((weight * (share - hit), weight * h))
    return pairs


def probabilities(margin: np.ndarray) -> np.ndarray:
    """(rows, classes) from margins; a single margin is the log odds of class 1."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        return np.stack([1 - p, p], axis=1)
    return _softmax(margin)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, settings: Settings) -> Iterator[list[Tree]]:
    """The trees of each round, fitted to weighted cells."""
    borders = [bin_borders(x[:, f], weight) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, f]) for f, b in enumerate(borders)], axis=1) if borders else np.zeros((len(x), 0), np.int64)
    sizes, outputs = [len(b) + 1 for b in borders], 1 if classes <= 2 else classes
    margin = np.zeros((len(x), outputs))
    for _ in range(settings.rounds):
        trees = []
        for k, (g, h) in enumerate(slopes(margin, y, weight)):
            tree, leaf = grow(codes, sizes, g, h, settings)
            margin[:, k] += leaf
            inner = tree.feature >= 0
            tree.border[inner] = [borders[f][int(b)] for f, b in zip(tree.feature[inner], tree.border[inner], strict=True)]
            trees.append(tree)
        yield trees


def weighted_auc(score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> float:
    """Share of positive and negative pairs in order, ties as half; NaN without both."""
    _, where = np.unique(score, return_inverse=True)
    p, q = np.bincount(where, weight * positive), np.bincount(where, weight * ~positive)
    whole = p.sum() * q.sum()
    return float((p * (np.cumsum(q) - q / 2)).sum() / whole) if whole else float("nan")


# --------------------------------------------------------------------------- on Spark
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def cells(rows: DataFrame, features: list[Column], label: Column, fold: Column | None = None, most_rows: int = MOST_ROWS) -> Block:
    """(features, label, fold, weight) of the distinct rows, in a fixed order; of the rows with the lowest hashes if there are too many."""
    most = max(1, min(most_rows, MOST_NUMBERS // max(1, len(features))))
    count = rows.count()
    if count > most:
        rows = rows.filter(F.pmod(F.xxhash64(*[named(c) for c in rows.columns]), F.lit(1 << 32)) < int((1 << 32) * (most / count)))
    taken = rows.select(
        F.array(*[f.cast("double") for f in features]).alias("x"), label.cast("int").alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold")
    )
    found = taken.groupBy("x", "y", "fold").agg(F.count("*").cast("double").alias("n")).toArrow()
    x = np.asarray(found["x"].combine_chunks().flatten()).reshape(found.num_rows, len(features))
    y, folds, weight = (found[c].to_numpy() for c in ("y", "fold", "n"))
    order = np.lexsort((folds, y, *x.T[::-1]))
    return x[order], y[order], folds[order], weight[order]


def cross_validate(df: DataFrame, block: Block, classes: int, rounds: list[int], depths: list[int], rates: list[float], folds: int) -> DataFrame:
    """(rounds, depth, rate, fold, score) of all settings: AUC for two classes, else accuracy, on the fold left out."""
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(block)
    plan = [(depth, rate, fold) for depth in sorted(depths, reverse=True) for rate in rates for fold in range(folds)]
    tasks = df.sparkSession.createDataFrame(plan, "depth int, rate double, fold int").repartition(len(plan), "depth", "rate", "fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, fold, weight = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                inside = fold != row["fold"]
                margin, found = np.zeros((int((~inside).sum()), 1 if classes <= 2 else classes)), []
                truth, mass = y[~inside], weight[~inside]
                settings = Settings(max(rounds), row["depth"], row["rate"])
                for done, trees in enumerate(boost(x[inside], y[inside], weight[inside], classes, settings), 1):
                    margin += np.stack([tree(x[~inside]) for tree in trees], axis=1)
                    if done in rounds:
                        if classes <= 2:
                            score = weighted_auc(margin[:, 0], truth == 1, mass)
                        else:
                            score = float(mass[margin.argmax(axis=1) == truth].sum() / mass.sum()) if len(mass) else float("nan")
                        found.append({"rounds": done, **row, "score": score})
                yield pa.RecordBatch.from_pylist(found, schema)

    schema = pa.schema([("rounds", pa.int32()), ("depth", pa.int32()), ("rate", pa.float64()), ("fold", pa.int32()), ("score", pa.float64())])
    return tasks.mapInArrow(run, "rounds int, depth int, rate double, fold int, score double")


def fit(df: DataFrame, block: Block, classes: int, settings: Settings) -> list[list[Tree]]:
    """The trees of all rounds, grown in a task."""
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, _, weight = shared.value
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(list(boost(x, y, weight, classes, settings)))], pa.binary())], names=["model"])

    return pickle.loads(df.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "model binary").first().model)


# ------------------------------------------------------- one model from all rows
def value_counts(rows: DataFrame, features: list[Column]) -> DataFrame:
    """(feature, value, n) of all rows, stored."""
    wide = rows.select(F.posexplode(F.array(*[f.cast("double") for f in features])).alias("feature", "value"))
    return stored(wide.groupBy("feature", "value").agg(F.count("*").alias("n")), "values")


def all_borders(counts: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """`bin_borders` of every feature, from the counts of all values; only values near a quantile reach the driver."""
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    placed = running_totals(counts, ["feature"], ["value"], ["n"]).join(F.broadcast(totals), "feature")  # one row per feature
    reached, before = F.col("running_n") / F.col("total") * bins, (F.col("running_n") - F.col("n")) / F.col("total") * bins
    near = (F.col("distinct") <= bins) | (F.floor(reached + 1e-9) > F.floor(before - 1e-9))
    found = placed.filter(near).select("feature", "value", (F.col("running_n") / F.col("total")).alias("share"), "distinct").toArrow()
    feature, value, share, distinct = (found[c].to_numpy() for c in ("feature", "value", "share", "distinct"))
    borders = []
    for f in range(width):
        own = np.flatnonzero(feature == f)
        own = own[np.argsort(value[own])]
        each = value[own]
        if len(own) and distinct[own[0]] > bins:
            each = _quantiles(each, share[own], bins)
        borders.append((each[:-1] + each[1:]) / 2)
    return borders


def bin_cells(rows: DataFrame, features: list[Column], label: Column, borders: list[np.ndarray]) -> DataFrame:
    """(code, y, n) of all rows, stored: the bins of the features as one byte each, the label, and the rows that have them."""
    importable(rows.sparkSession)
    width = len(borders)
    taken = rows.select(F.array(*[f.cast("double") for f in features]).cast("array<double>").alias("x"), label.cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, width), batch.column(1).to_numpy()
            codes = np.zeros((batch.num_rows, width + 4), np.uint8)
            for f, b in enumerate(borders):
                codes[:, f] = np.searchsorted(b, x[:, f])
            codes[:, width:] = y.astype("<i4").view(np.uint8).reshape(-1, 4)
            each, n = np.unique(codes.view(f"V{width + 4}").ravel(), return_counts=True)
            found = each.view(np.uint8).reshape(-1, width + 4)
            code = pa.array([bytes(c) for c in np.ascontiguousarray(found[:, :width])], pa.binary())
            truth = np.ascontiguousarray(found[:, width:]).view("<i4").ravel()
            yield pa.RecordBatch.from_arrays([code, pa.array(truth, pa.int32()), pa.array(n, pa.int64())], names=["code", "y", "n"])

    binned = taken.mapInArrow(run, "code binary, y int, n bigint")
    return stored(binned.groupBy("code", "y").agg(F.sum("n").cast("double").alias("n")), "cells")


def _codes(column: pa.Array, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, width)


def fit_all(rows: DataFrame, features: list[Column], label: Column, classes: int, settings: Settings, most_rows: int = MOST_ROWS) -> list[list[Tree]]:
    """The trees of all rounds, grown from all rows.  `most_rows` cells at most are fitted in one task, without any left out beyond it."""
    borders = all_borders(value_counts(rows, features), len(features)) if features else []
    found = bin_cells(rows, features, label, borders)
    width, count = len(borders), found.count()
    if count <= max(1, min(most_rows, MOST_NUMBERS // max(1, width))) or not width:
        block = found.toArrow()
        codes, y, weight = _codes(block["code"], count, width), block["y"].to_numpy(), block["n"].to_numpy()
        order = np.lexsort((y, *codes.T[::-1]))
        model = fit(rows, (codes[order].astype(float), y[order], np.zeros(count, np.int32), weight[order]), classes, settings)
    else:
        model = list(boost_spread(found, [len(b) + 1 for b in borders], classes, settings))
    for tree in (tree for trees in model for tree in trees):
        inner = tree.feature >= 0  # so far borders are bin numbers
        tree.border[inner] = [borders[f][int(b)] for f, b in zip(tree.feature[inner], tree.border[inner], strict=True)]
    return model


def boost_spread(found: DataFrame, sizes: list[int], classes: int, settings: Settings) -> Iterator[list[Tree]]:
    """`boost` over cells that stay where they are; borders are bin numbers.

    A level of a round is one pass that sums the slopes of every (tree, open node, feature,
    bin); the driver hears of these sums alone.  The margins are kept with the cells.
    """
    importable(found.sparkSession)
    outputs, width = 1 if classes <= 2 else classes, len(sizes)
    state, older = found.select("code", "y", "n", F.lit(bytes(8 * outputs)).alias("margin")), None
    for done in range(1, settings.rounds + 1):
        trees = _grow_spread(state, sizes, outputs, settings)
        if older is not None:
            older.unpersist()
        yield trees
        if done == settings.rounds:
            state.unpersist()
            return
        following = _add_margins(state, trees, width, outputs)
        if done % KEPT_ROUNDS == 0:
            following = stored(following, "margins")
            state.unpersist()
            state, older = following, None
        else:
            state, older = following.persist(), state


def _unpack(batch: pa.RecordBatch, width: int, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    margin = np.frombuffer(b"".join(batch.column(3).to_pylist())).reshape(batch.num_rows, outputs)
    return _codes(batch.column(0), batch.num_rows, width), batch.column(1).to_numpy(), batch.column(2).to_numpy(), margin


def _add_margins(state: DataFrame, trees: list[Tree], width: int, outputs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, _, _, margin = _unpack(batch, width, outputs)
                margin = margin + np.stack([tree(codes) for tree in trees], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([bytes(m) for m in margin], pa.binary())], names=["code", "y", "n", "margin"])

    return state.mapInArrow(run, "code binary, y int, n double, margin binary")


def _level_sums(state: DataFrame, trees: list[Tree], places: list[np.ndarray], sizes: list[int], outputs: int) -> np.ndarray:
    """(2, slots): sums of both slopes.  Each tree leads to its node numbers; `places` are their places among all open nodes, or -1."""
    width, ends = len(sizes), np.cumsum([0, *sizes])
    slots = int(ends[-1]) * sum(int((p >= 0).sum()) for p in places)
    walks = [Tree(t.feature, t.border, t.left, t.right, p) for t, p in zip(trees, places, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_rows = np.zeros((2, slots)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_rows = True
            codes, y, weight, margin = _unpack(batch, width, outputs)
            for (g, h), walk in zip(slopes(margin, y, weight), walks, strict=True):
                place = walk(codes)
                inside = np.flatnonzero(place >= 0)
                if not len(inside):
                    continue
                at, gi, hi = place[inside] * int(ends[-1]), g[inside], h[inside]
                first, last = int(at.min()), int(at.max()) + int(ends[-1])
                for f in range(width):
                    slot = at + ends[f] + codes[inside, f] - first
                    sums[0, first:last] += np.bincount(slot, gi, last - first)
                    sums[1, first:last] += np.bincount(slot, hi, last - first)
        if any_rows:
            some = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["slot", "g", "h"])

    summed = state.mapInArrow(run, "slot bigint, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    result = np.zeros((2, slots))
    result[:, summed["slot"].to_numpy()] = summed["g"].to_numpy(), summed["h"].to_numpy()
    return result


def _grow_spread(state: DataFrame, sizes: list[int], outputs: int, settings: Settings) -> list[Tree]:
    """The trees of one round, all grown at once."""
    ends, whole = np.cumsum([0, *sizes]), int(sum(sizes))
    grown = [([-1], [0.0], [0], [0], [0.0]) for _ in range(outputs)]
    opened = [[0] for _ in range(outputs)]  # numbers of the open nodes of each tree
    known: list[tuple[np.ndarray, np.ndarray] | None] = [None] * outputs  # their slopes, once their parent was split

    def as_trees() -> list[Tree]:
        return [Tree(*(np.array(v) for v in arrays)) for arrays in grown]

    for level in range(settings.depth + 1):
        if not any(opened):
            break
        sums = None
        if level < settings.depth:
            places, base = [], 0
            for arrays, names in zip(grown, opened, strict=True):
                place = np.full(len(arrays[0]), -1)
                place[names] = base + np.arange(len(names))
                places.append(place)
                base += len(names)
            sums = _level_sums(state, as_trees(), places, sizes, outputs).reshape(2, base, whole)
        base = 0
        for k, (arrays, names) in enumerate(zip(grown, opened, strict=True)):
            if not names:
                continue
            feature, border, left, right, value = arrays
            own = None if sums is None else sums[:, base:base + len(names)]
            base += len(names)
            whole_g, whole_h = known[k] or (own[0, :, : sizes[0]].sum(axis=1), own[1, :, : sizes[0]].sum(axis=1))
            splits = Splits(whole_g, whole_h, settings)
            if own is not None:
                for f, size in enumerate(sizes):
                    if size >= 2:
                        splits.try_feature(f, own[0, :, ends[f]:ends[f + 1]], own[1, :, ends[f]:ends[f + 1]])
            following, next_g, next_h = [], [], []
            for i, name in enumerate(names):
                if splits.chosen[i] < 0:
                    value[name] = float(-settings.rate * whole_g[i] / (whole_h[i] + settings.penalty))
                    continue
                feature[name], border[name] = int(splits.chosen[i]), float(splits.cut[i])
                left[name], right[name] = len(feature), len(feature) + 1
                following += [len(feature), len(feature) + 1]
                next_g += [splits.low_g[i], whole_g[i] - splits.low_g[i]]
                next_h += [splits.low_h[i], whole_h[i] - splits.low_h[i]]
                for nodes, empty in ((feature, -1), (border, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    nodes += [empty, empty]
            opened[k], known[k] = following, (np.array(next_g), np.array(next_h))
    return as_trees()


def predict(rows: DataFrame, features: list[Column], keep: list[str], model: list[list[Tree]], classes: int) -> DataFrame:
    """(keep, prediction, probability) of every row; NaN goes to the high side of every border."""
    importable(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    wide = rows.select(*[named(c) for c in keep], F.array(*[f.cast("double") for f in features]).alias("__x"))
    width, kept, classes_out = len(features), list(keep), 1 if classes <= 2 else classes
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(kept)).flatten(), float).reshape(batch.num_rows, width)
            margin = np.zeros((len(x), classes_out))
            for trees in shared.value:
                for k, tree in enumerate(trees):
                    margin[:, k] += tree(x)
            p = probabilities(margin)
            ends = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(p.argmax(axis=1).astype(float)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))],
                names=[*kept, "prediction", "probability"],
            )

    return wide.mapInArrow(run, ", ".join(x for x in (kinds, "prediction double, probability array<double>") if x))
