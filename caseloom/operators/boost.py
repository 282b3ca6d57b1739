"""Boosted trees of many settings and folds, grown side by side: one pass over the rows counts for all of them."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import scratch_path

# Functions of this module travel to the executors whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parameters that runs side by side may differ in, with Spark ML's own values.
SETTINGS = {"stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
#: Bins of a feature, and rows that their bounds are drawn from, as in Spark ML.
BINS, SAMPLE = 32, 10_000
#: Rows of which one task counts for the runs of one fold and depth.
SLICE_ROWS = 200_000
#: Bytes that the counts of one task take at most, unless a single run has more.
COUNT_BYTES = 64 << 20
#: Trees after which what the runs say so far is written, so that lineages stay short.
WRITE_EVERY = 10


class Run(NamedTuple):
    """What one boosted run is grown with."""

    rate: float
    step: float
    features: int


class Cell(NamedTuple):
    """The rows of a slice, those to learn from first, and what the runs of a group say about them so far."""

    group: int
    slice: int
    bins: np.ndarray
    label: np.ndarray
    learned: int
    order: np.ndarray
    said: np.ndarray


class Trees(NamedTuple):
    """One tree per run, (run, node): the children of node n are 2 n + 1 and 2 n + 2; a leaf's feature is -1."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


def features_per_node(strategy: str, count: int) -> int:
    """Features that a node may be split by, as Spark ML reads its ``featureSubsetStrategy`` for one tree."""
    named = {"all": count, "auto": count, "sqrt": math.ceil(math.sqrt(count)), "onethird": math.ceil(count / 3)}
    named["log2"] = max(1, math.ceil(math.log2(count)))
    if strategy.lower() in named:
        return named[strategy.lower()]
    return min(count, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * count)


def bounds(values: np.ndarray) -> np.ndarray:
    """Upper bounds of the bins of a feature's values but the last, chosen as Spark ML does."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    most = min(BINS, len(values)) - 1
    if len(middles) <= most:
        return middles
    stride = len(values) / (most + 1)
    chosen, target, before = [], stride, np.cumsum(counts)
    for at in range(1, len(found)):
        if abs(before[at - 1] - target) < abs(before[at] - target):
            chosen.append(middles[at - 1])
            target += stride
    return np.array(chosen)


def fold_bounds(rows: DataFrame, folds: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """The ``bounds`` of every fold's learning rows, by fold and feature; of a sample if there are more than ``SAMPLE``."""
    sizes = {r["_fold"]: r["count"] for r in rows.groupBy("_fold").count().collect()}
    learned = [sum(n for of, n in sizes.items() if of != fold) for fold in range(folds)]
    share = F.array(*[F.lit(min(1.0, SAMPLE / n) if n else 0.0) for n in learned])
    dealt = rows.select("x", "_fold", F.rand(seed).alias("draw")).select("x", "_fold", "draw", F.posexplode(share).alias("fold", "share"))
    long = dealt.filter("fold != _fold AND draw < share").select("fold", F.posexplode("x").alias("feature", "value"))

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group["fold"].iloc[0], group["feature"].iloc[0], bounds(group["value"].to_numpy()).tolist())])

    found = long.groupBy("fold", "feature").applyInPandas(cut, "fold int, feature int, bounds array<double>")
    return {(r["fold"], r["feature"]): np.array(r["bounds"]) for r in found.collect()}


def draw(*of: int) -> np.random.Generator:
    """Dice that depend on the numbers alone."""
    return np.random.default_rng(of)


def leaves(trees: Trees, bins: np.ndarray, levels: int) -> np.ndarray:
    """(run, row): the node that a row has come to after so many levels."""
    runs = len(trees.feature)
    each, bins = np.arange(bins.shape[1]), bins.ravel()
    # Where a node's feature begins among the bins; places there need 64 bits.
    begins = trees.feature.astype(np.int64) * len(each)
    at = np.zeros((runs, len(each)), np.int64)
    for run in range(runs):
        here = at[run]
        for _ in range(levels):
            begin = begins[run].take(here)
            right = bins.take(begin + each) > trees.bin[run].take(here)
            here = np.where(begin >= 0, 2 * here + 1 + right, here)
        at[run] = here
    return at


def add(cell: Cell, trees: Trees, weights: Sequence[float], depth: int) -> Cell:
    """The cell once a tree per run has spoken."""
    at = leaves(trees, cell.bins, depth)
    return cell._replace(said=cell.said + np.array(weights)[:, None] * np.take_along_axis(trees.value, at, axis=1))


def counts(cell: Cell, trees: Trees, runs: Sequence[Run], tree: int, level: int, seed: int) -> Iterator[np.ndarray]:
    """Per run (2, node, feature, bin): rows at the nodes of a level, and the sum of what is still to be said about them.

    Steps after the first learn the downward gradient of the log loss, as Spark ML's do. Labels are -1 and 1.
    """
    n, features = cell.learned, len(cell.bins)
    bins, label = cell.bins[:, :n], cell.label[:n]
    here = leaves(trees, bins, level) - (2**level - 1)
    # One draw per row and tree, the same at every level and for every run.
    drawn = draw(seed, tree, cell.slice).random(len(cell.label))[cell.order[:n]]
    first = (np.arange(features) * BINS)[:, None] + bins
    for run, (rate, _, _) in enumerate(runs):
        rows = np.flatnonzero((here[run] >= 0) & (drawn < rate))
        target = label[rows] if tree == 0 else 4 * label[rows] / (1 + np.exp(2 * label[rows] * cell.said[run, rows]))
        keys = (first[:, rows] + here[run, rows] * (features * BINS)).ravel()
        shape = (2**level, features, BINS)
        yield np.stack([
            np.bincount(keys, of, math.prod(shape)).reshape(shape) for of in (None, np.tile(target, features))
        ])


def best_splits(found: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node of ``counts``: feature (-1: none helps), bin, and mean of the node, of its left and of its right side.

    ``asked`` (node, feature) are the features that may be taken. Of equally good splits the first.
    """
    n, total = np.cumsum(found, axis=-1)
    all_n, all_total = n[..., -1:], total[..., -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = total**2 / n + (all_total - total) ** 2 / (all_n - n) - all_total**2 / all_n
        gain = np.where((n > 0) & (n < all_n) & asked[..., None], gain, -np.inf).reshape(len(n), -1)
        best, node = gain.argmax(axis=1), np.arange(len(n))
        feature, cut = best // BINS, best % BINS
        left_n, left = n[node, feature, cut], total[node, feature, cut]
        whole_n, whole = all_n[:, 0, 0], all_total[:, 0, 0]
        means = [np.nan_to_num(a / b) for a, b in ((whole, whole_n), (left, left_n), (whole - left, whole_n - left_n))]
    return np.where(gain[node, best] > 0, feature, -1), cut, *means


def _written(cells: RDD, path: str) -> RDD:
    cells.saveAsPickleFile(path, 1)
    return cells.ctx.pickleFile(path)


def _remove(cells: RDD, path: str) -> None:
    place = cells.ctx._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(cells.ctx._jsc.hadoopConfiguration()).delete(place, True)


def _dealt(blocks: DataFrame, cuts: Mapping, groups: Sequence[tuple[int, list[Run]]]) -> tuple[RDD, int]:
    """A ``Cell`` per group (fold, runs) and slice; blocks of rows make up slices of about ``SLICE_ROWS``, whose number is returned too."""
    sizes = blocks.select("block", "n").orderBy("block").collect()
    slices = max(1, min(len(sizes), -(-sum(size.n for size in sizes) // SLICE_ROWS)))
    slice_of = {size.block: at * slices // len(sizes) for at, size in enumerate(sizes)}

    def deal(row) -> Iterator[tuple[int, tuple]]:
        for group in range(len(groups)):
            yield group * slices + slice_of[row.block], (row.block, row.x, row.label, row.fold)

    def cell(key: int, parts: Iterator[tuple]) -> Cell:
        _, x, label, fold = zip(*sorted(parts))
        label, fold = (np.concatenate([np.frombuffer(part) for part in of]) for of in (label, fold))
        x = np.concatenate([np.frombuffer(part) for part in x]).reshape(len(label), -1)
        own, runs = groups[key // slices]
        order = np.argsort(fold == own, kind="stable")
        bins = np.stack([np.searchsorted(cuts.get((own, at), ()), x[order, at]) for at in range(x.shape[1])])
        said = np.zeros((len(runs), len(label)))
        return Cell(key // slices, key % slices, bins.astype(np.int16), 2 * label[order] - 1, int((fold != own).sum()), order, said)

    dealt = blocks.rdd.flatMap(deal).groupByKey(len(groups) * slices, lambda key: key)
    return dealt.map(lambda of: cell(*of)), slices


def _together(
    blocks: DataFrame, cuts: Mapping, groups: Sequence[tuple[int, list[Run]]], depth: int, sizes: Sequence[int], features: int, seed: int
) -> list[np.ndarray]:
    """Per group (size, run): the held-out rows that the first so many trees of its runs call right."""
    spark = blocks.sparkSession
    most = max(len(runs) for _, runs in groups)
    cells, slices = _dealt(blocks, cuts, groups)
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    parts = min(cells.getNumPartitions(), spark.sparkContext.defaultParallelism)
    held, paths = {}, []
    kept = [cells]
    for tree in range(max(sizes)):
        # By rank, so that a run with fewer features per node draws from the same dice.
        ranks = draw(seed, tree).random((2**depth - 1, features)).argsort(axis=1).argsort(axis=1)
        nodes = 2 ** (depth + 1) - 1
        trees = [
            Trees(np.full((len(runs), nodes), -1), np.zeros((len(runs), nodes), np.int16), np.zeros((len(runs), nodes)))
            for _, runs in groups
        ]
        for level in range(depth):
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            asked = ranks[at]

            def count(cell: Cell, trees=trees, tree=tree, level=level) -> list[tuple[int, np.ndarray]]:
                found = counts(cell, trees[cell.group], groups[cell.group][1], tree, level, seed)
                return [(cell.group * most + run, of) for run, of in enumerate(found)]

            def split(key: int, found: np.ndarray, asked=asked) -> tuple:
                return key, best_splits(found, asked < groups[key // most][1][key % most].features)

            summed = cells.flatMap(count)
            # A run whose rows are in one slice has its sums there already.
            summed = summed.reduceByKey(np.add, parts, lambda key: key) if slices > 1 else summed
            below = slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
            grown = False
            for key, (feature, cut, mean, left, right) in summed.map(lambda of, split=split: split(*of)).collect():
                found, run = trees[key // most], key % most
                found.feature[run, at], found.bin[run, at] = feature, cut
                if level == 0:
                    found.value[run, 0] = mean[0]
                sides = np.stack([left, right], axis=1).ravel()
                found.value[run, below] = np.where(np.repeat(feature, 2) >= 0, sides, 0.0)
                grown |= bool((feature >= 0).any())
            if not grown:
                break
        # What came before the cells is no longer asked for, now that a pass has stored them.
        for old in kept[:-1]:
            old.unpersist()
        weights = [[1.0 if tree == 0 else run.step for run in runs] for _, runs in groups]
        cells = cells.map(lambda cell, trees=trees, weights=weights: add(cell, trees[cell.group], weights[cell.group], depth))
        if (tree + 1) % WRITE_EVERY == 0:
            paths.append(scratch_path(spark, "boosted"))
            cells = _written(cells, paths[-1])
            for path in paths[:-1]:
                _remove(cells, path)
            del paths[:-1]
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
        kept = [kept[-1], cells]
        if tree + 1 in sizes:

            def judge(cell: Cell) -> tuple[int, np.ndarray]:
                return cell.group, ((cell.said[:, cell.learned :] > 0) == (cell.label[cell.learned :] > 0)).sum(axis=1)

            held[tree + 1] = cells.map(judge).reduceByKey(np.add, parts, lambda key: key).collectAsMap()
    for old in kept:
        old.unpersist()
    for path in paths:
        _remove(cells, path)
    return [np.stack([held[size][group] for size in sizes]) for group in range(len(groups))]


def boosted_accuracy(
    rows: DataFrame, features: str, label: str, settings: Sequence[Mapping], sizes: Sequence[int], folds: int, seed: int = 42
) -> dict[tuple[int, int], list[float]]:
    """By place of a setting and fold: share of the fold's rows that the first so many boosted trees, learned from the others, call right.

    Runs grow as Spark ML's boosted trees do: variance, 32 bins, log loss, first tree whole, the others by ``stepSize``. All settings
    of a depth grow side by side over all folds: a pass counts a level of a tree of each, the counts are summed
    by run, and only the splits come to the driver. Settings that come to the same number of features per
    node are one run. Rows and features are drawn by dice of our own; ``rows`` have ``_fold``. Labels are 0 and 1.
    """
    spark = rows.sparkSession
    rows = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"), "_fold")
    first = rows.first()
    if first is None:
        return {(at, fold): [0.0] * len(sizes) for at in range(len(settings)) for fold in range(folds)}
    width, held = len(first["x"]), {r["_fold"]: r["count"] for r in rows.groupBy("_fold").count().collect()}
    cuts = fold_bounds(rows, folds, seed)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = batch["x"].flatten(), batch["label"], batch["_fold"]
                columns = [pa.array([column.to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary()) for column in of]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *columns], names=["n", "x", "label", "fold"])

    path = scratch_path(spark, "blocks")
    packed = rows.mapInArrow(block, "n int, x binary, label binary, fold binary")
    # Written, so that a block has the same rows whenever it is read.
    packed.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    blocks = spark.read.parquet(path)

    by_depth: dict[int, dict[Run, list[int]]] = {}
    for at, setting in enumerate(settings):
        of = {**SETTINGS, **setting}
        run = Run(float(of["subsamplingRate"]), float(of["stepSize"]), features_per_node(str(of["featureSubsetStrategy"]), width))
        by_depth.setdefault(int(of["maxDepth"]), {}).setdefault(run, []).append(at)

    @inheritable_thread_target(spark)
    def grow(depth: int) -> dict[tuple[int, int], list[float]]:
        served = by_depth[depth]
        runs, per = list(served), max(1, COUNT_BYTES // (2 ** max(depth - 1, 0) * width * BINS * 16))
        groups = [(fold, runs[at : at + per]) for fold in range(folds) for at in range(0, len(runs), per)]
        found = _together(blocks, cuts, groups, depth, sizes, width, seed)
        return {
            (at, fold): [float(n) / held[fold] if held.get(fold) else 0.0 for n in right[:, place]]
            for (fold, part), right in zip(groups, found)
            for place, run in enumerate(part)
            for at in served[run]
        }

    # The deepest have the most passes, one after another; the others run beside them.
    with ThreadPoolExecutor(len(by_depth)) as pool:
        return {key: shares for part in pool.map(grow, sorted(by_depth, reverse=True)) for key, shares in part.items()}
