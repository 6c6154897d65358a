"""Exact Shapley values of boosted trees.

The value of a set of known features is the expectation over a tree that follows a row at splits on known features and takes
both ways, weighted by the hessians fitted there, at all others. A leaf's share in it is a product over the distinct features on
its path: 1 or 0 for a known one, as the row passes its splits or not, and the product of the weights for another. The
Shapley value of one feature in such a product is an integral over t from 0 to 1 of a polynomial,

    value * (pass - weight) * integral of prod over the other features of (weight * (1 - t) + pass * t),

which Gauss-Legendre points give exactly. It depends on a row only by which splits of the path it passes, so a table holds
it for every leaf and every such pattern. The tables of leaves that share most of their splits are added up, so that a task looks
up, per row and feature, one number for each few leaves. Their size does not depend on that of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.boosting import (
    INPUTS,
    Boosted,
    Pattern,
    Trees,
    both_ways,
    inputs_of,
    larger,
    leaf_groups,
    to_bins,
)

CONTRIBUTIONS = "contributions"
# Rows that a task handles at a time.
_ROWS = 1 << 13


class _Tree:
    """Leaves of one tree with the splits on their paths and their table of Shapley values."""

    def __init__(self, trees: Trees, t: int, missing: np.ndarray) -> None:
        feature, cover = trees.feature[t], trees.cover[t]
        depth = trees.depth
        self.inner = np.flatnonzero(feature >= 0)
        self.feature, self.cut, self.missing_left = feature[self.inner], trees.cut[t][self.inner], trees.missing_left[t][self.inner]
        place = {int(node): i for i, node in enumerate(self.inner)}
        reached = [0, *(c for node in self.inner for c in (2 * node + 1, 2 * node + 2))]
        leaves = [n for n in reached if feature[n] < 0]
        shape = (len(leaves), depth)
        # Per leaf and step of its path the split, and whether the path goes left; steps that a short path lacks always pass.
        self.split, self.left = np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.real = np.zeros(shape, bool)
        slot_feature, weight = np.zeros(shape, np.int64), np.ones(shape)
        slot_of = np.zeros(shape, np.int64)
        self.expected = 0.0
        for i, leaf in enumerate(leaves):
            path, node = [], leaf
            while node:
                parent = (node - 1) // 2
                path.append((parent, node))
                node = parent
            slots: dict[int, int] = {}
            reach = 1.0
            for step, (parent, child) in enumerate(reversed(path)):
                slot = slots.setdefault(int(feature[parent]), len(slots))
                self.split[i, step], self.left[i, step], self.real[i, step] = place[parent], child == 2 * parent + 1, True
                slot_of[i, step] = slot
                slot_feature[i, slot] = feature[parent]
                share = cover[child] / cover[parent]
                weight[i, slot] *= share
                reach *= share
            self.expected += reach * trees.value[t][leaf]
        value = trees.value[t][leaves]
        points, weights = np.polynomial.legendre.leggauss(depth // 2 + 1)
        points, weights = (points + 1) / 2, weights / 2
        patterns = np.arange(2**depth)
        passes = (patterns[:, None] >> np.arange(depth)) & 1
        # By leaf, pattern and slot: whether the row passes all splits on the slot's feature.
        slot_pass = np.ones((len(leaves), len(patterns), depth), bool)
        for i in range(len(leaves)):
            for step in np.flatnonzero(self.real[i]):
                slot_pass[i, :, slot_of[i, step]] &= passes[:, step] == 1
        factor = weight[:, None, :, None] * (1 - points) + slot_pass[..., None] * points
        table = np.empty(slot_pass.shape)
        for slot in range(depth):
            others = np.delete(factor, slot, axis=2).prod(axis=2)
            table[:, :, slot] = value[:, None] * (slot_pass[:, :, slot] - weight[:, None, slot]) * (others @ weights)
        # The splits of a leaf's path, by step, with the way it takes; the table and features by slot.
        paths = [[(int(self.split[i, k]), bool(self.left[i, k])) for k in np.flatnonzero(self.real[i])] for i in range(len(leaves))]
        at = {leaf: i for i, leaf in enumerate(leaves)}
        groups = [[at[leaf] for leaf in group] for group in leaf_groups(feature)]
        self.groups = [
            self._joined(trees, t, [(paths[i], table[i], slot_feature[i]) for i in group], depth, len(missing)) for group in groups
        ]

    def _joined(self, trees: Trees, t: int, leaves: list[tuple], depth: int, width: int) -> tuple[Pattern, list]:
        """Of some leaves, the pattern of the splits on their paths, and the Shapley values by feature and pattern."""
        splits = sorted({split for path, _, _ in leaves for split, _ in path})
        bit = {split: i for i, split in enumerate(splits)}
        patterns = np.arange(1 << len(splits))
        values = {int(self.feature[split]): np.zeros(len(patterns)) for split in splits}
        for path, table, features in leaves:
            passed = np.full(len(patterns), (1 << depth) - 1)
            for step, (split, left) in enumerate(path):
                passed -= ((patterns >> bit[split] & 1) != left).astype(np.int64) << step
            for slot in range(len({int(self.feature[split]) for split, _ in path})):
                values[int(features[slot])] += table[passed, slot]
        return Pattern(trees, t, [int(self.inner[split]) for split in splits], width), list(values.items())

    def add(self, both: np.ndarray, out: np.ndarray) -> None:
        """Add the values to ``out``, by feature and row; the rows are given as ``both_ways``."""
        for pattern, values in self.groups:
            at = pattern(both)
            for f, table in values:
                out[f] += table.take(at, mode="clip")


class Explainer:
    """Shapley values of rows of bins under an ensemble."""

    def __init__(self, model: Boosted) -> None:
        self.width, self.missing = len(model.features), model.missing
        self.trees = [_Tree(model.trees, t, model.missing) for t in range(len(model.trees))]
        # The margin of a row of which nothing is known.
        self.base = model.base + sum(tree.expected for tree in self.trees)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        for at in range(0, len(x), _ROWS):
            both = both_ways(np.ascontiguousarray(x[at : at + _ROWS].T), self.missing)
            values = np.zeros((self.width, both.shape[1]))
            for tree in self.trees:
                tree.add(both, values)
            out[at : at + _ROWS] = values.T
        return out


def with_contributions(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with an array of Shapley values, one per feature, in place of ``_inputs``, and ``base_value``.

    Base value and contributions add up to the row's margin.
    """
    others = [f for f in df.schema.fields if f.name != INPUTS]
    width, cuts = len(model.features), model.cuts

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explain = Explainer(model)
        for batch in larger(batches):
            values = explain(to_bins(inputs_of(batch, width), cuts))
            lists = pa.FixedSizeListArray.from_arrays(values.ravel(), width).cast(pa.list_(pa.float64()))
            columns = [batch.column(f.name) for f in others] + [pa.array(np.full(len(values), explain.base)), lists]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in others], "base_value", CONTRIBUTIONS])

    schema = [T.StructField("base_value", T.DoubleType()), T.StructField(CONTRIBUTIONS, T.ArrayType(T.DoubleType()))]
    return df.mapInArrow(explained, T.StructType([*others, *schema]))


def mean_absolute_contributions(model: Boosted, df: DataFrame) -> DataFrame:
    """Mean absolute Shapley value of each feature over the rows of ``df`` (``_inputs``), largest first; null without rows."""
    width, cuts = len(model.features), model.cuts
    schema = pa.schema([("place", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explain, total, n = Explainer(model), np.zeros(width), 0
        for batch in larger(batches):
            total += np.abs(explain(to_bins(inputs_of(batch, width), cuts))).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total), pa.array([n] * width)], schema=schema)

    names = F.array(*[F.lit(f) for f in model.features])
    return (
        df.select(INPUTS).mapInArrow(summed, "place int, total double, n bigint")
        .groupBy(F.element_at(names, F.col("place") + 1).alias("feature"))
        .agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_abs_contribution"))
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )
