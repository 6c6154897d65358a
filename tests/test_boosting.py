"""Boosted trees against a plain exact implementation, and their Shapley values against all subsets of features."""

import itertools
import math
import pickle
import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from larkspur.operators import boosting, contributions
from larkspur.operators.boosting import INPUTS, MARGIN, BoostSettings, Trees
from larkspur.operators.metrics import roc_auc
from larkspur.session import materialise

NAMES = ["a", "b", "c", "d"]
SMALL = BoostSettings(rounds=3, depth=3, learning_rate=0.3, min_hessian=2.0, positive_weight=1.6)


def table(n=240, seed=1, gaps=0.2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.randint(0, 9) / 2 if rng.random() > gaps else None for _ in NAMES]
        hidden = (x[0] or 3) + (5 if x[1] is None else 0) - (x[2] or 0) * (1 if (x[3] or 0) > 2 else -1)
        rows.append((i, *x, int(hidden + rng.gauss(0, 2) > 3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y int")


def with_inputs(df):
    return df.withColumn(INPUTS, F.array(*NAMES))


# A plain implementation: one row at a time, all splits, no bins


def plain_trees(rows, settings):
    positive = sum(r[-1] for r in rows)
    margins = [math.log(positive * settings.positive_weight / (len(rows) - positive))] * len(rows)
    trees = []
    for _ in range(settings.rounds):
        stats = []
        for row, margin in zip(rows, margins):
            p, w = 1 / (1 + math.exp(-margin)), settings.positive_weight if row[-1] else 1
            stats.append((w * (p - row[-1]), w * p * (1 - p)))
        tree = {}

        def total(members):
            return [sum(stats[i][k] for i in members) for k in (0, 1)]

        def score(g, h):
            return g * g / (h + settings.l2)

        def grow(node, members, depth):
            g, h = total(members)
            tree[node] = (None, -g / (h + settings.l2) * settings.learning_rate, h, members)
            best = (settings.min_gain, None)
            if depth == settings.depth:
                return
            for f in range(len(NAMES)):
                for value in sorted({r[f + 1] for r in rows if r[f + 1] is not None})[1:]:
                    for missing_left in (False, True):
                        left = [i for i in members if (missing_left if rows[i][f + 1] is None else rows[i][f + 1] < value)]
                        lg, lh = total(left)
                        if lh >= settings.min_hessian and h - lh >= settings.min_hessian:
                            gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                            if gain > best[0] + 1e-5:
                                best = (gain, (f, value, missing_left, left))
            if best[1]:
                f, value, missing_left, left = best[1]
                tree[node] = ((f, value, missing_left, best[0]), *tree[node][1:])
                grow(2 * node + 1, left, depth + 1)
                grow(2 * node + 2, [i for i in members if i not in set(left)], depth + 1)

        grow(0, list(range(len(rows))), 0)
        for node, (split, value, _, members) in tree.items():
            if split is None:
                for i in members:
                    margins[i] += value
        trees.append(tree)
    return trees, margins


@pytest.fixture(scope="module")
def model(spark):
    return boosting.fit(frame(spark, table()).repartition(5), NAMES, "y", "id", SMALL)


def test_trees_are_those_of_exact_search(spark, model):
    rows = table()
    trees, margins = plain_trees(rows, SMALL)
    for t, tree in enumerate(trees):
        inner = {n for n, node in tree.items() if node[0]}
        assert set(np.flatnonzero(model.trees.feature[t] >= 0)) == inner
        for node, (split, value, cover, _) in tree.items():
            assert model.trees.value[t, node] == pytest.approx(value, abs=1e-5)
            assert model.trees.cover[t, node] == pytest.approx(cover, abs=1e-4)
            if split:
                assert model.trees.gain[t, node] == pytest.approx(split[3], abs=1e-3)
    got = {r.id: r[MARGIN] for r in boosting.with_margin(model, with_inputs(frame(spark, rows))).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(margins, abs=1e-5)


def test_trees_do_not_depend_on_partitions(spark, model):
    settings = replace(SMALL, rounds=12, row_sample=0.8, column_sample=0.8, seed=7)
    fits = [boosting.fit(frame(spark, table()).repartition(n), NAMES, "y", "id", settings) for n in (1, 6)]
    for name in ("feature", "cut", "missing_left", "value", "cover", "gain"):
        assert np.array_equal(getattr(fits[0].trees, name), getattr(fits[1].trees, name))
    # A tree uses three of the four columns, and not always the same ones.
    used = [set(row[row >= 0]) for row in fits[0].trees.feature]
    assert all(len(u) <= 3 for u in used) and len(set().union(*used)) == 4
    other = boosting.fit(frame(spark, table()), NAMES, "y", "id", replace(settings, seed=8))
    assert not np.array_equal(other.trees.value, fits[0].trees.value)


def test_many_partitions_are_added_in_tasks(spark, model, monkeypatch):
    monkeypatch.setattr(boosting, "_DIRECT", 1)
    other = boosting.fit(frame(spark, table()).repartition(4), NAMES, "y", "id", SMALL)
    assert np.array_equal(other.trees.value, model.trees.value)


def test_missing_values_have_a_learnt_way(spark):
    rows = [(i, None if i % 2 else float(i % 5), 0.0, None, 1.0, int(i % 2 == side)) for side in (0, 1) for i in range(200)]
    for side in (0, 1):
        part = [r for r in rows[side * 200 : side * 200 + 200]]
        fitted = boosting.fit(frame(spark, part), NAMES, "y", "id", replace(SMALL, rounds=1, depth=2))
        scores = {r.a is None: r[MARGIN] for r in boosting.with_margin(fitted, with_inputs(frame(spark, part)).select("a", INPUTS)).collect()}
        assert (scores[True] > scores[False]) == bool(side)


def test_a_leaf_needs_its_hessian(model):
    reached = np.zeros_like(model.trees.feature, bool)
    for t, node in zip(*np.nonzero(model.trees.feature >= 0)):
        reached[t, 2 * node + 1] = reached[t, 2 * node + 2] = True
    assert model.trees.cover[reached].min() >= SMALL.min_hessian - 1e-6


def test_little_to_learn_from(spark):
    df = frame(spark, table(40))
    for part, sign in ((df.where("y = 1"), 1), (df.where("y = 0"), -1), (df.where("false"), 0), (df.withColumn("y", F.lit(None).cast("int")), 0)):
        fitted = boosting.fit(part, NAMES, "y", "id", SMALL)
        assert len(fitted.trees) == 0 and np.sign(fitted.base) == sign
        assert boosting.with_margin(fitted, with_inputs(df)).select(MARGIN).distinct().count() == 1
    constant = df.withColumns({n: F.lit(1.0) for n in NAMES[:3]} | {"d": F.lit(float("nan"))})
    fitted = boosting.fit(constant, NAMES, "y", "id", SMALL)
    assert (fitted.trees.feature == -1).all()
    assert contributions.mean_absolute_contributions(fitted, with_inputs(constant)).agg(F.sum("mean_abs_contribution")).first()[0] == 0
    with pytest.raises(ValueError):
        boosting.fit(df, NAMES, "y", "id", replace(SMALL, bins=300))


def test_cuts():
    cuts = [np.array([1.0, 2.0]), np.array([])]
    bins = boosting.to_bins(np.array([[0.5, 3], [1, np.nan], [1.5, 3], [2, 3], [9, 3], [np.nan, 3]]), cuts)
    assert bins.tolist() == [[0, 0], [1, 1], [1, 0], [2, 0], [2, 0], [3, 0]]


def test_as_good_as_the_library(spark):
    """ROC AUC on new rows within 0.02 of the library's trees of the same number, depth and rate."""
    train, test = materialise(frame(spark, table(3_000, 2, 0.0)), "train"), materialise(frame(spark, table(3_000, 3, 0.0)), "test")
    fitted = boosting.fit(train, NAMES, "y", "id", BoostSettings(rounds=30, depth=3, learning_rate=0.2))
    own = roc_auc(boosting.with_margin(fitted, with_inputs(test)), "y", MARGIN).first()["roc_auc"]
    assembler = VectorAssembler(inputCols=NAMES, outputCol="v")
    library = GBTClassifier(featuresCol="v", labelCol="y", maxIter=30, maxDepth=3, stepSize=0.2).fit(assembler.transform(train))
    theirs = library.transform(assembler.transform(test)).select("y", vector_to_array("probability")[1].alias("p"))
    assert own > 0.85 and own >= roc_auc(theirs, "y", "p").first()["roc_auc"] - 0.02


def test_packed_columns_count_each_feature():
    """Features with few bins share a column; totals of its joint sums are the features' own."""
    rng = np.random.default_rng(1)
    missing = np.array([255, 2, 2, 7, 255, 2, 1, 24, 2, 5])
    columns = boosting._Columns(missing, 1024)
    assert len(columns.members) <= 4 and sorted(f for c in columns.members for f in c) == list(range(10)) and columns.width <= 1024
    x = np.stack([rng.integers(0, m + 1, 3_000) for m in missing], axis=1).astype(np.uint8)
    codes, slot, value = columns.codes(x), rng.integers(0, 3, 3_000), rng.integers(-9, 9, 3_000)
    for c in range(len(columns.members)):
        joint = np.zeros((3, columns.width), np.int64)
        np.add.at(joint, (slot, codes[c]), value)
        for f, sums in columns.sums(c, joint).items():
            own = np.zeros((3, missing[f] + 1), np.int64)
            np.add.at(own, (slot, x[:, f]), value)
            assert np.array_equal(sums, own)


def walked(trees, t, x, missing):
    node = 0
    while (f := trees.feature[t, node]) >= 0:
        left = trees.missing_left[t, node] if x[f] == missing[f] else x[f] <= trees.cut[t, node]
        node = 2 * node + 2 - int(left)
    return node


def test_walks_of_packed_rows(spark):
    fitted = boosting.fit(frame(spark, table(400, 6)), NAMES, "y", "id", replace(SMALL, depth=4, min_hessian=0.5))
    x = np.random.default_rng(2).integers(0, fitted.missing + 1, (300, 4)).astype(np.uint8)
    columns = boosting._Columns(fitted.missing, 1024)
    assert len(columns.members) == 2
    for t in range(len(fitted.trees)):
        expected = [walked(fitted.trees, t, row, fitted.missing) for row in x]
        assert boosting._Walk(fitted.trees, t, columns)(columns.codes(x)).tolist() == expected
        assert boosting.walks(fitted.trees, fitted.missing)[t](np.ascontiguousarray(x.T)).tolist() == expected


def test_margins_are_looked_up_by_pattern():
    """Leaves are looked up by the pattern of the splits above them, with few tables a tree; sums are those of walks, bit for bit."""
    rng = np.random.default_rng(3)
    missing = np.array([255, 9, 2, 1])
    trees = Trees.empty(6, 5)
    for t in range(6):
        for node in range(31):
            if not node or (trees.feature[t, (node - 1) // 2] >= 0 and rng.random() < 0.2 * t):
                trees.feature[t, node] = rng.integers(0, 4)
                trees.cut[t, node] = rng.integers(0, max(1, missing[trees.feature[t, node]] - 1))
                trees.missing_left[t, node] = rng.random() < 0.5
    trees.value[:] = rng.normal(size=trees.value.shape)
    x = rng.integers(0, missing + 1, (3_000, 4)).astype(np.uint8)
    margins = boosting.Margins(trees, missing)
    assert np.array_equal(margins(np.ascontiguousarray(x.T)), [sum(trees.value[t, walked(trees, t, row, missing)] for t in range(6)) for row in x])
    assert len(margins.lookups) <= 4 * 6 and max(len(table) for _, table in margins.lookups) <= 512


def test_batches_are_joined_before_lookups():
    batches = [pa.RecordBatch.from_pydict({"a": range(100 * i, 100 * i + 100)}) for i in range(7)]
    joined = list(boosting.larger(iter(batches), 250))
    assert [b.num_rows for b in joined] == [300, 300, 100]
    assert [v for b in joined for v in b.column("a").to_pylist()] == list(range(700))


def test_blocks_are_spread_over_the_cores(spark, monkeypatch):
    """Rows that lie in one partition are summed by all cores."""
    monkeypatch.setattr(boosting, "_TASK_ROWS", (1_000, 1 << 22))
    df = frame(spark, table(20_000)).coalesce(1)
    cuts = boosting.bin_cuts(df, [F.col(n) for n in NAMES])
    columns = boosting._Columns(np.array([len(c) + 1 for c in cuts]), 1024)
    inputs = F.array(*NAMES)
    blocks = boosting._stored_blocks(df, F.col("y"), F.xxhash64("id"), inputs, cuts, 0.0, columns, 20_000)
    sizes = blocks.mapPartitions(lambda part: [sum(len(b.label) for b in part)]).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 20_000 and max(sizes) < 8_000


def test_blocks_do_not_depend_on_batches(spark, monkeypatch):
    """Blocks are of equal size, however many rows Python tasks get at a time."""
    monkeypatch.setattr(boosting, "_TASK_ROWS", (1_000, 1 << 22))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = frame(spark, table(9_000)).coalesce(1)
    cuts = boosting.bin_cuts(df, [F.col(n) for n in NAMES])
    columns = boosting._Columns(np.array([len(c) + 1 for c in cuts]), 1024)
    try:
        for rows in (700, 2_000, 10_000):
            spark.conf.set(name, str(rows))
            blocks = boosting._stored_blocks(df, F.col("y"), F.xxhash64("id"), F.array(*NAMES), cuts, 0.0, columns, 9_000)
            assert sorted(blocks.map(lambda b: len(b.label)).collect()) == [808] + 4 * [2_048]
    finally:
        spark.conf.set(name, before)


def test_passes_get_names_of_blocks(spark):
    """What a pass sends to the Python workers does not grow with the rows."""
    sent = []
    for n in (4_000, 40_000):
        df = frame(spark, table(n)).coalesce(1)
        cuts = boosting.bin_cuts(df, [F.col(c) for c in NAMES])
        columns = boosting._Columns(np.array([len(c) + 1 for c in cuts]), 1024)
        blocks = boosting._stored_blocks(df, F.col("y"), F.xxhash64("id"), F.array(*NAMES), cuts, 0.0, columns, n)
        sent.append(blocks.mapPartitions(lambda part: [len(pickle.dumps(list(part)))]).max())
        # Each row is in one block, with its own label.
        assert blocks.map(lambda b: (len(b.label), int(b.label.sum()))).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1])) == (
            n, sum(r[-1] for r in table(n))
        )
    assert sent[1] < sent[0] + 10_000


def test_lost_files_of_an_executor_are_made_again(spark, monkeypatch):
    """Tasks that find nothing of the passes before, at any level and round, come to the same trees."""
    settings = replace(SMALL, rounds=23, depth=4, min_hessian=0.5, row_sample=0.8, learning_rate=0.1)
    df = frame(spark, table(3_000, 4)).repartition(3)
    whole = boosting.fit(df, NAMES, "y", "id", settings)
    sums, passes = boosting._Booster.sums, []

    def lossy(self, job):
        passes.append(job)
        if len(passes) % 3 == 0 or job.of.number in (11, 21):
            run = self.run
            self.blocks.foreachPartition(lambda _: boosting._tidy(run))
        return sums(self, job)

    monkeypatch.setattr(boosting._Booster, "sums", lossy)
    again = boosting.fit(df, NAMES, "y", "id", settings)
    assert len(passes) > 60
    for name in ("feature", "cut", "missing_left", "value", "cover", "gain"):
        assert np.array_equal(getattr(whole.trees, name), getattr(again.trees, name))


def test_heavy_weights_are_summed_whole(spark):
    """Units of weights beyond 32 bits; the trees are those of exact search."""
    settings = replace(SMALL, positive_weight=40.0, rounds=2)
    rows = table()
    got = boosting.fit(frame(spark, rows), NAMES, "y", "id", settings).trees
    for t, tree in enumerate(plain_trees(rows, settings)[0]):
        for node, (_, value, cover, _) in tree.items():
            assert got.value[t, node] == pytest.approx(value, abs=1e-5) and got.cover[t, node] == pytest.approx(cover, rel=1e-5)


def test_margins_with_exchanged_features(spark, model):
    rows = materialise(frame(spark, table(300, 8)).withColumns({f"o_{n}": F.reverse(F.array(*NAMES))[i] for i, n in enumerate(NAMES)}), "pairs")
    pairs = with_inputs(rows).withColumn(boosting.EXCHANGED, F.array(*[f"o_{n}" for n in NAMES]))
    got = {r.id: r[boosting.MARGINS] for r in boosting.with_exchanged_margins(model, pairs).collect()}
    for i, name in enumerate([None, *NAMES]):
        inputs = F.array(*[f"o_{n}" if n == name else n for n in NAMES])
        plain = {r.id: r[MARGIN] for r in boosting.with_margin(model, rows.select("id", inputs.alias(INPUTS))).collect()}
        assert {k: v[i] for k, v in got.items()} == plain


# Shapley values


def test_leaves_share_their_lookups():
    """Leaves under few splits are one lookup per feature."""
    trees = Trees.empty(1, 5)
    trees.feature[0, :31], trees.cut[0, :31] = np.arange(31) % 6, 2
    trees.cover[0] = [2.0 ** -int(np.log2(i + 1)) for i in range(63)]
    trees.value[0, 31:] = np.arange(32)
    tree = contributions._Tree(trees, 0, np.full(6, 5))
    assert len(tree.groups) == 4
    assert max(len(table) for _, values in tree.groups for _, table in values) <= 512


def expectation(trees: Trees, t, x, missing, known, node=0):
    """Mean over a tree of a row of bins of which only the features in ``known`` are known."""
    feature = trees.feature[t, node]
    if feature < 0:
        return trees.value[t, node]
    left, right = 2 * node + 1, 2 * node + 2
    if feature in known:
        goes_left = trees.missing_left[t, node] if x[feature] == missing[feature] else x[feature] <= trees.cut[t, node]
        return expectation(trees, t, x, missing, known, left if goes_left else right)
    share = trees.cover[t, left] / trees.cover[t, node]
    return share * expectation(trees, t, x, missing, known, left) + (1 - share) * expectation(trees, t, x, missing, known, right)


def shapley(trees, t, x, missing, width):
    out = np.zeros(width)
    for i in range(width):
        others = [f for f in range(width) if f != i]
        for size in range(width):
            weight = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for known in itertools.combinations(others, size):
                out[i] += weight * (
                    expectation(trees, t, x, missing, {*known, i}) - expectation(trees, t, x, missing, set(known))
                )
    return out


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_contributions_equal_all_subsets(spark, depth):
    """On deep trees features come back on the same path."""
    rows = table(300, 4)
    fitted = boosting.fit(frame(spark, rows), NAMES, "y", "id", replace(SMALL, depth=depth, min_hessian=0.5))
    explain = contributions.Explainer(fitted)
    x = boosting.to_bins(np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows[:12]]), fitted.cuts)
    expected = sum(
        np.array([shapley(fitted.trees, t, row, fitted.missing, 4) for row in x]) for t in range(len(fitted.trees))
    )
    assert np.allclose(explain(x), expected, atol=1e-12)


def test_contributions_add_up(spark, model):
    rows = frame(spark, table(500, 5))
    both = boosting.with_margin(model, with_inputs(rows)).select("id", MARGIN).join(
        contributions.with_contributions(model, with_inputs(rows)), "id"
    )
    found = both.collect()
    assert len(found) == 500
    assert max(abs(r.base_value + sum(r.contributions) - r[MARGIN]) for r in found) < 1e-12
    means = {r.feature: r.mean_abs_contribution for r in contributions.mean_absolute_contributions(model, with_inputs(rows)).collect()}
    values = np.abs(np.array([r.contributions for r in found])).mean(axis=0)
    assert [means[n] for n in NAMES] == pytest.approx(list(values))
    nothing = contributions.mean_absolute_contributions(model, with_inputs(rows.where("false"))).collect()
    assert all(r.mean_abs_contribution is None for r in nothing)


def test_gains(model):
    gains = boosting.mean_gains(model)
    used = model.trees.feature
    assert gains == {n: pytest.approx(model.trees.gain[used == i].mean()) for i, n in enumerate(NAMES)}
    assert boosting.mean_gains(replace(model, trees=Trees.empty(0, 3))) == dict.fromkeys(NAMES, 0.0)
