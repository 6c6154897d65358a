"""Second-order gradient boosting of trees on histograms.

Inputs are binned once, by approximate quantiles of each feature, and stored; a missing value has a bin of its own. A tree grows
level by level. For each level one pass sums gradients and hessians of the logistic loss per (node, feature, bin) in
numpy within the tasks, and the driver, which gets one table of that fixed size, finds the best split of every node. Of two
siblings only the lighter one is summed, the other is what is left of their parent. Each split learns the direction of missing
values. Rows are drawn per tree by a hash of their key, columns per tree.

Gradients are rounded to multiples of 2**-26 and added as integers. The sums, and so the trees, do not depend on
how rows lie in partitions, on the order of tasks or on tasks that run again.

The passes are jobs over an RDD that names blocks of binned rows: a boosting run has rounds times depth of them, one after the
other, and planning a DataFrame takes longer than such a pass over a small table. Blocks are files in the shared folder, which
tasks map; rows never travel to a Python worker again. The margins, which the first pass of a round brings up to date, lie in
files of the executor's own. A task that does not find them, as it runs elsewhere, makes them again from the block and
the trees before.
"""

from __future__ import annotations

import heapq
import os
import pickle
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import new_file, open_folder, shared_files

INPUTS, MARGIN = "_inputs", "_margin"
EXCHANGED, MARGINS = "_exchanged", "_margins"
# A byte holds a bin, so there are at most 254 cuts and a bin for missing values.
MAX_BINS = 254
_ACCURACY = 10_000
_UNIT = 2.0**26
# Rounds whose trees are summed before they go into the margin.
_UPDATE = 10
# Codes of a column of features, below 2**16; rows of a block, numbered in 16 bits, and of a task, at least and at most.
_PACKED, _BLOCK_ROWS, _TASK_ROWS = 1024, (2_048, 1 << 16), (20_000, 1 << 22)
# Splits above leaves that are looked up together, 16 at most.
_SPLITS = 9
# Rows that are walked and summed at a time, as many as a core's cache holds.
_AT_ONCE = 1 << 13
# A worker's first message should be longer than the loopback's segments: short ones wait 40 ms for their acknowledgement.
_PADDING = 1 << 17
# Partitions whose sums the driver adds itself; more are added in tasks first.
_DIRECT = 64
_LEAF = -1


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 100
    depth: int = 6
    learning_rate: float = 0.3
    row_sample: float = 1.0
    column_sample: float = 1.0
    min_hessian: float = 1.0
    positive_weight: float = 1.0
    l2: float = 1.0
    min_gain: float = 1e-6
    bins: int = MAX_BINS
    seed: int = 0


@dataclass
class Trees:
    """Trees as arrays by tree and node; the children of node i are 2 i + 1 (left) and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, trees: int, depth: int) -> Trees:
        shape = (trees, 2 ** (depth + 1) - 1)
        return cls(
            np.full(shape, _LEAF, np.int16), np.zeros(shape, np.uint8), np.zeros(shape, bool),
            np.zeros(shape), np.zeros(shape), np.zeros(shape),
        )

    def __len__(self) -> int:
        return len(self.feature)

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2

    def part(self, start: int, stop: int) -> Trees:
        return Trees(*(a[start:stop] for a in (self.feature, self.cut, self.missing_left, self.value, self.cover, self.gain)))


@dataclass
class Boosted:
    """A fitted ensemble: the cuts of each feature, the margin of no trees at all, and the trees."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: Trees
    settings: BoostSettings = field(default_factory=BoostSettings)

    @property
    def missing(self) -> np.ndarray:
        """The bin of missing values per feature."""
        return np.array([len(c) + 1 for c in self.cuts])


def bin_cuts(rows: DataFrame, inputs: list[Column], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cuts of each input: distinct approximate quantiles above the least value, and the largest value."""
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between 2 and {MAX_BINS}")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    known = [F.when(~F.isnan(c), c) for c in inputs]
    found = rows.agg(*[
        F.struct(F.min(c).alias("least"), F.max(c).alias("most"), F.percentile_approx(c, shares, _ACCURACY).alias("cuts")).alias(f"c{i}")
        for i, c in enumerate(known)
    ]).first()
    return [
        np.array(sorted({v for v in [*(f["cuts"] or []), f["most"]] if v is not None and v > f["least"]}), dtype=float)
        for f in found
    ]


def to_bins(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value, a row per row; a value equal to a cut lies above it."""
    out = np.empty(values.shape, np.uint8)
    for i, c in enumerate(cuts):
        column = values[:, i]
        out[:, i] = np.where(np.isnan(column), len(c) + 1, np.searchsorted(c, column, side="right"))
    return out


class _Columns:
    """Features packed into columns: one with few bins shares the codes of a column with others, in mixed radix.

    A joint histogram of a column has the sums of each of its features as totals, so tasks count columns, not features.
    """

    def __init__(self, missing: np.ndarray, packed: int) -> None:
        self.missing = missing
        widths = missing + 1
        members: list[list[int]] = []
        sizes: list[int] = []
        for f in np.argsort(-widths, kind="stable").tolist():
            at = next((i for i, size in enumerate(sizes) if size * widths[f] <= packed), len(sizes))
            if at == len(sizes):
                members.append([])
                sizes.append(1)
            members[at].append(f)
            sizes[at] *= int(widths[f])
        self.members = members
        # Codes of a column lie below its size, and those of all columns below ``width``.
        self.width = max(sizes, default=1)
        self.column, self.radix = np.zeros(len(widths), np.int64), np.ones(len(widths), np.int64)
        for c, of_column in enumerate(members):
            radix = 1
            for f in of_column:
                self.column[f], self.radix[f] = c, radix
                radix *= int(widths[f])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes by column and row, of bins by row and feature."""
        out = np.zeros((len(self.members), len(x)), np.uint16)
        for f, (c, radix) in enumerate(zip(self.column, self.radix, strict=True)):
            out[c] += x[:, f].astype(np.uint16) * np.uint16(radix)
        return out

    def sums(self, column: int, sums: np.ndarray) -> dict[int, np.ndarray]:
        """The sums by slot and bin of each feature of a column, of sums by slot and code."""
        widths = [int(self.missing[f]) + 1 for f in reversed(self.members[column])]
        joint = sums[:, : int(np.prod(widths))].reshape(-1, *widths)
        axes = range(1, len(widths) + 1)
        return {f: joint.sum(axis=tuple(a for a in axes if a != at)) for at, f in zip(reversed(axes), self.members[column], strict=True)}


def _plain(missing: np.ndarray) -> _Columns:
    """A column for each feature, in their order."""
    columns = _Columns(missing, 0)
    columns.members = [[f] for f in range(len(missing))]
    columns.column, columns.radix = np.arange(len(missing)), np.ones(len(missing), np.int64)
    columns.width = int(missing.max(initial=0)) + 1
    return columns


class _Walk:
    """One tree over rows whose codes are given by column and row."""

    def __init__(self, trees: Trees, t: int, columns: _Columns) -> None:
        self.width, nodes = columns.width, trees.feature.shape[1]
        self.inner = np.flatnonzero(trees.feature[t] >= 0)
        feature = trees.feature[t][self.inner]
        gone = columns.missing[feature][:, None]
        bins = np.arange(self.width) // columns.radix[feature][:, None] % (gone + 1)
        way = np.where(bins == gone, trees.missing_left[t][self.inner][:, None], bins <= trees.cut[t][self.inner][:, None])
        # By inner node and code of its column, whether a row goes left.
        self.left = dict(zip(self.inner.tolist(), way, strict=True))
        self.column = np.zeros(nodes, np.int64)
        self.column[self.inner] = columns.column[feature]
        # The next node by node and code; a leaf leads to itself.
        after = np.repeat(np.arange(nodes)[:, None], self.width, axis=1)
        after[self.inner] = 2 * self.inner[:, None] + 2 - way
        self.after = after.astype(np.min_scalar_type(nodes)).ravel()
        self.levels = int(self.inner[-1] + 1).bit_length() if len(self.inner) else 0

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        return np.concatenate([self.some(codes, rows) for rows in _chunks(codes.shape[1])] or [np.zeros(0, np.int64)])

    def some(self, codes: np.ndarray, rows: slice) -> np.ndarray:
        """The node that each of some rows ends in."""
        n = codes.shape[1]
        if not self.levels:
            return np.zeros(rows.stop - rows.start, np.int64)
        start, flat, row = self.column * n, codes.reshape(-1), np.arange(rows.start, rows.stop)
        node = self.after.take(codes[self.column[0], rows])
        for _ in range(self.levels - 1):
            node = node.astype(np.int64)
            at = start.take(node)
            at += row
            node *= self.width
            node += flat.take(at)
            node = self.after.take(node)
        return node


def _chunks(n: int) -> list[slice]:
    return [slice(first, min(first + _AT_ONCE, n)) for first in range(0, n, _AT_ONCE)]


def walks(trees: Trees, missing: np.ndarray) -> list[_Walk]:
    """All trees over bins given by feature and row."""
    return [_Walk(trees, t, _plain(missing)) for t in range(len(trees))]


def leaf_groups(feature: np.ndarray, node: int = 0, level: int = 0) -> list[list[int]]:
    """The leaves of a subtree in groups on whose paths few splits lie."""
    inside, leaves = [node], []
    splits = level
    for n in inside:
        if feature[n] >= 0:
            splits += 1
            inside += [2 * n + 1, 2 * n + 2]
        else:
            leaves.append(n)
    if splits <= _SPLITS or feature[node] < 0:
        return [leaves]
    return leaf_groups(feature, 2 * node + 1, level + 1) + leaf_groups(feature, 2 * node + 2, level + 1)


def path_to(leaf: int) -> list[tuple[int, bool]]:
    """The nodes above a leaf from the root on, with whether the path goes left there."""
    path = []
    while leaf:
        path.append(((leaf - 1) // 2, leaf % 2 == 1))
        leaf = (leaf - 1) // 2
    return path[::-1]


def both_ways(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Bins by feature and row twice: with missing values above all cuts, and with them below all others, which are one higher."""
    gone = x == missing[:, None].astype(np.uint8)
    return np.concatenate([np.where(gone, np.uint8(255), x), np.where(gone, np.uint8(0), x + np.uint8(1))])


class Pattern:
    """Which of some splits of a tree send a row left, a bit each, the first lowest; 16 splits at most."""

    def __init__(self, trees: Trees, t: int, splits: list[int], width: int) -> None:
        # The row of ``both_ways`` that a split looks at, and the largest bin there that goes left.
        self.ways = [
            (int(trees.feature[t, n]) + width * bool(trees.missing_left[t, n]), np.uint8(trees.cut[t, n] + trees.missing_left[t, n]))
            for n in splits
        ]

    def __call__(self, both: np.ndarray) -> np.ndarray:
        parts = []
        for first in range(0, len(self.ways), 8):
            part = np.zeros(both.shape[1], np.uint8)
            for row, cut in reversed(self.ways[first : first + 8]):
                part += part
                part |= (both[row] <= cut).view(np.uint8)
            parts.append(part)
        out = parts[0].astype(np.intp) if parts else np.zeros(both.shape[1], np.intp)
        if len(parts) > 1:
            out += parts[1].astype(np.intp) << 8
        return out


class Margins:
    """What the trees add up to, looked up by the pattern of splits above each few leaves."""

    def __init__(self, trees: Trees, missing: np.ndarray) -> None:
        self.missing = missing
        self.lookups = []
        for t in range(len(trees)):
            for leaves in leaf_groups(trees.feature[t]):
                paths = {leaf: path_to(leaf) for leaf in leaves}
                splits = sorted({split for path in paths.values() for split, _ in path})
                patterns, table = np.arange(1 << len(splits)), np.zeros(1 << len(splits))
                # A row reaches one leaf of the tree; the groups that do not hold it add nothing.
                for leaf, path in paths.items():
                    here = np.ones(len(patterns), bool)
                    for split, left in path:
                        here &= (patterns >> splits.index(split) & 1) == left
                    table[here] = trees.value[t, leaf]
                self.lookups.append((Pattern(trees, t, splits, len(missing)), table))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The sums for bins by feature and row."""
        both, total = both_ways(x, self.missing), np.zeros(x.shape[1])
        for pattern, table in self.lookups:
            total += table.take(pattern(both), mode="clip")
        return total


def larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have some rows, as a look-up of a few takes as long as that of many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def inputs_of(batch: pa.RecordBatch, width: int, name: str = INPUTS) -> np.ndarray:
    """An array column of inputs as a matrix, with NaN for null."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _drawn(key: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Which rows a tree is fitted on, by a hash of their key."""
    if share >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        z = key + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return z < np.uint64(int(share * 2**64))


@dataclass
class _Block:
    """Rows of a task, in a file of the shared folder: keys, codes by column and row, and labels."""

    file: str
    rows: int
    columns: int
    padding: bytes = b""

    @property
    def name(self) -> str:
        return self.file.rpartition("/")[2]

    def read(self, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, codes and labels, mapped from the file or, if it lies on no disk, from a copy in ``folder``."""
        system, path = open_folder(self.file)
        if not self.file.startswith("file:"):
            source, path = path, f"{folder}/{self.name}"
            if not os.path.exists(path):
                with system.open_input_stream(source) as stream:
                    _replace(path, stream.read())
        data, n = np.asarray(np.memmap(path, np.uint8, "r")), self.rows
        codes = data[8 * n : -n].view(np.uint16).reshape(self.columns, n)
        return data[: 8 * n].view(np.uint64), codes, data[-n:]

    @property
    def label(self) -> np.ndarray:
        return self.read(_own_folder("", self.name))[2]


def _own_folders() -> list[str]:
    """The folders of this executor, which Spark deletes with it."""
    return os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")


def _own_folder(run: str, name: str) -> str:
    """The folder for what a run keeps of a block, its own, as tasks that write to the same folder wait for each other."""
    folders = _own_folders()
    folder = f"{folders[zlib.crc32(name.encode()) % len(folders)]}/boosting{run}/{name}"
    if not os.path.isdir(folder):
        os.makedirs(folder, exist_ok=True)
    return folder


def _replace(path: str, *parts: bytes | np.ndarray) -> None:
    """Write a file that is either whole or not there, also when two tasks write it."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for data in parts:
            out.write(data)
    os.replace(part, path)


def _tidy(run: str) -> None:
    for folder in _own_folders():
        shutil.rmtree(f"{folder}/boosting{run}", ignore_errors=True)


def _dealt(found: list[_Block], tasks: int) -> list[list[_Block]]:
    """Blocks by task, the largest first and each to the task with the fewest rows."""
    dealt: list[list[_Block]] = [[] for _ in range(tasks)]
    rows = [(0, i) for i in range(tasks)]
    for block in sorted(found, key=lambda b: (-b.rows, b.file)):
        n, i = heapq.heappop(rows)
        dealt[i].append(block)
        heapq.heappush(rows, (n + block.rows, i))
    return dealt


def _padded(part: list[_Block]) -> Iterator[_Block]:
    for i, block in enumerate(part):
        yield _Block(block.file, block.rows, block.columns, b"" if i else bytes(_PADDING))


def _stored_blocks(
    rows: DataFrame, label: Column, key: Column, inputs: Column, cuts: list[np.ndarray], base: float, columns: _Columns, count: int,
    folder: str | None = None,
) -> RDD:
    """Blocks of rows, spread evenly over the cores; a few rows are left to fewer of them, as starting a task takes longer."""
    context = rows.sparkSession.sparkContext
    tasks = min(context.defaultParallelism, -(-count // _TASK_ROWS[0]))
    tasks *= -(-count // (tasks * _TASK_ROWS[1]))
    size = min(max(-(-count // (8 * tasks)), _BLOCK_ROWS[0]), _BLOCK_ROWS[1])
    schema = pa.schema([("file", pa.string()), ("rows", pa.int32())])
    uri = folder or shared_files(rows.sparkSession, "binned")

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(part, axis=-1) for part in zip(*held, strict=True)]
            held.clear()
            system, path = new_file(uri, ".block")
            with system.open_output_stream(path) as out:
                for part in parts:
                    out.write(np.ascontiguousarray(part).data)
            name = path.rpartition("/")[2]
            return pa.RecordBatch.from_pylist([{"file": f"{uri}/{name}", "rows": len(parts[0])}], schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - sum(len(h[0]) for h in held))
                at += part.num_rows
                codes = columns.codes(to_bins(inputs_of(part, len(cuts)), cuts))
                y = part.column("label").to_numpy().astype(np.uint8)
                held.append((part.column("key").to_numpy().view(np.uint64), codes, y))
                if sum(len(h[0]) for h in held) == size:
                    yield block()
        if held:
            yield block()

    read = rows.select(inputs.alias(INPUTS), label.cast("int").alias("label"), key.alias("key"))
    written = read.mapInArrow(binned, "file string, rows int").collect()
    found = [_Block(r["file"], r["rows"], len(columns.members)) for r in written]
    return context.parallelize(_dealt(found, tasks), tasks).flatMap(_padded)


@dataclass
class _Round:
    """What tasks need to know of a round: the trees that no margin has yet, and the file with those before them."""

    run: str
    number: int
    seed: int
    recent: Trees
    earlier: str
    base: float
    columns: _Columns
    settings: BoostSettings

    @cached_property
    def last(self) -> _Walk:
        """The walk of the latest tree, made once in a task."""
        return _Walk(self.recent, len(self.recent) - 1, self.columns)


class _Work:
    """A block's rows in a round. Their margins lie in files of the executor's own; what is not there is made again.

    Only the first pass of a round writes, eight bytes a row: more would wait for the disk.
    """

    def __init__(self, block: _Block, of: _Round, walk: _Walk) -> None:
        self.of, self.n, self.walk = of, block.rows, walk
        folder = _own_folder(of.run, block.name)
        self.key, self.codes, self.label = block.read(folder)
        self.path = f"{folder}/{block.name}"
        # The margin, and what the latest trees add to it.
        self.margin = self._margin(of.number - len(of.recent))
        self.latest = self._latest()

    def _kept(self, name: str) -> np.ndarray | None:
        with suppress(FileNotFoundError):
            return np.asarray(np.memmap(f"{self.path}.{name}", np.float64, "r"))
        return None

    def _latest(self) -> np.ndarray:
        of, trees = self.of, self.of.recent
        if not len(trees):
            return np.zeros(self.n)
        kept = self._kept(f"latest{of.number}")
        if kept is not None:
            return kept
        before = self._kept(f"latest{of.number - 1}") if len(trees) > 1 else None
        latest, added = (np.zeros(self.n), trees) if before is None else (before, trees.part(len(trees) - 1, len(trees)))
        ways = [of.last] if len(added) == 1 else [_Walk(added, t, of.columns) for t in range(len(added))]
        out = np.empty(self.n)
        for rows in _chunks(self.n):
            add = latest[rows]
            for t, way in enumerate(ways):
                add = add + added.value[t].take(way.some(self.codes, rows))
            out[rows] = add
        _replace(f"{self.path}.latest{of.number}", out)
        if len(trees) == _UPDATE:
            _replace(f"{self.path}.margin{of.number}", self.margin + out)
        # What only the rounds before needed.
        before, done = of.number - 1, of.number - len(trees)
        for name in (f"latest{before}", *[f"margin{done - _UPDATE}"] * (len(trees) == 1)):
            with suppress(FileNotFoundError):
                os.remove(f"{self.path}.{name}")
        return out

    def _margin(self, rounds: int) -> np.ndarray:
        """The margin of the trees of some rounds, a multiple of those after which it is brought up to date."""
        margin = self._kept(f"margin{rounds}") if rounds else np.full(self.n, self.of.base)
        if margin is None:
            system, path = open_folder(self.of.earlier)
            with system.open_input_stream(path) as stream:
                trees = pickle.loads(stream.read())
            margin = np.full(self.n, self.of.base)
            for first in range(0, rounds, _UPDATE):
                latest = np.zeros(self.n)
                for t in range(first, first + _UPDATE):
                    latest = latest + trees.value[t].take(_Walk(trees, t, self.of.columns)(self.codes))
                margin = margin + latest
            _replace(f"{self.path}.margin{rounds}", margin)
        return margin

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and hessians of some rows in whole units."""
        margin, y = self.margin.take(rows) + self.latest.take(rows), self.label.take(rows)
        p, weight = 1 / (1 + np.exp(-margin)), np.where(y == 1, self.of.settings.positive_weight, 1.0)
        return np.rint(weight * (p - y) * _UNIT), np.rint(weight * np.maximum(p * (1 - p), 1e-16) * _UNIT)

    def members(self, wanted: dict[int, int]) -> list[np.ndarray]:
        """The rows of the wanted nodes on which the tree is fitted, found on the ways that lead to them."""
        on_way = {n for node in wanted for n in _ancestors(node)}
        found = {0: np.flatnonzero(_drawn(self.key, self.of.seed, self.of.settings.row_sample)).astype(np.uint16)}
        for node in sorted(on_way):
            rows = found.pop(node)
            goes = self.walk.left[node].take(self.codes[self.walk.column[node]].take(rows))
            for child, way in ((2 * node + 1, goes), (2 * node + 2, ~goes)):
                if child in on_way or child in wanted:
                    found[child] = rows.compress(way)
        return [found[node] for node in wanted]


def _ancestors(node: int) -> list[int]:
    out = []
    while node:
        node = (node - 1) // 2
        out.append(node)
    return out


@dataclass
class _Pass:
    """Sums of gradients and hessians of some nodes of the tree that grows."""

    tree: Trees
    slots: dict[int, int]
    chosen: np.ndarray
    of: _Round

    def __call__(self, blocks: Iterator[_Block]) -> Iterator[np.ndarray]:
        columns, width = self.of.columns, self.of.columns.width
        counted = sorted({int(columns.column[f]) for f in self.chosen})
        size = len(self.slots) * width
        # Sums of whole numbers, exact below 2**53, which the rows of a task do not reach.
        sums = np.zeros((2, len(counted), size))
        walk = _Walk(self.tree, 0, columns)
        # Rows are held until they are enough to be worth a table of sums.
        room, held = max(_AT_ONCE, size), 0
        codes, place, values = np.empty((len(counted), room), np.uint16), np.empty(room, np.intp), np.empty((2, room))

        def count() -> None:
            for i in range(len(counted)):
                at = codes[i, :held] + place[:held] if len(self.slots) > 1 else codes[i, :held].astype(np.intp)
                for total, value in zip(sums, values, strict=True):
                    total[i] += np.bincount(at, value[:held], size)

        for block in blocks:
            work = _Work(block, self.of, walk)
            found = work.members(self.slots)
            rows = np.concatenate(found).astype(np.intp)
            slot = np.repeat([slot * width for slot in self.slots.values()], [len(part) for part in found])
            done = 0
            while done < len(rows):
                some = rows[done : done + room - held]
                to = slice(held, held + len(some))
                for i, c in enumerate(counted):
                    work.codes[c].take(some, out=codes[i, to], mode="clip")
                values[0, to], values[1, to] = work.values(some)
                place[to] = slot[done : done + len(some)]
                done, held = done + len(some), to.stop
                if held == room:
                    count()
                    held = 0
        if held:
            count()
        parts = {
            f: np.stack(both, axis=0)
            for i, c in enumerate(counted)
            for f, both in _paired(*[columns.sums(c, total[i].astype(np.int64).reshape(len(self.slots), width)) for total in sums])
        }
        yield np.concatenate([parts[f] for f in self.chosen.tolist()], axis=2)


def _paired(one: dict, other: dict) -> list[tuple]:
    return [(f, (one[f], other[f])) for f in one]


def _add(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return one + other


def _score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


@dataclass
class _Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: tuple[float, float]


def best_split(sums: np.ndarray, columns: np.ndarray, offsets: np.ndarray, cuts: list[np.ndarray], settings: BoostSettings) -> _Split | None:
    """The split of a node with the largest gain; of equal ones that of the first feature and least cut."""
    best = None
    for feature, offset in zip(columns, offsets, strict=True):
        n = len(cuts[feature])
        if not n:
            continue
        part = sums[:, offset : offset + n + 2] / _UNIT
        total, gone = part.sum(axis=1), part[:, -1]
        below = np.cumsum(part[:, :n], axis=1)
        for missing_left in (False, True):
            g, h = below + (gone[:, None] if missing_left else 0)
            rest_g, rest_h = total[0] - g, total[1] - h
            gain = _score(g, h, settings.l2) + _score(rest_g, rest_h, settings.l2) - _score(*total, settings.l2)
            gain = np.where((h >= settings.min_hessian) & (rest_h >= settings.min_hessian), gain, -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > (best.gain if best else settings.min_gain):
                best = _Split(float(gain[at]), int(feature), at, missing_left, (float(g[at]), float(h[at])))
    return best


class _Booster:
    def __init__(self, blocks: RDD, model: Boosted, columns: _Columns, folder: str) -> None:
        self.blocks, self.model, self.settings = blocks, model, model.settings
        self.columns, self.folder, self.run = columns, folder, uuid.uuid4().hex
        self.earlier = ""

    def sums(self, job: _Pass) -> np.ndarray:
        parts = self.blocks.mapPartitions(job)
        return parts.reduce(_add) if parts.getNumPartitions() <= _DIRECT else parts.treeReduce(_add, 2)

    def round(self, t: int, seed: int) -> _Round:
        """Round ``t`` after the trees before it, of which all but the latest are stored for tasks that lack a margin."""
        first = max(t - 1, 0) // _UPDATE * _UPDATE
        if first and first == t - 1:
            system, path = new_file(self.folder, ".trees")
            with system.open_output_stream(path) as out:
                out.write(pickle.dumps(self.model.trees.part(0, first)))
            self.earlier = f"{self.folder}/{path.rpartition('/')[2]}"
        return _Round(
            self.run, t, seed, self.model.trees.part(first, t), self.earlier, self.model.base, self.columns, self.settings
        )

    def grow(self, t: int) -> None:
        """Fit tree ``t``, level by level."""
        settings, cuts, trees = self.settings, self.model.cuts, self.model.trees
        random = np.random.default_rng([settings.seed, t])
        count = max(1, round(settings.column_sample * len(cuts)))
        columns = np.sort(random.choice(len(cuts), count, replace=False))
        widths = np.array([len(cuts[c]) + 2 for c in columns])
        offsets = np.concatenate([[0], np.cumsum(widths)[:-1]])
        seed = int(random.integers(2**31))
        tree, this = trees.part(t, t + 1), self.round(t, seed)
        known: dict[int, np.ndarray] = {}
        # Nodes to be split, and those to be summed, each with the sibling that follows from it.
        wanted: dict[int, int | None] = {0: None}
        for level in range(settings.depth):
            job = _Pass(tree, {n: i for i, n in enumerate(wanted)}, columns, this)
            summed = self.sums(job)
            for i, (node, sibling) in enumerate(wanted.items()):
                known[node] = summed[:, i]
                if sibling is not None:
                    known[sibling] = known[(node - 1) // 2] - summed[:, i]
            wanted = {}
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                if node not in known:
                    continue
                total = known[node][:, : widths[0]].sum(axis=1) / _UNIT
                if node == 0:
                    self._settle(tree, node, *total)
                split = best_split(known[node], columns, offsets, cuts, settings)
                if split is None:
                    continue
                tree.feature[0, node], tree.cut[0, node] = split.feature, split.cut
                tree.missing_left[0, node], tree.gain[0, node] = split.missing_left, split.gain
                left, right = 2 * node + 1, 2 * node + 2
                self._settle(tree, left, *split.left)
                self._settle(tree, right, total[0] - split.left[0], total[1] - split.left[1])
                light, heavy = (left, right) if tree.cover[0, left] <= tree.cover[0, right] else (right, left)
                wanted[light] = heavy
            if not wanted:
                break

    def _settle(self, tree: Trees, node: int, g: float, h: float) -> None:
        tree.cover[0, node] = h
        tree.value[0, node] = -g / (h + self.settings.l2) * self.settings.learning_rate


def fit(
    rows: DataFrame, features: list[str], label: str, key: str, settings: BoostSettings = BoostSettings()
) -> Boosted:
    """Fit an ensemble to ``rows``: numeric ``features``, 0/1 ``label`` and a unique ``key`` that rows are drawn by.

    Null and NaN are missing values. Without rows, or with one class alone, the ensemble has no trees.
    """
    inputs = [F.col(f).cast("double") for f in features]
    rows = rows.where(F.col(label).isNotNull())
    positive, count = rows.agg(F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)), F.count("*")).first()
    weight = positive * settings.positive_weight
    mixed = 0 < positive < count
    base = float(np.log(weight / (count - positive))) if mixed else float(positive > 0) * 20 - 10 if count else 0.0
    cuts = bin_cuts(rows, inputs, settings.bins)
    model = Boosted(list(features), cuts, base, Trees.empty(settings.rounds if mixed else 0, settings.depth), settings)
    if not mixed:
        return model
    columns = _Columns(model.missing, _PACKED)
    folder = shared_files(rows.sparkSession, "binned")
    blocks = _stored_blocks(rows, F.col(label), F.xxhash64(key), F.array(*inputs), cuts, base, columns, count, folder)
    booster = _Booster(blocks.persist(StorageLevel.MEMORY_AND_DISK), model, columns, folder)
    for t in range(settings.rounds):
        booster.grow(t)
    run = booster.run
    blocks.foreachPartition(lambda _: _tidy(run))
    blocks.unpersist()
    system, path = open_folder(folder)
    system.delete_dir(path)
    return model


def bins_of(batch: pa.RecordBatch, column: str, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins by feature and row."""
    return np.ascontiguousarray(to_bins(inputs_of(batch, len(cuts), column), cuts).T)


def with_margin(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with the ensemble's margin in place of the array column ``_inputs``."""
    others = [f for f in df.schema.fields if f.name != INPUTS]
    cuts, trees, base, missing = model.cuts, model.trees, model.base, model.missing

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = Margins(trees, missing)
        for batch in larger(batches):
            margin = base + margins(bins_of(batch, INPUTS, cuts))
            columns = [batch.column(f.name) for f in others] + [pa.array(margin)]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in others], MARGIN])

    return df.mapInArrow(scored, T.StructType([*others, T.StructField(MARGIN, T.DoubleType())]))


def with_exchanged_margins(model: Boosted, df: DataFrame) -> DataFrame:
    """``df`` with the margins of its rows in place of the array columns ``_inputs`` and ``_exchanged``.

    The array ``_margins`` holds the margin itself, then for each feature that with this feature from ``_exchanged``. A tree
    is walked again for the features it uses only.
    """
    others = [f for f in df.schema.fields if f.name not in (INPUTS, EXCHANGED)]
    cuts, trees, base, missing = model.cuts, model.trees, model.base, model.missing

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = walks(trees, missing)
        for batch in batches:
            x, other = bins_of(batch, INPUTS, cuts), bins_of(batch, EXCHANGED, cuts)
            total = np.zeros((1 + len(cuts), batch.num_rows))
            for t, walk in enumerate(found):
                used = set(trees.feature[t][walk.inner].tolist())
                plain = trees.value[t].take(walk(x))
                total[0] += plain
                for f in range(len(cuts)):
                    if f in used:
                        own = x[f].copy()
                        x[f] = other[f]
                        total[1 + f] += trees.value[t].take(walk(x))
                        x[f] = own
                    else:
                        total[1 + f] += plain
            lists = pa.FixedSizeListArray.from_arrays((base + total).T.ravel(), len(total)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in others] + [lists], [*[f.name for f in others], MARGINS])

    return df.mapInArrow(scored, T.StructType([*others, T.StructField(MARGINS, T.ArrayType(T.DoubleType()))]))


def mean_gains(model: Boosted) -> dict[str, float]:
    """Mean gain of the splits on each feature, 0 for one that no tree uses."""
    used, gain = model.trees.feature, model.trees.gain
    return {
        name: float(gain[used == i].mean()) if (used == i).any() else 0.0 for i, name in enumerate(model.features)
    }
