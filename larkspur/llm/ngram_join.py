"""Operator 3: Jaccard self-join of word shingle sets with count vectors in an R-tree.

Every shingle is hashed into one of a power of two of groups, a quarter as many as the set has shingles or more; the counts per group
are the set's point. The sum of two points' coordinate minima bounds the overlap of their sets from above, after the finer
point is folded to the groups of the other, and the coordinate maxima of a tree node bound all points below it. Pairs and
subtrees whose bound is too low are dropped, all others are verified on the sets themselves. Trees hold points of one number of
groups; sets alike enough in size have the same number or one has twice the other's.

1. Shingles that many documents hold are counted, in bounded memory, by chunks of documents; such a list only sets an order.
2. Two sets with a similarity of 0.75 share a shingle among the first quarter of each in any common order. In the order by
   number of holders, rare ones first, that shingle is rare, and passages that many share are met by no one. Pairs of such
   buckets whose points allow a link, and in buckets of more than ``LEAF`` sets those with the member that has the fewest
   rare shingles, are edges. Large buckets that these leave in several pieces go through trees of points.
3. What the edges connect is a family; all links lie within families. A family's sets are cut into blocks by hash, and each two
   blocks are a task: a tree over each, pairs of nodes that may hold a link, and every remaining pair of sets verified at once by
   a product of shingle indicators. A task gives, per member, its links and the member that stands for its piece, so its
   output is as long as its input. Links add up per set, and the pieces' stars give the components.

Equal sets are one node from the start, so copies are never paired: their number counts in ``n_links``, the number
of other documents that a document links with. The sets of nodes and shingles are 64-bit hashes; two different ones with the same
hash would be taken for one. ``LEAF``, ``BLOCK``, ``FREQUENT``, ``CHUNK`` and the size of the filter of rows set the work and no result.

Null and empty texts have no shingles and are linked with nothing: their component is their own id. Very long texts are whole
sets like others. Rows with the same text and id are one node and appear once each in the result. The component's id is its
smallest id that is not null. An empty table gives no rows. Extra columns are not read. The table is read twice and must give the
same rows in the same partitions, as files do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import read_table, small_batches, stored, tidy, utf8
from larkspur.llm.components import connected_components
from larkspur.session import discard

WORDS = 5
# Least and most groups of a point.
GROUPS = (32, 16_384)
# Sets in a leaf of the tree, children of an inner node, and shingles in a block of a family.
LEAF, FANOUT = 32, 8
BLOCK = 2_000_000
# Numbers in an array that a task makes when it compares.
_CELLS = 4_000_000
# Shingles that are counted together, those of them that are told, and those listed as frequent in the end.
CHUNK, TOLD = 4_000_000, 3
FREQUENT = 500_000
# Bits of the filter of rows whose sets are wanted.
FILTER_BITS = 1 << 25
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NODE = "row bigint, doc_id bigint, node bigint, n bigint, point binary, keys array<bigint>"
_U64 = np.uint64


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words)) - (1 << 63)], dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U64, count=len(words))
    rolled = np.zeros(len(words) - WORDS + 1, dtype=_U64)
    for i in range(WORDS):
        rolled = rolled * _U64(0x9E3779B97F4A7C15) + hashes[i : i + len(rolled)]
        rolled ^= rolled >> _U64(29)
    rolled = (rolled ^ rolled >> _U64(32)) * _U64(0xBF58476D1CE4E5B9)
    return np.unique((rolled ^ rolled >> _U64(31)).view(np.int64))


def node_of(keys: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(keys.tobytes()) - (1 << 63)


def prefix_size(n: int) -> int:
    """So many first shingles that two sets of similarity 0.75 share one of them."""
    return n - -(-3 * n // 4) + 1


# Points


def group_counts(keys: np.ndarray) -> np.ndarray:
    """Shingles per group, at most 255; the bound allows for counts cut there."""
    groups = min(max(1 << (len(keys) // 4).bit_length(), GROUPS[0]), GROUPS[1])
    at = (keys.view(_U64) >> _U64(13)) & _U64(groups - 1)
    return np.minimum(np.bincount(at.astype(np.int64), minlength=groups), 255).astype(np.uint8)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points, a row each, over fewer groups; a cut coordinate stays one that says nothing."""
    if points.shape[-1] == groups:
        return points
    parts = points.reshape(len(points), -1, groups)
    sums = parts.sum(axis=1, dtype=np.int64)
    return np.where((parts == 255).any(axis=1), 255, np.minimum(sums, 255)).astype(np.uint8)


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The smallest intersection with 100 * intersection >= 75 * union."""
    return -(-3 * (n + m) // 7)


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the summed coordinate minima of points ``a`` and ``b`` reach the overlap that sizes n and m need."""
    least = np.minimum(a, b)
    bound = least.sum(axis=-1, dtype=np.int32)
    # A coordinate cut in both points says nothing.
    return (bound >= least_overlap(n, m)) | (least == 255).any(axis=-1)


def alike_in_size(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)


class Tree:
    """A packed R-tree: points in leaves of ``LEAF``, inner nodes over ``FANOUT`` children; nodes keep maxima and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # Slabs by size, each sorted by its widest coordinate: similar points share leaves.
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, LEAF * int((len(order) / LEAF) ** 0.5))
        parts = []
        for start in range(0, len(order), slab):
            part = order[start : start + slab]
            widest = int(np.ptp(points[part].astype(np.int64), axis=0).argmax())
            parts.append(part[np.argsort(points[part][:, widest], kind="stable")])
        self.order = np.concatenate(parts)
        self.leaves = [self.order[i : i + LEAF] for i in range(0, len(self.order), LEAF)]
        bounds = [(points[x].max(axis=0), sizes[x].min(), sizes[x].max()) for x in self.leaves]
        # Levels from the leaves up to a single root.
        self.levels = [tuple(np.array(x) for x in zip(*bounds, strict=True))]
        while len(self.levels[-1][0]) > 1:
            most, low, high = self.levels[-1]
            starts = np.arange(0, len(most), FANOUT)
            self.levels.append(
                (np.maximum.reduceat(most, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts))
            )

    def leaf_pairs(self, other: Tree, same: bool) -> list[np.ndarray]:
        """Per leaf the leaves of ``other`` that may hold a link with it, found from the roots down."""
        while len(other.levels) < len(self.levels):
            other.levels.append(other.levels[-1])
        mine = self.levels + [self.levels[-1]] * (len(other.levels) - len(self.levels))
        pairs = np.zeros((1, 2), np.int64)
        for level in range(len(mine) - 1, -1, -1):
            (a, low, high), (b, low2, high2) = mine[level], other.levels[level]
            kept = [np.empty((0, 2), np.int64)]
            step = max(1, _CELLS // a.shape[1])
            for start in range(0, len(pairs), step):
                i, j = pairs[start : start + step].T
                sized = (3 * low[i] <= 4 * high2[j]) & (3 * low2[j] <= 4 * high[i])
                i, j = i[sized], j[sized]
                near = may_link(a[i], b[j], low[i], low2[j])
                kept.append(np.stack([i[near], j[near]], axis=1))
            pairs = np.concatenate(kept)
            if same:
                pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
            if level:
                down = [self._children(mine, level, pairs[:, 0]), self._children(other.levels, level, pairs[:, 1])]
                pairs = np.array(
                    [(x, y) for xs, ys in zip(*down, strict=True) for x in xs for y in ys], np.int64
                ).reshape(-1, 2)
        return [pairs[pairs[:, 0] == i, 1] for i in range(len(self.leaves))]

    @staticmethod
    def _children(levels: list[tuple], level: int, nodes: np.ndarray) -> list[range]:
        below = len(levels[level - 1][0])
        if below == len(levels[level][0]):
            return [range(n, n + 1) for n in nodes.tolist()]
        return [range(n * FANOUT, min((n + 1) * FANOUT, below)) for n in nodes.tolist()]


# Counting and buckets


def _tally(batches: Iterator[np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
    """Keys with ``least`` occurrences or more in a chunk, and their number there."""
    held: list[np.ndarray] = []
    size = 0

    def told() -> pa.RecordBatch:
        keys = np.concatenate([np.empty(0, np.int64), *held])
        held.clear()
        keys.sort()
        starts = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(starts, len(keys)))
        many = counts >= least
        return pa.RecordBatch.from_arrays([pa.array(keys[starts[many]]), pa.array(counts[many])], ["key", "held"])

    for keys in batches:
        held.append(keys)
        size += len(keys)
        if size >= CHUNK:
            yield told()
            size = 0
    yield told()


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _tally((shingles(t) for b in batches for t in b["utf8"].to_pylist()), TOLD)


def _prefix_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _tally((b["keys"].flatten().to_numpy() for b in batches), LEAF // 2)


class _Listed:
    """Keys with their numbers, at most ``limit`` of them, for all tasks."""

    def __init__(self, told: DataFrame, least: int, limit: int, name: str) -> None:
        counted = told.groupBy("key").agg(F.sum("held").alias("count")).where(f"count >= {least}")
        listed = stored(counted, name).orderBy(F.desc("count"), "key").limit(limit).toArrow()
        keys, counts = (listed[c].to_numpy() for c in ("key", "count"))
        order = np.argsort(keys)
        self._value = told.sparkSession.sparkContext.broadcast((keys[order].copy(), counts[order].copy()))

    def weights(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, 0 for one that is not listed."""
        known, counts = self._value.value
        if not len(known):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, counts[at], 0)


def _sets(frequent: _Listed):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Node, size, point and prefix of each document; point and prefix once for each set of a task."""
        seen = set()
        for batch in batches:
            nodes, sizes, points, prefixes = [], [], [], []
            for text in batch["utf8"].to_pylist():
                keys = shingles(text)
                node = node_of(keys) if len(keys) else None
                nodes.append(node)
                sizes.append(len(keys))
                first = node is not None and node not in seen
                seen.add(node)
                points.append(group_counts(keys).tobytes() if first else None)
                order = np.argsort(frequent.weights(keys), kind="stable")[: prefix_size(len(keys))] if first else None
                prefixes.append(keys[order] if first else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"], batch["doc_id"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(points, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "node", "n", "point", "keys"],
            )

    return found


def _prefix_rows(hot: _Listed, wanted: bool):
    """Rows (key, node, n, place) of prefixes whose key is hot or is not."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["keys"]
            keys, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            chosen = (hot.weights(keys) > 0) == wanted
            places = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [keys, *[np.repeat(batch[c].to_numpy(), lengths) for c in ("node", "n")], places]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            arrays = [pa.array(c[chosen].astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "n", "place"])

    return found


def _pairs_in(nodes: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket whose sizes and places in the order allow a similarity of 0.75.

    ``nodes`` are (node, size, place of the bucket's shingle). The test of places holds for the first shingle that two
    prefixes share; a pair that fails it here has been met in an earlier bucket.
    """
    nodes = sorted(nodes, key=lambda x: x[1])
    for i, (a, n, p) in enumerate(nodes):
        for b, m, q in nodes[i + 1 :]:
            if 4 * n < 3 * m:
                break
            if 7 * (1 + min(n - p, m - q) - 1) >= 3 * (n + m):
                yield (a, b) if a < b else (b, a)


def _buckets(leaf: int):
    """Reads rows (key, node, n, place) sorted by key; gives pairs of small buckets and the rows of large ones."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int, int]] = {}
        current, large = None, False
        out: list[tuple] = []

        def flush() -> None:
            if large:
                out.extend((a, None, current, n, place) for a, n, place in held.values())
            elif len(held) > 1:
                out.extend((a, b, None, None, None) for a, b in _pairs_in(list(held.values())))

        for batch in batches:
            columns = [batch[c].to_numpy() for c in ("key", "node", "n", "place")]
            keys = columns[0]
            # Only runs of equal keys are looked at row by row; most keys are alone.
            same = np.flatnonzero(keys[1:] == keys[:-1])
            wanted = np.unique(np.concatenate([same, same + 1, [0, len(keys) - 1]])) if len(keys) else same
            for key, node, n, place in zip(*(c[wanted].tolist() for c in columns), strict=True):
                if key != current:
                    flush()
                    held, current, large = {}, key, False
                held[node] = (node, n, place)
                if len(held) > leaf:
                    large = True
                    out.extend((a, None, current, m, p) for a, m, p in held.values())
                    held = {}
                if len(out) > 50_000:
                    yield _rows(out)
                    out = []
        flush()
        yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        arrays = [pa.array([o[i] for o in out], pa.int64()) for i in range(5)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "large", "n", "place"])

    return found


def bucket_pairs(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """From (key, node, n, place): candidate pairs (a, b), or (a, null, key, n, place) for members of large buckets."""
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(_buckets(leaf)), "a bigint, b bigint, large bigint, n bigint, place bigint")


def _rows_of_points(column: list[bytes]) -> dict[int, list[int]]:
    """Indices of points by their number of groups."""
    found: dict[int, list[int]] = {}
    for i, point in enumerate(column):
        found.setdefault(len(point), []).append(i)
    return found


def _stacked(points: list[bytes], groups: int | None = None) -> np.ndarray:
    """Points as rows over the fewest groups that any of them has, or over ``groups``."""
    by_size = _rows_of_points(points)
    groups = groups or min(by_size)
    out = np.empty((len(points), groups), np.uint8)
    for size, at in by_size.items():
        out[at] = folded(np.frombuffer(b"".join(points[i] for i in at), np.uint8).reshape(-1, size), groups)
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose points allow a link."""
    for batch in batches:
        left, right = batch["p"].to_pylist(), batch["q"].to_pylist()
        n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
        near = np.zeros(len(batch), bool)
        groups = np.minimum([len(p) for p in left], [len(q) for q in right])
        for size in np.unique(groups):
            at = np.flatnonzero(groups == size)
            p, q = _stacked([left[i] for i in at], size), _stacked([right[i] for i in at], size)
            near[at] = may_link(p, q, n[at], m[at]) & alike_in_size(n[at], m[at])
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct pairs whose points allow a link."""
    left = points.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("point").alias("p"))
    right = points.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("point").alias("q"))
    joined = pairs.select("a", "b").where("a <> b").distinct().join(left, "a").join(right, "b")
    return joined.select("a", "b", "n", "m", "p", "q").mapInArrow(_near, "a bigint, b bigint")


# Joins of blocks


class Block:
    """Members of one or two blocks of a group: node, size, point, copies, side, and sets where links are verified."""

    def __init__(
        self, nodes, sizes, points: list[bytes], copies, second, sets: list[np.ndarray] | None = None, roots=None
    ) -> None:
        self.nodes, self.sizes, self.copies = np.asarray(nodes), np.asarray(sizes, np.int64), np.asarray(copies, np.int64)
        self.point_of = points
        self.groups = np.array([len(p) for p in points])
        self.second = np.asarray(second, bool)
        self.links = np.zeros(len(self.nodes), np.int64)
        self.ids: list[np.ndarray] | None = None
        if sets is not None:
            # Shingles as small numbers; those of one member alone meet nothing.
            known, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = counts > 1
            number = np.where(shared, np.cumsum(shared) - 1, -1)[places]
            ends = np.cumsum([len(s) for s in sets])
            self.ids = [part[part >= 0] for part in np.split(number, ends[:-1])]
            self.place = np.full(int(shared.sum()), -1)
        # Pieces by their least member; pairs within a piece known before are skipped where links are not counted.
        self.piece = np.arange(len(self.nodes))
        if roots is not None:
            _, first, place = np.unique(np.asarray(roots), return_index=True, return_inverse=True)
            self.piece = first[place]

    def join(self, same: bool) -> None:
        """All members with each other, or those of the first block with those of the second."""
        own, other = np.flatnonzero(~self.second), np.flatnonzero(self.second)
        if same:
            other = own
        for groups in np.unique(self.groups[own]).tolist():
            mine = own[self.groups[own] == groups]
            # With itself each number of groups is met once, and with twice as many once.
            for others in (groups, 2 * groups) if same else (groups // 2, groups, 2 * groups):
                theirs = other[self.groups[other] == others]
                if len(theirs):
                    self._join(mine, theirs, same and others == groups, min(groups, others))

    def _join(self, own: np.ndarray, other: np.ndarray, same: bool, groups: int) -> None:
        members = own if same else np.concatenate([own, other])
        points = _stacked([self.point_of[i] for i in members], groups)
        self.row = dict(zip(members.tolist(), range(len(members)), strict=True))
        self.points = points
        if len(own) <= LEAF and len(other) <= LEAF:
            self._meet(own, other, same)
            return
        tree = Tree(points[: len(own)], self.sizes[own])
        partner = tree if same else Tree(points[len(own) :], self.sizes[other])
        for i, leaves in enumerate(tree.leaf_pairs(partner, same)):
            if len(leaves):
                a = own[tree.leaves[i]]
                b = np.concatenate([other[partner.leaves[j]] for j in leaves])
                step = max(1, _CELLS // (LEAF * groups))
                for start in range(0, len(b), step):
                    self._meet(a, b[start : start + step], same)

    def _points(self, members: np.ndarray) -> np.ndarray:
        return self.points[[self.row[i] for i in members.tolist()]]

    def _meet(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Links of the members ``a`` of a leaf with members ``b``."""
        n, m = self.sizes[a][:, None], self.sizes[b][None, :]
        near = alike_in_size(n, m)
        if same:
            # Within one leaf each pair comes twice; between leaves once, the first leaf on the left.
            inside = np.isin(b, a)
            near &= ~inside[None, :] | (a[:, None] < b[None, :])
        if self.ids is None:
            near &= self.piece[a][:, None] != self.piece[b][None, :]
        if not near.any():
            return
        near &= may_link(self._points(a)[:, None, :], self._points(b)[None, :, :], n, m)
        if self.ids is not None and near.any():
            near &= self._verified(a, b, n, m)
            self.links[a] += near @ self.copies[b]
            self.links[b] += self.copies[a] @ near
        for i in np.flatnonzero(near.any(axis=1)):
            pieces = np.unique(self.piece[np.append(b[near[i]], a[i])])
            if len(pieces) > 1:
                self.piece[np.isin(self.piece, pieces)] = pieces[0]

    def _verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Which pairs have a similarity of 0.75 or more, by a product of their indicators of the shingles of ``a``."""
        left = [self.ids[i] for i in a]
        columns = np.unique(np.concatenate(left))
        self.place[columns] = np.arange(len(columns))
        cells = [self._cells(ids) for ids in (left, [self.ids[j] for j in b])]
        self.place[columns] = -1
        common = np.zeros((len(a), len(b)), np.int64)
        step = max(1, _CELLS // max(len(a), len(b)))
        for start in range(0, len(columns), step):
            width = min(step, len(columns) - start)
            one, other = (self._indicators(rows, at - start, count, width) for (rows, at), count in zip(cells, common.shape, strict=True))
            common += (one @ other.T).astype(np.int64)
        return 100 * common >= 75 * (n + m - common)

    def _cells(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = self.place[np.concatenate(ids)]
        return np.repeat(np.arange(len(ids)), [len(x) for x in ids])[at >= 0], at[at >= 0]

    @staticmethod
    def _indicators(rows: np.ndarray, at: np.ndarray, count: int, width: int) -> np.ndarray:
        out = np.zeros((count, width), np.float32)
        here = (at >= 0) & (at < width)
        out[rows[here], at[here]] = 1
        return out

    def rows(self) -> pa.RecordBatch:
        """Per member its links here and the node that stands for its piece."""
        arrays = [self.nodes, self.links, self.nodes[self.piece]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["node", "links", "piece"])


_MEMBER = "node bigint, links bigint, piece bigint"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins groups of rows sorted by (group, first, second), each of which is two blocks or one."""
    held: dict[str, list] = {}
    current = None

    def result() -> pa.RecordBatch:
        sets = [np.frombuffer(s, np.int64) for s in held["shingles"]] if held["shingles"][0] is not None else None
        second = [b != current[1] for b in held["block"]]
        roots = held["root"] if held["root"][0] is not None else None
        block = Block(held["node"], held["n"], held["point"], held["copies"], second, sets, roots)
        block.join(current[1] == current[2])
        return block.rows()

    for batch in batches:
        names = batch.schema.names
        columns = [batch[c].to_pylist() for c in names]
        keys = list(zip(*(columns[names.index(c)] for c in ("group", "first", "second")), strict=True))
        starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for start, stop in zip(starts, starts[1:]):
            if start == stop:
                continue
            if keys[start] != current:
                if current is not None:
                    yield result()
                held, current = {name: [] for name in names}, keys[start]
            for name, column in zip(names, columns, strict=True):
                held[name] += column[start:stop]
    if current is not None:
        yield result()


def with_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members (group, node, n, ...) with the number of blocks that their group is cut into, by its shingles."""
    sizes = members.groupBy("group").agg(F.expr(f"(sum(n) - 1) div {block} + 1").alias("blocks"))
    return members.join(sizes, "group")


def join_blocks(members: DataFrame) -> DataFrame:
    """From (group, blocks, node, n, point, copies, shingles, root): links and pieces of each member, a row per pair of blocks.

    With ``shingles`` links are verified and counted; without, points that allow a link are joined, unless their
    ``root`` is one. A member goes into as many tasks as its group has blocks.
    """
    dealt = (
        members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .drop("blocks", "other")
    )
    order = ["group", "first", "second"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidy(_joined), _MEMBER)


def _edges(joined: DataFrame) -> DataFrame:
    return joined.where("node <> piece").select(F.col("node").alias("a"), F.col("piece").alias("b"))


def _families(large: DataFrame, cold: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """Roots of the pieces that edges ``cold`` and those within large buckets (key, node, n, place) connect."""
    # The member with the fewest rare shingles is the likeliest origin of the others.
    centre = large.groupBy("key").agg(F.min_by("node", F.struct("place", "n", "node")).alias("centre"))
    stars = large.join(centre, "key").where("node <> centre").select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
    )
    edges = stored(_bounded(stars, points).unionByName(cold), "edges")
    roots = stored(connected_components(edges), "roots")
    labelled = large.select("key", "node").distinct().join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root")
    )
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    members = labelled.join(mixed.select("key"), "key").join(points.drop("row"), "node").withColumnRenamed("key", "group")
    plain = {"copies": F.lit(1).cast("bigint"), "shingles": F.lit(None).cast("binary")}
    found = stored(_edges(join_blocks(with_blocks(members, block).withColumns(plain))), "bucket_edges")
    families = roots if found.isEmpty() else stored(connected_components(edges.unionByName(found)), "roots")
    discard(edges, labelled, found)
    return families


def _with_sets(texts: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """``members``, which name a row each, with the ``shingles`` of that row.

    Tasks know by a filter of fixed size which rows may be wanted; others that pass it are dropped by the join.
    """
    place = F.pmod(F.xxhash64("row"), F.lit(bits))
    words = members.select(place.alias("at")).groupBy(F.expr("at div 32").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS int))")).alias("mask")
    ).toArrow()
    table = np.zeros(bits // 32 + 1, np.int64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy()
    passes = texts.sparkSession.sparkContext.broadcast(table)

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["at"].to_numpy()
            kept = pa.array(np.flatnonzero(passes.value[at // 32] >> (at % 32) & 1))
            sets = [shingles(text).tobytes() for text in batch["utf8"].take(kept).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"].take(kept), pa.array(sets, pa.binary())], ["row", "shingles"])

    found = texts.select("row", "utf8", place.alias("at")).mapInArrow(tidy(computed), "row bigint, shingles binary")
    return found.join(members, "row").drop("row")


def _labelled(df: DataFrame, id_column: str, text_column: str, leaf: int, block: int, frequent: int, bits: int) -> DataFrame:
    """Per row of ``df``: its number, id, set size, root (null without shingles) and links."""
    texts = small_batches(df).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        utf8(F.col(f"`{text_column}`")).alias("utf8"),
    )
    common = _Listed(texts.select("utf8").mapInArrow(tidy(_holders), "key bigint, held bigint"), leaf, frequent, "frequent")
    nodes = stored(texts.mapInArrow(tidy(_sets(common)), _NODE), "nodes")
    own = nodes.where("keys IS NOT NULL")
    points = stored(own.select("row", "node", "n", "point").dropDuplicates(["node"]), "points")
    prefixes = own.select("node", "n", "keys")
    # Keys of very many sets never meet in one task: they are known to be large before their rows are dealt.
    hot = _Listed(prefixes.mapInArrow(tidy(_prefix_holders), "key bigint, held bigint"), leaf + 1, frequent, "hot")
    schema = "key bigint, node bigint, n int, place int"
    found = stored(bucket_pairs(prefixes.mapInArrow(_prefix_rows(hot, False), schema), leaf), "buckets")
    large = found.where("b IS NULL").select(F.col("large").alias("key"), F.col("a").alias("node"), "n", "place")
    large = large.unionByName(prefixes.mapInArrow(_prefix_rows(hot, True), schema))
    large = stored(large, "large")
    cold = _bounded(found.where("b IS NOT NULL"), points)
    families = _families(large, cold, points, block)
    copies = nodes.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"))
    members = families.withColumnRenamed("root", "group").join(points, "node").join(copies, "node")
    members = stored(with_blocks(members, block), "members")
    verified = _with_sets(texts, members, bits).withColumn("root", F.lit(None).cast("bigint"))
    joined = stored(join_blocks(verified), "joined")
    discard(found, large, points, members, families)
    roots = connected_components(_edges(joined))
    links = joined.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = stored(
        copies.join(links, "node", "left").join(roots, "node", "left").select(
            F.col("node").alias("_node"), F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "per_node",
    )
    return nodes.select("row", "doc_id", "n", "node").join(per_node, F.col("node") == F.col("_node"), "left").select(
        "row", "doc_id", "n", "root", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def similar_groups(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    leaf: int = LEAF,
    block: int = BLOCK,
    frequent: int = FREQUENT,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles``, ``component_id``, ``n_links``."""
    labelled = stored(_labelled(df, id_column, text_column, leaf, block, frequent, bits), "labelled_rows")
    names = labelled.where("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("least"))
    # Rows without shingles have no root and meet no name.
    named = labelled.join(names, F.col("root") == F.col("_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "n_links")


def keep_one_per_group(df: DataFrame) -> DataFrame:
    """The row of each component with the smallest id, of equal or null ids the first, with the columns of ``df``.

    Rows without shingles are linked with nothing and stay. Rows are told apart by their place in ``df``, so
    repeated and null ids keep no copy.
    """
    labelled = _labelled(df.select("doc_id", "text"), "doc_id", "text", LEAF, BLOCK, FREQUENT, FILTER_BITS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    labelled = stored(labelled, "labelled_rows")
    kept = labelled.where("root IS NOT NULL").groupBy("root").agg(first).select(F.col("first.row").alias("_row"))
    dropped = labelled.where("root IS NOT NULL").select(F.col("row").alias("_row")).join(kept, "_row", "left_anti")
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    return rows.join(stored(dropped, "dropped"), "_row", "left_anti").drop("_row")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
