"""Ensembles of histogram trees: all bags are fitted by one job, and all trees are walked together when rows are scored.

Spark deals each class-balanced draw of rows to a task of its own, which reads the whole draw from shared files a column at a
time; neither the draw nor the number of bags, trees and iterations is bounded.  A fitted ensemble is a table with a row per tree, whose node arrays are laid end to end for
scoring: a batch of rows goes down one tree after the other, or all small trees of a member are looked up together.
"""

from __future__ import annotations

import heapq
import itertools
import os
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinspark.session import stage_files, staged_batches

LEAF = -1
ROWS_AT_ONCE = 65_536  # rows of a draw that are read, binned or counted together
HELD_BYTES = 1 << 25  # bytes of an array of a draw that are held in memory
WALK_ROWS = 4_096  # rows that go down a tree together
LOOKUP_CELLS = 50_000  # row and tree pairs that are looked up together
KEPT_TABLES = 256_000_000  # bytes of look-up tables that a task keeps, at most
Use = tuple[int | None, int | None]  # levels walked and trees of a member used, all if None
TREES = (
    "candidate int, member int, tree int, feature array<int>, threshold array<double>, left array<int>, "
    "value array<double>, gain array<double>"
)


@dataclass(frozen=True)
class Growth:
    """How trees grow.

    ``rounds`` of boosting with ``rate``, or as many independent trees if ``rate`` is None.  ``leaves`` bounds a tree that
    grows its best leaf first; ``tried`` is the number of features looked at for a split, more only if none of them splits.
    """

    rounds: int
    rate: float | None = None
    depth: int = 30
    leaves: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    tried: int | None = None
    l2: float = 0.0
    bins: int = 255


def room(shape: int | tuple[int, ...], kind: type) -> np.ndarray:
    """An array of a task: in memory, or in a scratch file without a name if it is large."""
    if np.prod(shape) * np.dtype(kind).itemsize <= HELD_BYTES:
        return np.empty(shape, kind)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder or None) as file:
        return np.asarray(np.memmap(file, kind, "w+", shape=shape))


def pieces(begin: int, end: int) -> Iterator[slice]:
    return (slice(i, min(i + ROWS_AT_ONCE, end)) for i in range(begin, end, ROWS_AT_ONCE))


class Rows:
    """Rows of one draw in memory, read a column at a time in pieces."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.n, self.width = x, y, len(y), x.shape[1]

    def column(self, j: int) -> Iterator[np.ndarray]:
        return (self.x[p, j] for p in pieces(0, self.n))

    def labels(self) -> Iterator[np.ndarray]:
        return (self.y[p] for p in pieces(0, self.n))


class StagedRows:
    """Rows of one draw in files of ``stage_draws``: those for which the column ``mark`` is true."""

    def __init__(self, files: Sequence[str], mark: str, width: int):
        self.files, self.mark, self.width = files, mark, width
        self.n = sum(len(part) for part in self.labels())

    def column(self, j: int) -> Iterator[np.ndarray]:
        return self._read(f"f{j}")

    def labels(self) -> Iterator[np.ndarray]:
        return self._read("label")

    def _read(self, name: str) -> Iterator[np.ndarray]:
        for uri in self.files:
            for b in staged_batches(uri, ROWS_AT_ONCE, [self.mark, name]):
                yield b[name].filter(b[self.mark]).to_numpy(zero_copy_only=False)


class Binned:
    """Columns as small numbers: values of a bin share it, and a split lies between two bins."""

    def __init__(self, rows: Rows | StagedRows, bins: int):
        self.cuts, self.codes = [], room((rows.width, rows.n), np.min_scalar_type(bins))
        for j, codes in enumerate(self.codes):
            self.cuts.append(cuts := self._cuts(rows, j, bins))
            at = 0
            for part in rows.column(j):
                codes[at:at + len(part)] = np.searchsorted(cuts, part, side="left")
                at += len(part)
        self.width = max([len(c) + 1 for c in self.cuts], default=1)

    @staticmethod
    def _cuts(rows: Rows | StagedRows, j: int, bins: int) -> np.ndarray:
        """Middles between neighbouring distinct values, or between those at quantiles if there are too many."""
        values = np.zeros(0)
        for part in rows.column(j):
            values = np.unique(np.append(values, part))
            if len(values) > bins:
                values = Binned._quantiles(rows, j, bins)
                break
        return (values[1:] + values[:-1]) / 2

    @staticmethod
    def _quantiles(rows: Rows | StagedRows, j: int, bins: int) -> np.ndarray:
        held, at = room(rows.n, np.float64), 0
        for part in rows.column(j):
            held[at:at + len(part)] = part
            at += len(part)
        held.sort()
        if np.isnan(held[-1]):  # no order among the values
            return held[:0].copy()
        return np.unique(held[np.floor((rows.n - 1) * np.linspace(0, 1, bins)).astype(np.intp)])


class _Tree:
    """One growing tree over the rows of ``target``, whose numbers ``order`` holds with those of a node side by side."""

    def __init__(self, data: Binned, target: _Target, growth: Growth, seed: tuple[int, ...], order: np.ndarray, spare: np.ndarray):
        self.data, self.target, self.growth, self.seed, self.order, self.spare = data, target, growth, seed, order, spare
        self.nodes: list[list] = []  # feature, threshold, left child (the right one stands behind it), value, gain
        self.span_of: dict[int, tuple[int, int]] = {}  # where the rows of a leaf lie in ``order``
        number = itertools.count()
        queue: list[tuple] = []
        for p in pieces(0, len(order)):
            order[p] = np.arange(p.start, p.stop)

        def opened(begin: int, end: int, depth: int, path: int) -> int:
            total, weight = self.sums(begin, end)
            node = len(self.nodes)
            self.nodes.append([LEAF, 0.0, node, total / (weight + growth.l2) if weight + growth.l2 > 0 else 0.0, 0.0])
            self.span_of[node] = begin, end
            if depth < growth.depth and end - begin >= max(growth.min_split, 2 * growth.min_leaf):
                found = self.best_split(begin, end, total, weight, path)
                if found is not None:
                    # Best first only matters where leaves are bounded.
                    first = -found[0] if growth.leaves else 0.0
                    heapq.heappush(queue, (first, next(number), node, depth, path, found))
            return node

        opened(0, len(order), 0, 1)
        leaves = 1
        while queue and (growth.leaves is None or leaves < growth.leaves):
            _, _, node, depth, path, (gain, feature, code) = heapq.heappop(queue)
            begin, end = self.span_of.pop(node)
            middle = self.parted(begin, end, feature, code)
            left = opened(begin, middle, depth + 1, 2 * path)
            opened(middle, end, depth + 1, 2 * path + 1)
            self.nodes[node] = [feature, float(data.cuts[feature][code]), left, self.nodes[node][3], gain]
            leaves += 1

    def sums(self, begin: int, end: int) -> tuple[float, float]:
        total, weight = 0.0, 0.0
        for p in pieces(begin, end):
            g, h = self.target.of(self.order[p])
            total += g.sum()
            weight += len(g) if h is None else h.sum()
        return total, weight

    def parted(self, begin: int, end: int, feature: int, code: int) -> int:
        """Where the right rows of a node begin, once those of its left child are put before them; both keep their order."""
        codes, at, others = self.data.codes[feature], begin, 0
        for p in pieces(begin, end):
            rows = self.order[p]
            under = codes[rows] <= code
            left, right = rows[under], rows[~under]
            self.order[at:at + len(left)] = left
            self.spare[others:others + len(right)] = right
            at, others = at + len(left), others + len(right)
        for p in pieces(0, others):
            self.order[at + p.start:at + p.stop] = self.spare[p]
        return at

    def best_split(self, begin: int, end: int, total: float, weight: float, path: int) -> tuple[float, int, int] | None:
        """(gain, feature, last bin on the left) of the best split.

        The features tried depend on the place in the tree alone, so a tree of less depth is the top of a deeper one.
        """
        n = len(self.data.codes)
        tried = self.growth.tried
        if tried is None or tried >= n:
            return self._best_of(np.arange(n), begin, end, total, weight)
        features = np.random.default_rng((*self.seed, path)).permutation(n)
        for some in [features[:tried], *([f] for f in features[tried:])]:
            if (found := self._best_of(np.sort(some), begin, end, total, weight)) is not None:
                return found
        return None

    def _best_of(self, features: np.ndarray, begin: int, end: int, total: float, weight: float) -> tuple[float, int, int] | None:
        width, k, growth = self.data.width, len(features), self.growth
        if width < 2:
            return None
        count, g, h = np.zeros((k, width), np.int64), np.zeros((k, width)), np.zeros((k, width))
        for p in pieces(begin, end):
            rows = self.order[p].astype(np.intp)
            gradient, curve = self.target.of(rows)
            for i, feature in enumerate(features):
                codes = self.data.codes[feature].take(rows).astype(np.intp)
                count[i] += np.bincount(codes, None, width)
                g[i] += np.bincount(codes, gradient, width)
                if curve is not None:
                    h[i] += np.bincount(codes, curve, width)
        if curve is None:
            h = count.astype(np.float64)
        count, g, h = (v.cumsum(axis=1)[:, :-1] for v in (count, g, h))
        allowed = (count >= growth.min_leaf) & (end - begin - count >= growth.min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g**2 / (h + growth.l2) + (total - g) ** 2 / (weight - h + growth.l2) - total**2 / (weight + growth.l2)
        gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
        best = int(gain.argmax())
        value = float(gain.ravel()[best])
        # A gain within rounding of nothing is none.
        if not value > 1e-10 * max(1.0, abs(total)):
            return None
        return value, int(features[best // (width - 1)]), best % (width - 1)


class _Target:
    """What the trees of a draw are fitted to: the labels, or the log loss that boosting has left."""

    def __init__(self, rows: Rows | StagedRows, boosted: bool):
        self.y, at = room(rows.n, np.float32), 0
        for part in rows.labels():
            self.y[at:at + len(part)] = part
            at += len(part)
        self.score = self.p = None
        if boosted:
            self.score, self.p = room(rows.n, np.float64), room(rows.n, np.float64)
            self.score[:] = 0.0

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Gradients and weights of some rows; all weights are 1 if there are none."""
        y = self.y.take(rows).astype(np.float64)
        if self.p is None:
            return y, None
        p = self.p.take(rows)
        return y - p, p * (1 - p)

    def renewed(self) -> None:
        for s in pieces(0, len(self.p)):
            self.p[s] = 1 / (1 + np.exp(-self.score[s]))

    def add(self, rows: np.ndarray, value: float) -> None:
        self.score[rows] += value


def grown(x: np.ndarray, y: np.ndarray, growth: Growth, seed: tuple[int, ...]) -> Iterator[tuple[int, list[list]]]:
    """(number, nodes) of the trees fitted to one draw of rows: boosted on the log loss, or each on the label itself."""
    return grown_on(Rows(x, y), growth, seed)


def grown_on(rows: Rows | StagedRows, growth: Growth, seed: tuple[int, ...]) -> Iterator[tuple[int, list[list]]]:
    """``grown`` for rows that need not fit in memory.

    Per row a byte a feature, its label, its place and, in boosting, its score are held, in scratch files if they are large.
    """
    data, target = Binned(rows, growth.bins), _Target(rows, growth.rate is not None)
    order, spare = (room(rows.n, np.int32 if rows.n < 2**31 else np.int64) for _ in range(2))
    nodes = None
    for t in range(growth.rounds):
        if growth.rate is None:
            # Independent trees that try all features of the same rows are equal.
            if nodes is None or growth.tried is not None and growth.tried < rows.width:
                nodes = _Tree(data, target, growth, (*seed, t), order, spare).nodes
            yield t, nodes
            continue
        target.renewed()
        tree = _Tree(data, target, growth, (*seed, t), order, spare)
        for node in tree.nodes:
            node[3] *= growth.rate
        for node, span in tree.span_of.items():
            for p in pieces(*span):
                target.add(order[p], tree.nodes[node][3])
        yield t, tree.nodes


def matrix(features: pa.Array, width: int) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def stage_draws(rows: DataFrame, label: str, key: str, marks: Sequence[Column], width: int) -> list[str]:
    """Files of ``(key, label, features)``: a column per feature, and a true or false ``m0``, ``m1``, … for each of ``marks``,
    the filters of the draws.  A row is written once however many draws it is in.

    Rows are put in the order of the key, so that a fit repeats.
    """
    ordered = rows.orderBy(F.asc_nulls_last(key), label, "features")
    features = [F.get("features", F.lit(j)).cast("double").alias(f"f{j}") for j in range(width)]
    marked = [mark.alias(f"m{i}") for i, mark in enumerate(marks)]
    return stage_files(ordered.select(F.col(label).cast("double").alias("label"), *features, *marked), "draws")


def fit_draws(
    spark: SparkSession, draws: Mapping[tuple, tuple[Sequence[str], int]], growths: Sequence[Growth], width: int, seed: int,
    by: Mapping[str, str],
) -> DataFrame:
    """The trees of all draws, as a table with a row per tree: ``by``, and the columns of ``TREES``.

    ``draws`` has the files of ``stage_draws`` and the number of the mark for each draw, named by the values of ``by`` (column
    and type), one of which is the member.  Each draw is one task's work for every one of ``growths``, numbered as candidates;
    the task reads the whole draw from the files.
    """
    schema = TREES + "".join(f", {c} {kind}" for c, kind in by.items() if c != "member")
    shape = _arrow_schema(spark, schema)
    named = list(draws.items())

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in itertools.chain.from_iterable(part["id"].to_pylist() for part in parts):
            names, (files, mark) = named[number]
            given = dict(zip(by, names))
            rows = StagedRows(files, f"m{mark}", width)
            if not rows.n:
                continue
            for candidate, growth in enumerate(growths):
                for tree, nodes in grown_on(rows, growth, (seed, given["member"])):
                    feature, threshold, left, value, gain = (list(c) for c in zip(*nodes))
                    yield pa.RecordBatch.from_pylist([{
                        "candidate": candidate, "tree": tree, "feature": feature, "threshold": threshold, "left": left,
                        "value": value, "gain": gain, **given}], schema=shape)

    # As many partitions as draws: each is a row that holds much work.
    return spark.range(0, len(named), 1, max(1, len(named))).mapInArrow(fit, schema)


def fit_trees(
    rows: DataFrame, growths: Sequence[Growth], width: int, seed: int, key: str, groups: int, by: Sequence[str] = ("member",)
) -> DataFrame:
    """``fit_draws`` for ``rows`` of (member, …, key, label, features) with a row per draw it is in, ``groups`` draws in all."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [tuple(r) for r in rows.select(*by).distinct().orderBy(*by).collect()]
    if len(names) > groups:
        raise ValueError(f"{len(names)} draws instead of {groups}")
    marks = [reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in zip(by, name)]) for name in names]
    files = stage_draws(rows, "label", key, marks, width)
    draws = {name: (files, i) for i, name in enumerate(names)}
    return fit_draws(rows.sparkSession, draws, growths, width, seed, {c: kinds[c] for c in by})


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


@dataclass(frozen=True)
class Ensemble:
    """The trees of one model: ``table`` as ``fit_trees`` gives it, ``boosted`` if a member's trees are summed.

    The nodes reach the driver and every scoring task: there are members x trees x nodes of a tree of them, and a tree has
    at most twice as many as the leaves, depth or rows of a draw allow.
    """

    table: DataFrame
    boosted: bool

    @cached_property
    def flat(self) -> Flat:
        columns = ("member", "tree", "feature", "threshold", "left", "value")
        return Flat.of(self.table.select(*columns).orderBy("member", "tree").toArrow(), self.boosted)

    def probability(self, features: Column) -> Column:
        sent = self.table.sparkSession.sparkContext.broadcast(self.flat)

        @F.arrow_udf("double")
        def scored(x: pa.Array) -> pa.Array:
            return pa.array(sent.value.probability(x))

        return scored(features)

    def importances(self, names: Sequence[str]) -> DataFrame:
        """(member, tree, feature, importance): the share of each feature in the gains of a tree; 0 for a tree without splits."""
        split = self.table.select("member", "tree", F.inline(F.arrays_zip(F.col("feature").alias("j"), F.col("gain").alias("gain"))))
        split = split.where(F.col("j") != LEAF).groupBy("member", "tree", "j").agg(F.sum("gain").alias("gain"))
        whole = split.groupBy("member", "tree").agg(F.sum("gain").alias("whole"))
        # One row per feature of the model.
        every = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(c).alias("name")) for j, c in enumerate(names)]))
        cells = self.table.select("member", "tree", every.alias("f")).select("member", "tree", "f.*")
        found = cells.join(split, ["member", "tree", "j"], "left").join(whole, ["member", "tree"], "left")
        return found.select("member", "tree", F.col("name").alias("feature"),
                            F.coalesce(F.col("gain") / F.col("whole"), F.lit(0.0)).alias("importance"))


@dataclass(frozen=True)
class Flat:
    """Node arrays of all trees end to end; ``left`` is the place of the left child."""

    inner: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    member_at: np.ndarray
    boosted: bool

    @classmethod
    def of(cls, trees: pa.Table, boosted: bool) -> Flat:
        lists = {c: trees[c].combine_chunks() for c in ("feature", "threshold", "left", "value")}
        sizes = np.diff(lists["feature"].offsets.to_numpy()) if trees.num_rows else np.zeros(0, np.int64)
        roots = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items()}
        shift = np.repeat(roots, sizes)
        members = trees["member"].to_numpy()
        at = np.flatnonzero(np.append(True, members[1:] != members[:-1])) if len(members) else np.zeros(0, np.int64)
        return cls(
            flat["feature"] != LEAF, flat["feature"].astype(np.int32), flat["threshold"], (flat["left"] + shift).astype(np.int32),
            flat["value"], roots, at, boosted)

    @cached_property
    def ends(self) -> np.ndarray:
        """Where each tree ends."""
        return np.append(self.roots[1:], len(self.value))

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """The nodes of all trees by level."""
        levels, at = [], self.roots
        while len(at):
            levels.append(at)
            at = self.left[at[self.inner[at]]]
            at = np.concatenate((at, at + 1)).astype(np.int64)
        return levels

    @cached_property
    def heights(self) -> np.ndarray:
        """Levels below the root of each tree."""
        height = np.zeros(len(self.value), np.int64)
        for at in reversed(self.levels):
            at = at[self.inner[at]]
            height[at] = 1 + np.maximum(height[self.left[at]], height[self.left[at] + 1])
        return height[self.roots]

    @cached_property
    def leaf_ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """(first leaf, leaves) under each node, leaves numbered from the left in each tree."""
        leaves, first = np.ones(len(self.value), np.int64), np.zeros(len(self.value), np.int64)
        for at in reversed(self.levels):
            at = at[self.inner[at]]
            leaves[at] = leaves[self.left[at]] + leaves[self.left[at] + 1]
        for at in self.levels:
            at = at[self.inner[at]]
            first[self.left[at]] = first[at]
            first[self.left[at] + 1] = first[at] + leaves[self.left[at]]
        return first, leaves

    def spans(self, until: int | None = None) -> list[tuple[int, int]]:
        """First tree and end of each member, at most ``until`` trees of it."""
        ends = np.append(self.member_at[1:], len(self.roots)).tolist()
        return [(a, b if until is None else min(b, a + until)) for a, b in zip(self.member_at.tolist(), ends)]

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and left child in its tree of each node; a leaf leads to itself whatever the row."""
        own = np.repeat(self.roots, self.ends - self.roots)
        return (np.where(self.inner, self.feature, 0).astype(np.int64), np.where(self.inner, self.threshold, np.inf),
                self.left.astype(np.int64) - own)

    def reached(self, cells: np.ndarray, first: np.ndarray, t: int, depths: Sequence[int | None]) -> list[np.ndarray]:
        """The value of the node of tree ``t`` that each row is in at each of ``depths``; None is the leaf.

        All rows go down a level at a time; the nodes of one tree stay in the cache.  ``first`` is the place in ``cells``
        of the first feature of each row.
        """
        a, b, height = int(self.roots[t]), int(self.ends[t]), int(self.heights[t])
        features, cuts, left, values = *(v[a:b] for v in self.steps), self.value[a:b]
        wanted = [height if d is None else min(d, height) for d in depths]
        found, at = {0: values.take(np.zeros(len(first), np.int64))}, np.zeros(len(first), np.int64)
        cell, cut, own = np.empty(len(first), np.int64), np.empty(len(first)), np.empty(len(first))
        for level in range(1, max(wanted) + 1):
            np.take(features, at, out=cell, mode="clip")
            np.add(cell, first, out=cell)
            np.take(cells, cell, out=own, mode="clip")
            np.take(cuts, at, out=cut, mode="clip")
            at = left.take(at, mode="clip")
            # The right child stands behind the left one.
            at += own > cut
            if level in wanted:
                found[level] = values.take(at, mode="clip")
        return [found[level] for level in wanted]

    def values(self, x: np.ndarray, depth: int | None = None, until: int | None = None) -> np.ndarray:
        """Of each row and tree: the value of the node it ends in, at most ``depth`` levels down; the first ``until`` trees
        of each member if that is given."""
        cells, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        trees = [t for a, b in self.spans(until) for t in range(a, b)]
        return np.stack([self.reached(cells, first, t, [depth])[0] for t in trees], axis=1)

    def walked(self, x: np.ndarray, uses: Sequence[Use]) -> np.ndarray:
        """Of each use and row, the mean over the members.  A tree is walked once for all uses."""
        cells, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        depths = list(dict.fromkeys(d for d, _ in uses))
        out = np.zeros((len(uses), len(x)))
        for start, end in self.spans():
            sums = np.zeros_like(out)
            for t in range(start, end):
                asked = [i for i, (_, until) in enumerate(uses) if until is None or t - start < until]
                if asked:
                    found = dict(zip(depths, self.reached(cells, first, t, depths)))
                    for i in asked:
                        sums[i] += found[uses[i][0]]
            trees = np.array([[end - start if until is None else min(until, end - start)] for _, until in uses])
            out += self._of_member(sums, trees)
        return out / len(self.member_at)

    def _of_member(self, sums: np.ndarray, trees: np.ndarray | int) -> np.ndarray:
        return 1 / (1 + np.exp(-sums)) if self.boosted else sums / trees

    def tables(self, start: int, end: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
        """Of trees ``start`` to ``end``: per feature its thresholds, and for each interval between them the leaves that
        every tree can still end in, as bits; then the values of the leaves, a row per tree."""
        a, b = int(self.roots[start]), int(self.ends[end - 1])
        tree = np.repeat(np.arange(end - start), self.ends[start:end] - self.roots[start:end])
        first, leaves = (v[a:b] for v in self.leaf_ranges)
        inner, kind = self.inner[a:b], self.bits
        values = np.zeros((end - start, int(leaves.max())))
        values[tree[~inner], first[~inner]] = self.value[a:b][~inner]
        at = np.flatnonzero(inner)
        gone = leaves[self.left[a:b][at] - a].astype(np.uint64)
        one = np.uint64(1)
        kept = (~(((one << gone) - one) << first[at].astype(np.uint64))).astype(kind)
        found = []
        for j in np.unique(self.feature[a:b][at]).tolist():
            own = self.feature[a:b][at] == j
            cuts, place = np.unique(self.threshold[a:b][at][own], return_inverse=True)
            masks = np.full((len(cuts) + 1, end - start), np.iinfo(kind).max, kind)
            np.bitwise_and.at(masks, (place + 1, tree[at][own]), kept[own])
            found.append((j, cuts, np.bitwise_and.accumulate(masks, axis=0)))
        return found, values

    @cached_property
    def bits(self) -> type | None:
        """The number type with a bit for each leaf of a tree, if there is one."""
        most = int(self.leaf_ranges[1].max(initial=1))
        return next((kind for kind in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= 8 * kind().itemsize), None)

    @cached_property
    def kept_tables(self) -> list | None:
        """The tables of all members, unless they take much memory."""
        splits = int(self.inner.sum())
        most = max((b - a for a, b in self.spans()), default=0)
        if splits * most * self.bits().itemsize > KEPT_TABLES:
            return None
        return [self.tables(a, b) for a, b in self.spans()]

    def looked_up(self, x: np.ndarray, until: int | None = None) -> np.ndarray:
        """The mean over the members by look-ups: the leaf a row ends in is the first one that no split rules out.

        The trees of a member are looked at together, a step per feature instead of one per level.
        """
        out = np.zeros(len(x))
        for number, (start, end) in enumerate(self.spans()):
            found, values = self.kept_tables[number] if self.kept_tables is not None else self.tables(start, end)
            trees = end - start if until is None else min(until, end - start)
            codes = []
            for j, cuts, masks in found:
                code = np.searchsorted(cuts, x[:, j], side="left")
                code[np.isnan(x[:, j])] = 0
                codes.append((code, masks if trees == end - start else np.ascontiguousarray(masks[:, :trees])))
            offsets, flat = np.arange(trees) * values.shape[1], values.ravel()
            step = max(1, LOOKUP_CELLS // trees)
            for i in range(0, len(x), step):
                rows = min(step, len(x) - i)
                open_ = np.full((rows, trees), np.iinfo(self.bits).max, self.bits)
                one = np.empty((rows, trees), self.bits)
                for code, masks in codes:
                    np.take(masks, code[i:i + rows], axis=0, out=one, mode="clip")
                    np.bitwise_and(open_, one, out=open_)
                # Zeros below the first bit that is set.
                np.subtract(open_, self.bits(1), out=one)
                np.bitwise_and(one, np.invert(open_, out=open_), out=one)
                leaf = np.bitwise_count(one) + offsets
                out[i:i + rows] += self._of_member(flat.take(leaf, mode="clip").sum(axis=1), trees)
        return out / max(1, len(self.member_at))

    def of_uses(self, x: np.ndarray, uses: Sequence[Use]) -> np.ndarray:
        """Of each use and row, the mean over the members: of the probability of a boosted sum, or of the mean of
        independent trees."""
        if not len(self.roots):
            return np.full((len(uses), len(x)), np.nan)
        if self.bits is not None and all(depth is None for depth, _ in uses):
            return np.array([self.looked_up(x, until) for _, until in uses])
        out = np.empty((len(uses), len(x)))
        for i in range(0, len(x), WALK_ROWS):
            out[:, i:i + WALK_ROWS] = self.walked(x[i:i + WALK_ROWS], uses)
        return out

    def of_rows(self, x: np.ndarray, depth: int | None = None, until: int | None = None) -> np.ndarray:
        return self.of_uses(x, [(depth, until)])[0]

    def probabilities(self, features: pa.Array, uses: Sequence[Use]) -> np.ndarray:
        """Scores of a batch of feature lists, a row for each use; lists that are equal, like repeated probes, are scored
        once."""
        n = len(features)
        if not n:
            return np.zeros((len(uses), 0))
        x = matrix(features, len(features.flatten()) // n)
        first, where = distinct_places(x)
        return self.of_uses(x[first], uses)[:, where]

    def probability(self, features: pa.Array, depth: int | None = None, until: int | None = None) -> np.ndarray:
        return self.probabilities(features, [(depth, until)])[0]


def distinct_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows of ``x``, and for each row the number of its place."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    factors = np.random.default_rng(1).integers(1, 2**63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashes = ((bits ^ (bits >> np.uint64(32))) * factors).sum(axis=1, dtype=np.uint64)
    _, first, where = np.unique(hashes, return_index=True, return_inverse=True)
    if not (bits[first][where] == bits).all():  # different rows with one hash
        return np.arange(len(x)), np.arange(len(x))
    return first, where
