"""Near-duplicates of embeddings by NN-descent: a graph of neighbour lists, refined by joining neighbours of neighbours.

Equal vectors are one node.  The graph begins with nodes that stand close together in orders by random projections.  In each
round every node brings its neighbours together, forward and backward ones, and pairs that were not yet compared enter each
other's lists if they are nearer than what stands there.  A list that is full of neighbours above the threshold is enlarged,
so no such neighbour is dropped.  An audit compares a sample of vectors with all others; below the wanted recall the graph is
built again with more orders and longer lists.

Angles obey the triangle inequality, so all vectors within half the threshold angle of a leader are linked with each other.
Such groups are bundles: only leaders are in the graph, links inside a bundle are counted and never listed, and two bundles
near each other are compared in blocks.  Bundles pass on their radius, and leaders near enough to have linked members count
as neighbours above the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clinspark.llm.components import connected_components
from clinspark.llm.text import batches
from clinspark.session import stage_table

HALF_ERROR = 0.002  # more than a cosine of vectors in half precision is off; every link is confirmed in double precision
BITS = 63  # projections of one order
BLOCK = 64  # neighbours of one node that are compared together, about
CHUNK = 256  # members of a bundle that are compared together, about
CELLS = 2_000_000  # cosines that a task holds at once


@dataclass(frozen=True)
class NearVectors:
    """Cosine of a link, length of a list, orders that begin the graph and how far they look, audited rows, wanted recall."""

    cosine: float = 0.95
    neighbours: int = 8
    orders: int = 8
    window: int = 3
    audit_rows: int = 2000
    recall: float = 0.97
    seed: int = 0

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)

    @property
    def bundle_angle(self) -> float:
        """Half the angle of a link, less what rounding could add."""
        return self.angle / 2 - 1e-7


# --- vectors -------------------------------------------------------------------------------------


def unit_vector(values: list | None) -> np.ndarray | None:
    """In double precision; None for a vector that is null, empty or zero, or has null or non-finite components."""
    if not values or None in values:
        return None
    v = np.array(values, dtype=np.float64)
    if not np.isfinite(v).all() or not (top := np.abs(v).max()):
        return None
    v = v / top
    return v / math.sqrt(v @ v)


def described(embeddings: DataFrame) -> DataFrame:
    """(vec_id, name, unit): ``name`` is the same for equal vectors; both are null where there is nothing to compare."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            ids = b["vec_id"].to_pylist()
            units = [None if i is None else unit_vector(v) for i, v in zip(ids, b["embedding"].to_pylist())]
            raw = [None if u is None else (u + 0.0).tobytes() for u in units]
            names = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array(names, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "name", "unit"])

    named = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return named.mapInArrow(rows, "vec_id long, name binary, unit binary")


def _matrix(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length."""
    dims = b["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, b.filter(pa.array(dims == dim))


def halved(nodes: DataFrame) -> DataFrame:
    """(node, dim, half): the vectors in half precision, for the graph."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            half = [np.frombuffer(u, np.float64).astype(np.float16).tobytes() for u in b["unit"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], b["dim"], pa.array(half, pa.binary())], ["node", "dim", "half"])

    return nodes.select("node", "dim", "unit").mapInArrow(rows, "node long, dim int, half binary")


# --- the graph -----------------------------------------------------------------------------------

EDGES = "node long, other long, cosine float, near boolean"


@lru_cache(maxsize=4)
def _planes(dim: int, orders: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, orders * BITS), dtype=np.float32)


def _edges(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(cosine.astype(np.float32)), pa.array(near)], ["node", "other", "cosine", "near"])


def first_edges(leaders: DataFrame, options: NearVectors, seed: int) -> DataFrame:
    """Pairs that stand within a window of an order by the signs of random projections; each pair once an order.

    ``leaders`` has (node, dim, half, radius).  The range partitions hold alike many rows however many vectors share
    their signs; what stands in two partitions is not compared, which the later rounds and other orders make up for.
    """
    orders, window, angle = options.orders, options.window, options.angle

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for b in batches(parts):
            for dim, rows in _by_dim(b):
                signs = _matrix(rows["half"], "<f2", dim).astype(np.float32) @ _planes(dim, orders, seed) > 0
                keys = signs.reshape(-1, orders, BITS) @ powers
                for order in range(orders):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.num_rows, order, np.int32)), pa.array(keys[:, order]), *(rows[c] for c in columns)],
                        ["order", "key", *columns])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches(parts):
            both = b if last is None else pa.concat_batches([last, b])
            fresh = 0 if last is None else last.num_rows
            for dim, rows in _by_dim(both.append_column("fresh", pa.array(np.arange(both.num_rows) >= fresh))):
                x = _matrix(rows["half"], "<f2", dim).astype(np.float32)
                node, order, radius, new = (rows[c].to_numpy(zero_copy_only=False) for c in ("node", "order", "radius", "fresh"))
                for back in range(1, min(window, len(node) - 1) + 1):
                    pick = np.flatnonzero(new[back:] & (order[back:] == order[:-back])) + back
                    cosine = np.einsum("ij,ij->i", x[pick], x[pick - back])
                    near = cosine >= np.cos(np.minimum(np.pi, angle + radius[pick] + radius[pick - back])) - HALF_ERROR
                    yield _edges(node[pick], node[pick - back], cosine, near)
            last = both.slice(max(0, both.num_rows - window))

    columns = ("node", "dim", "half", "radius")
    keyed = leaders.select(*columns).mapInArrow(project, "order int, key long, node long, dim int, half binary, radius float")
    # Written, since finding the ranges would project everything a second time.
    keyed = stage_table(keyed, "orders")
    dealt = keyed.repartitionByRange("dim", "order", "key", "node").sortWithinPartitions("dim", "order", "key", "node")
    found = dealt.mapInArrow(compare, EDGES)
    return found.groupBy("node", "other").agg(F.max("cosine").alias("cosine"), F.max("near").alias("near"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"node": F.col("other"), "other": F.col("node")}))


def neighbour_lists(edges: DataFrame, options: NearVectors) -> DataFrame:
    """The nearest neighbours of each node: ``neighbours`` of them, twice the near ones if those fill the list."""
    once = edges.groupBy("node", "other").agg(
        F.max("cosine").alias("cosine"), F.max("near").alias("near"), F.min("fresh").alias("fresh"))
    by_node = Window.partitionBy("node")
    ranked = once.withColumns({
        "rank": F.row_number().over(by_node.orderBy(F.desc("near"), F.desc("cosine"), "other")),
        "nears": F.sum(F.col("near").cast("int")).over(by_node),
    })
    room = F.when(F.col("nears") < options.neighbours, F.lit(options.neighbours)).otherwise(2 * F.col("nears"))
    return ranked.where(F.col("rank") <= room).drop("rank", "nears")


def joined_neighbours(lists: DataFrame, leaders: DataFrame, options: NearVectors, round_: int) -> DataFrame:
    """Pairs of neighbours of one node, forward or backward, of which at least one is new there.

    The neighbours of a node with very many are dealt anew in each round into blocks of about ``BLOCK``.  Of a pair's
    cosines those are returned that are near, or among the best three of a node in its block and nearer than its list.
    """
    angle = options.angle
    members = lists.select(F.col("node").alias("pivot"), F.col("other").alias("member"), "fresh").unionByName(
        lists.select(F.col("other").alias("pivot"), F.col("node").alias("member"), "fresh"))
    members = members.groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))
    sizes = members.groupBy("pivot").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("any AND n > 1")
    sizes = stage_table(sizes.select("pivot", "n"), "pivots")
    block = F.pmod(F.xxhash64("member", F.lit(round_)), F.ceil(F.col("n") / BLOCK).cast("long")).cast("int")
    members = members.join(sizes, "pivot").select("pivot", block.alias("block"), "member", "fresh")
    floors = lists.groupBy("node").agg(
        F.when(F.count("*") >= options.neighbours, F.min("cosine")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
    described_ = leaders.join(floors, "node", "left").select(
        F.col("node").alias("member"), "dim", "radius", "half", F.coalesce("floor", F.lit(-2.0)).cast("float").alias("floor"))
    rows = members.join(stage_table(described_, "described"), "member")

    def groups(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for dim, rows in _by_dim(b):
            pivot, node, block, fresh, radius, floor = (
                rows[c].to_numpy(zero_copy_only=False) for c in ("pivot", "member", "block", "fresh", "radius", "floor"))
            x = _matrix(rows["half"], "<f2", dim).astype(np.float32)
            cut = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (block[1:] != block[:-1])))
            size = np.diff(np.append(cut, len(pivot)))
            width = 2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
            for w in np.unique(width[size > 1]).tolist():
                mine = np.flatnonzero((width == w) & (size > 1))
                step = max(1, CELLS // (w * max(w, dim)))
                for i in range(0, len(mine), step):
                    some = mine[i:i + step]
                    at = cut[some][:, None] + np.arange(w)
                    there = np.arange(w) < size[some][:, None]
                    at = np.where(there, at, 0)
                    yield from compared(x[at], there, node[at], fresh[at], radius[at], floor[at])

    def compared(x, there, node, fresh, radius, floor) -> Iterator[pa.RecordBatch]:
        cosine = x @ x.transpose(0, 2, 1)
        w = x.shape[1]
        asked = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & ~np.eye(w, dtype=bool)
        near = asked & (cosine >= np.cos(np.minimum(np.pi, angle + radius[:, :, None] + radius[:, None, :])) - HALF_ERROR)
        better = np.where(asked & ~near & (cosine > floor[:, :, None]), cosine, -np.inf)
        best = np.argpartition(-better, min(2, w - 1), axis=2)[:, :, :3]
        chosen = near.copy()
        np.put_along_axis(chosen, best, np.take_along_axis(near, best, 2) | (np.take_along_axis(better, best, 2) > -np.inf), 2)
        g, i, j = np.nonzero(chosen)
        if len(g):
            yield _edges(node[g, i], node[g, j], cosine[g, i, j], near[g, i, j])

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches(parts):
            held.append(b)
            size += b.num_rows
            if size < 8192:
                continue
            whole = pa.concat_batches(held)
            # The last group may go on in the next batch.
            pivot, block = whole["pivot"].to_numpy(), whole["block"].to_numpy()
            ends = np.flatnonzero((pivot != pivot[-1]) | (block != block[-1]))
            done = int(ends[-1]) + 1 if len(ends) else 0
            yield from groups(whole.slice(0, done)) if done else ()
            held, size = [whole.slice(done)], whole.num_rows - done
        if size:
            yield from groups(pa.concat_batches(held))

    # The length of the vectors is the same for all neighbours of a node.
    dealt = rows.repartition("pivot", "block").sortWithinPartitions("dim", "pivot", "block")
    return dealt.select("pivot", "block", "member", "fresh", "dim", "radius", "half", "floor").mapInArrow(compare, EDGES)


def near_leaders(leaders: DataFrame, begun: DataFrame, options: NearVectors) -> DataFrame:
    """(node, other), node < other: the leaders that the graph finds near each other.

    Rounds end when one adds less than a thousandth to the near pairs.
    """
    edges = _both_ways(begun).withColumn("fresh", F.lit(True))
    lists = stage_table(neighbour_lists(edges, options), "lists")
    known, round_ = -1, 0
    while True:
        found = lists.where("near").count()
        if round_ > 1 and found - known <= known // 1000:
            break
        known, round_ = found, round_ + 1
        joined = joined_neighbours(lists, leaders, options, round_).withColumn("fresh", F.lit(True))
        lists = stage_table(neighbour_lists(lists.withColumn("fresh", F.lit(False)).unionByName(joined), options), "lists")
    pairs = lists.where("near").select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"))
    return stage_table(pairs.distinct(), "near")


# --- bundles -------------------------------------------------------------------------------------


def _measured(moved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, leader, angle) of (node, leader), in double precision."""
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            cosine = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64))
                      for x, y in zip(b["unit"].to_pylist(), b["led"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b["node"], b["leader"], pa.array(np.arccos(np.clip(cosine, -1.0, 1.0)))], ["node", "leader", "angle"])

    led = nodes.select(F.col("node").alias("leader"), F.col("unit").alias("led"))
    both = moved.join(nodes.select("node", "unit"), "node").join(led, "leader")
    return both.select("node", "leader", "unit", "led").mapInArrow(rows, "node long, leader long, angle double")


def _joining(edges: DataFrame, options: NearVectors, seed: int) -> DataFrame:
    """(node, leader): nodes that join a neighbour within the bundle angle.

    Leaders come first in a random order among all such neighbours of theirs; the others take the first leader they see.
    """
    tight = edges.where(F.col("cosine") >= math.cos(options.bundle_angle) - HALF_ERROR)
    place = lambda c: F.xxhash64(F.col(c), F.lit(seed))
    both = _both_ways(tight.select("node", "other"))
    first = both.groupBy("node").agg(F.min(place("other")).alias("first")).where(place("node") < F.col("first"))
    leaders = stage_table(first.select(F.col("node").alias("other")), "leaders")
    led = both.join(leaders, "other").select("node", place("other").alias("place"), F.col("other").alias("leader"))
    return led.groupBy("node").agg(F.min(F.struct("place", "leader")).alias("led")).select("node", "led.leader")


def bundles(nodes: DataFrame, options: NearVectors) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, leaders, edges): members (node, leader, angle), leaders (node, dim, half, radius), first edges of leaders.

    Rounds repeat while they bundle more than a hundredth of the leaders.  Members of a leader that joins another one
    follow it, or lead themselves where it is too far away.
    """
    half = stage_table(halved(nodes), "half")
    placed = stage_table(nodes.select("node", F.col("node").alias("leader"), F.lit(0.0).alias("angle")), "placed")
    seed = options.seed
    while True:
        radii = placed.groupBy("leader").agg(F.max("angle").cast("float").alias("radius")).withColumnRenamed("leader", "node")
        leaders = stage_table(half.join(radii, "node"), "active")
        edges = stage_table(first_edges(leaders, options, seed), "begun")
        joining = stage_table(_joining(edges, options, seed), "joining")
        moved = joining.count()
        if moved * 100 <= leaders.count():
            return placed, leaders, edges
        seed += 1
        follow = placed.join(joining.select(F.col("node").alias("leader"), F.col("leader").alias("next")), "leader", "left")
        follow = stage_table(follow, "follow")
        measured = _measured(follow.where("next IS NOT NULL").select("node", F.col("next").alias("leader")), nodes)
        fits = F.col("angle") <= options.bundle_angle
        settled = measured.select(
            "node", F.when(fits, F.col("leader")).otherwise(F.col("node")).alias("leader"),
            F.when(fits, F.col("angle")).otherwise(F.lit(0.0)).alias("angle"))
        placed = stage_table(
            follow.where("next IS NULL").select("node", "leader", "angle").unionByName(settled), "placed")


# --- links ---------------------------------------------------------------------------------------


def linked_members(pairs: DataFrame, placed: DataFrame, nodes: DataFrame, options: NearVectors) -> DataFrame:
    """(a, b, node, links) for pairs (node, other) of leaders: how many vectors of the other bundle each member links with.

    Cosines in double precision, for blocks of members against blocks of members; members without links are left out.
    """
    cosine = options.cosine

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            for r in b.to_pylist():
                x, y = (np.frombuffer(b"".join(r[f"{s}_units"]), np.float64).reshape(len(r[f"{s}_units"]), -1) for s in "ab")
                linked = x @ y.T >= cosine
                for own, other, hits in (("a", "b", linked), ("b", "a", linked.T)):
                    links = hits @ np.array(r[f"{other}_weights"], dtype=np.int64)
                    some = np.flatnonzero(links)
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), r["a"])), pa.array(np.full(len(some), r["b"])),
                             pa.array(np.array(r[f"{own}_nodes"], dtype=np.int64)[some]), pa.array(links[some])],
                            ["a", "b", "node", "links"])

    asked = pairs.select(F.explode(F.array("node", "other")).alias("leader")).distinct()
    wanted = placed.join(stage_table(asked, "asked"), "leader", "left_semi").select("node", "leader")
    sizes = stage_table(wanted.groupBy("leader").agg(F.count("*").alias("n")), "sizes")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK).cast("long"))
    chunks = wanted.join(sizes, "leader").withColumn("chunk", salt).join(nodes.select("node", "weight", "unit"), "node")
    chunks = chunks.groupBy("leader", "chunk").agg(F.collect_list(F.struct("node", "weight", "unit")).alias("m"))
    chunks = stage_table(chunks.select(
        "leader", "chunk", F.col("m.node").alias("nodes"), F.col("m.weight").alias("weights"), F.col("m.unit").alias("units")), "chunks")

    def side(name: str) -> DataFrame:
        return chunks.select(F.col("leader").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("nodes", "weights", "units")))

    both = pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(rows, "a long, b long, node long, links long")


def audited_recall(found: DataFrame, nodes: DataFrame, options: NearVectors) -> float:
    """The mean share of links found, over those of ``audit_rows`` nodes that have links; 1 if none of them has any."""
    cosine = options.cosine
    # The driver gets this stated number of vectors.
    sample = nodes.orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(options.audit_rows).select("node", "dim", "unit").collect()
    asked = {dim: ([r["node"] for r in sample if r["dim"] == dim],
                   np.frombuffer(b"".join(r["unit"] for r in sample if r["dim"] == dim), np.float64).reshape(-1, dim))
             for dim in {r["dim"] for r in sample}}
    sent = nodes.sparkSession.sparkContext.broadcast(asked)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches(parts):
            for dim, own in _by_dim(b):
                if dim in sent.value:
                    linked = sent.value[dim][1] @ _matrix(own["unit"], "<f8", dim).T >= cosine
                    total[dim] = total.get(dim, 0) + linked @ own["weight"].to_numpy()
        for dim, links in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.value[dim][0], pa.int64()), pa.array(links.astype(np.int64))], ["node", "links"])

    true = nodes.select("dim", "weight", "unit").mapInArrow(rows, "node long, links long")
    # A vector's cosine with itself counts once, whatever rounding makes of it.
    true = true.groupBy("node").agg((F.sum("links") - 1).alias("links")).where("links > 0")
    share = true.join(found.select("node", F.col("n_links").alias("have")), "node").agg(F.avg(F.col("have") / F.col("links")))
    return 1.0 if (value := share.first()[0]) is None else value


def _linked(nodes: DataFrame, options: NearVectors) -> DataFrame:
    """(node, n_links, led): links of each node's vectors and the smallest id of its component, written."""
    placed, leaders, edges = bundles(nodes, options)
    pairs = near_leaders(leaders, edges, options)
    links = stage_table(linked_members(pairs, placed, nodes, options), "links")
    inside = stage_table(
        placed.join(nodes.select("node", "weight", "lowest"), "node").groupBy("leader")
        .agg(F.sum("weight").alias("inside"), F.min("lowest").alias("lowest")), "inside")
    components = stage_table(connected_components(links.select("a", "b").distinct(), "a", "b"), "components")
    named = inside.join(components.withColumnRenamed("node", "leader"), "leader", "left").withColumn(
        "component", F.coalesce("component", "leader"))
    named = stage_table(named, "named")
    led = stage_table(named.groupBy("component").agg(F.min("lowest").alias("led")), "led")
    named = stage_table(named.join(led, "component").select("leader", "inside", "led"), "named")
    outside = stage_table(links.groupBy("node").agg(F.sum("links").alias("outside")), "outside")
    counted = placed.join(named, "leader").join(outside, "node", "left")
    return stage_table(
        counted.select("node", (F.col("inside") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "led"), "counted")


def near_vectors(embeddings: DataFrame, options: NearVectors = NearVectors()) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other vectors (rows) linked directly, ``component_id`` is the smallest vec_id reachable, the row
    itself included, and ``kept`` marks the row that bears it.  Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different lengths, nor rows without a vec_id, whose
    component is null.  Rows that repeat a vec_id count as vectors of their own.  An empty table gives no rows; further
    columns, whatever their names, are not read.
    """
    base = stage_table(described(embeddings), "vectors")
    # Written before the join on the same column, so that a vector with very many copies can be split there.
    classes = base.where("name IS NOT NULL").groupBy("name").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("weight"))
    classes = stage_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    units = base.where("name IS NOT NULL").join(classes, "name").where(F.col("vec_id") == F.col("lowest"))
    nodes = units.select("node", "lowest", "weight", (F.length("unit") / 8).cast("int").alias("dim"), "unit")
    nodes = stage_table(nodes.dropDuplicates(["node"]), "nodes")
    while True:
        found = _linked(nodes, options)
        if audited_recall(found, nodes, options) >= options.recall:
            break
        options = replace(options, neighbours=2 * options.neighbours, orders=2 * options.orders, seed=options.seed + 1000)
    named = stage_table(classes.join(found, "node").select("name", "n_links", "led"), "found")
    out = base.select("vec_id", "name").join(named, "name", "left")
    component = F.coalesce("led", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
