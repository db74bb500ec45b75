"""Global order without a one-task window: exact order statistics and running totals.

``Window.orderBy`` without a partition, or partitioned by a class that holds half of the rows, sorts
everything in one task.  Order statistics narrow brackets by counting, running totals are added up in two levels:
inside pieces of the value range, and over the totals of the pieces.  Both take the same way at every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

# Rows that the last step of a selection orders, and rows that a piece of a running total aims at.
PIECE_ROWS = 2_000_000
_SKETCH_ACCURACY = 10_000
# Finest share of the rows that cuts between pieces are placed by; a larger piece is sorted with spilling.
_CUT_ACCURACY = 1e-4


def group_sizes(df: DataFrame, groups: Sequence[str]) -> dict[tuple, int]:
    """Row count per known group.  Only for grouping columns with few values (classes, bags, feature names)."""
    counted = df.dropna(subset=list(groups)).groupBy(*groups).agg(F.count("*").alias("n"))
    return {tuple(r[g] for g in groups): r["n"] for r in counted.collect()}


Guess = Callable[[int, int], tuple[float, float]]


@dataclass(frozen=True)
class Bracket:
    """Proxy values ``low`` to ``high`` that hold the wanted ranks, with the exact rows below and inside."""

    ranks: tuple[int, ...]
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf

    @property
    def open(self) -> bool:
        return self.low < self.high

    def holds(self) -> bool:
        return self.below < self.ranks[0] and self.ranks[-1] <= self.below + self.inside


def _neighbours(ranks: Sequence[int]) -> list[tuple[int, ...]]:
    """Sorted ranks in runs of consecutive ones, as the two middle ranks of an even count."""
    runs: list[tuple[int, ...]] = []
    for rank in sorted(set(ranks)):
        if runs and rank - runs[-1][-1] == 1:
            runs[-1] += (rank,)
        else:
            runs.append((rank,))
    return runs


def rank_values(
    df: DataFrame,
    groups: Sequence[str],
    series: Mapping[Any, Column],
    ranks: Mapping[tuple[Any, tuple], Sequence[int]],
    sizes: Mapping[tuple[Any, tuple], int],
    proxy: Callable[[Column], Column] | None = None,
    guess: Guess | None = None,
    piece_rows: int = PIECE_ROWS,
) -> dict[tuple[Any, tuple], list[Any]]:
    """Exact values of several series at 1-based ranks within each group, as ``{(series, group): [value, …]}``.

    A series is an expression with one value a row (a column, the hash of a bag); ``sizes`` counts its values per
    group.  ``proxy`` gives a number that never decreases with the value (the value itself by default).  Around the
    wanted ranks a bracket of proxy values is kept.  ``guess(rank, size)`` may propose the first one, quantile
    sketches propose narrower ones while more than ``piece_rows`` values are inside all brackets together.  Each proposal
    is confirmed by conditional counts, so a wrong one is noticed and dropped; sketches and counts of all series
    are one aggregate each over rows that are neither copied nor moved.  Only the values inside the last brackets are
    shuffled, counted per distinct value.  Bounds and counts per rank reach the driver.
    """
    number = {name: i for i, name in enumerate(series)}
    as_number = proxy or (lambda value: value)
    brackets = {}
    for (name, group), wanted in ranks.items():
        size = sizes[name, group]
        for turn, run in enumerate(_neighbours([r for r in wanted if 1 <= r <= size])):
            brackets[(number[name], turn), group] = Bracket(run, size)
    found: dict[tuple, Any] = {}
    if brackets:
        values = df.select(*groups, *[value.alias(f"_v{i}") for i, value in enumerate(series.values())])
        search = _BracketSearch(
            values.select("*", *[as_number(F.col(f"_v{i}")).cast("double").alias(f"_p{i}") for i in range(len(series))]),
            list(groups),
        )
        if guess is not None:
            brackets.update(search.confirmed({
                key: replace(b, low=guess(b.ranks[0], b.inside)[0], high=guess(b.ranks[-1], b.inside)[1])
                for key, b in brackets.items()
            }, brackets))
        while sum(b.inside for b in brackets.values() if b.open) > piece_rows:
            narrowed = search.confirmed(search.sketched({k: b for k, b in brackets.items() if b.open}), brackets)
            if not narrowed:
                break
            brackets.update(narrowed)
        found = search.values(brackets)
    return {
        (name, group): [found.get((number[name], group, rank)) for rank in wanted] for (name, group), wanted in ranks.items()
    }


def order_statistics(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ranks: Mapping[tuple, Sequence[int]],
    sizes: Mapping[tuple, int],
    proxy: Callable[[Column], Column] | None = None,
    guess: Guess | None = None,
    piece_rows: int = PIECE_ROWS,
) -> dict[tuple, list[Any]]:
    """``rank_values`` of a single column, as ``{group: [value, …]}``."""
    found = rank_values(
        df, groups, {value: F.col(value)}, {(value, g): r for g, r in ranks.items()},
        {(value, g): n for g, n in sizes.items()}, proxy, guess, piece_rows,
    )
    return {group: values for (_, group), values in found.items()}


Probe = tuple[int, int]
Brackets = Mapping[tuple[Probe, tuple], Bracket]


class _BracketSearch:
    """Passes over ``(groups, _v0, _p0, _v1, …)`` for brackets by probe, which is ``(series, turn)``, and group."""

    def __init__(self, rows: DataFrame, groups: list[str]) -> None:
        self.rows, self.groups = rows, groups

    def _group(self, row: Row) -> tuple:
        return tuple(row[g] for g in self.groups)

    def _per_group(self, values: Mapping[tuple, float]) -> Column:
        """The value of each row's group; the caller bounds the groups."""
        if not self.groups:
            return F.lit(values[()])
        hits = [
            (reduce(Column.__and__, [F.col(g) == F.lit(v) for g, v in zip(self.groups, group)]), F.lit(value))
            for group, value in values.items()
        ]
        return reduce(lambda chain, hit: chain.when(*hit), hits[1:], F.when(*hits[0]))

    def _probes(self, brackets: Brackets) -> dict[str, tuple[Probe, Column, Column]]:
        """By a short name: the probe, whether the row lies below its bracket, and whether inside."""
        probes = {}
        for i, probe in enumerate(sorted({probe for probe, _ in brackets})):
            own = {group: b for (p, group), b in brackets.items() if p == probe}
            low = self._per_group({g: b.low for g, b in own.items()})
            high = self._per_group({g: b.high for g, b in own.items()})
            at = F.col(f"_p{probe[0]}")
            probes[str(i)] = probe, at < low, (at >= low) & (at <= high)
        return probes

    def sketched(self, brackets: Brackets) -> dict[tuple[Probe, tuple], Bracket]:
        """Tighter brackets from quantile sketches of the rows inside."""
        slack, shares = 2.0 / _SKETCH_ACCURACY, {}
        for key, b in brackets.items():
            first, last = ((rank - b.below) / b.inside for rank in (b.ranks[0], b.ranks[-1]))
            shares[key] = max(0.0, first - slack), min(1.0, last + slack)
        probes = self._probes(brackets)
        grids = {
            name: sorted({s for (p, _), pair in shares.items() if p == probe for s in pair})
            for name, (probe, _, _) in probes.items()
        }
        sketches = self.rows.groupBy(*self.groups).agg(*[
            F.percentile_approx(F.when(inside, F.col(f"_p{probe[0]}")), grids[name], _SKETCH_ACCURACY).alias(f"_q{name}")
            for name, (probe, _, inside) in probes.items()
        ]).collect()
        tighter = {}
        for row in sketches:
            for name, (probe, _, _) in probes.items():
                key = probe, self._group(row)
                if key in brackets and row[f"_q{name}"]:
                    low, high = (row[f"_q{name}"][grids[name].index(s)] for s in shares[key])
                    tighter[key] = replace(brackets[key], low=low, high=high)
        return tighter

    def confirmed(self, proposed: Brackets, current: Brackets) -> dict[tuple[Probe, tuple], Bracket]:
        """Proposed brackets that hold their ranks and fewer rows than now, with their exact counts."""
        if not proposed:
            return {}
        probes = self._probes(proposed)
        counts = self.rows.groupBy(*self.groups).agg(*[
            F.count(F.when(condition, 1)).alias(f"{side}{name}")
            for name, (_, below, inside) in probes.items() for side, condition in (("_b", below), ("_i", inside))
        ]).collect()
        kept = {}
        for row in counts:
            for name, (probe, _, _) in probes.items():
                key = probe, self._group(row)
                if key not in proposed:
                    continue
                counted = replace(proposed[key], below=row[f"_b{name}"], inside=row[f"_i{name}"])
                if counted.holds() and counted.inside < current[key].inside:
                    kept[key] = counted
        return kept

    def values(self, brackets: Brackets) -> dict[tuple[int, tuple, int], Any]:
        """The value at each rank, by (series, group, rank), from the distinct values inside the brackets."""
        probes = self._probes(brackets)
        cells = F.array_compact(F.array(*[
            F.when(inside, F.struct(F.lit(name).alias("_k"), F.col(f"_v{probe[0]}").alias("_v")))
            for name, (probe, _, inside) in probes.items()
        ]))
        by = [*self.groups, "_k"]
        distinct = self.rows.select(*self.groups, F.inline(cells)).groupBy(*by, "_v").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        names = {probe: name for name, (probe, _, _) in probes.items()}
        types = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows.select(*self.groups).schema]
        # As many rows as wanted ranks, which the caller bounds.
        wanted = self.rows.sparkSession.createDataFrame(
            [(*group, names[probe], rank, rank - b.below) for (probe, group), b in brackets.items() for rank in b.ranks],
            ", ".join([*types, "_k string", "_rank bigint", "_place bigint"]),
        )
        hits = distinct.withColumn("_upto", upto).join(F.broadcast(wanted), by).where(
            (F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place"))
        )
        return {(probes[r["_k"]][0][0], self._group(r), r["_rank"]): r["_v"] for r in hits.collect()}


def exact_medians(df: DataFrame, columns: Sequence[str], piece_rows: int = PIECE_ROWS) -> dict[str, float]:
    """Exact median of each column, 0 where a column has no value.  All columns share each pass."""
    medians = dict.fromkeys(columns, 0.0)
    if not medians:
        return medians
    series = {c: F.col(f"`{c}`").cast("double") for c in medians}
    counts = df.agg(*[F.count(v).alias(f"_{i}") for i, v in enumerate(series.values())]).first()
    sizes = {(c, ()): n for c, n in zip(series, counts) if n > 0}
    middle = {key: [(n + 1) // 2, n // 2 + 1] for key, n in sizes.items()}
    filled = {c: v for c, v in series.items() if (c, ()) in sizes}
    found = rank_values(df, [], filled, middle, sizes, piece_rows=piece_rows)
    medians.update({c: sum(v) / 2 for (c, _), v in found.items()})
    return medians


def cut_points(df: DataFrame, order: str, piece_rows: int = PIECE_ROWS, rows: int | None = None) -> list[float]:
    """Values that cut ``df`` along ``order`` into a piece per shuffle partition, or more if these exceed ``piece_rows``.

    They come from a quantile sketch and are fixed numbers in every plan that uses them.
    """
    rows = df.count() if rows is None else rows
    pieces = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / piece_rows))
    shares = [i / pieces for i in range(1, pieces)]
    return sorted(set(df.approxQuantile(order, shares, max(0.5 / pieces, _CUT_ACCURACY))))


def with_piece(df: DataFrame, order: str, cuts: Sequence[float]) -> DataFrame:
    """Add ``_piece``, the number of the piece; it never decreases with ``order``, in Spark's order of null and NaN."""
    # Any inner cut will do where no finite value is to be cut.
    splits = [-math.inf, *([c for c in cuts if math.isfinite(c)] or [0.0]), math.inf]
    splitter = Bucketizer(splits=splits, inputCol="_at", outputCol="_cut", handleInvalid="keep")
    # NaN gets a bucket of its own above the others, null one below them.
    at = F.coalesce(F.col(order).cast("double"), F.lit(-math.inf))
    piece = F.when(F.col(order).isNull(), -1).otherwise(F.col("_cut").cast("int"))
    return splitter.transform(df.withColumn("_at", at)).withColumn("_piece", piece).drop("_at", "_cut")


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, str],
    groups: Sequence[str] = (),
    descending: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Running sums over a total order, ``sums`` mapping a column to the name of its total.

    ``df`` holds one row per (groups, order).  The window runs inside each piece; the totals of the earlier pieces
    are joined by the key that the rows are dealt by already.
    """
    direction = F.desc if descending else F.asc
    cut = with_piece(df, order, cut_points(df, order, piece_rows))
    upto = Window.partitionBy(*groups, "_piece").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({total: F.sum(c).over(upto) for c, total in sums.items()})
    # One row per piece and group.
    earlier = Window.partitionBy(*groups).orderBy(direction("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*groups, "_piece").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
        .select(*groups, "_piece", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    )
    return local.join(offsets, [*groups, "_piece"]).withColumns(
        {total: F.col(total) + F.col(f"_o_{c}") for c, total in sums.items()}
    ).select(*df.columns, *sums.values())


def numbered(df: DataFrame, key: str, rows: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``row_no``, 0-based in the order of a unique numeric key."""
    cut = with_piece(df, key, cut_points(df, key, piece_rows, rows))
    # One row per piece.
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_piece").agg(F.count("*").alias("_c")).select(
        "_piece", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy("_piece").orderBy(key)) - 1
    placed = cut.withColumn("row_no", local).join(offsets, "_piece")
    return placed.withColumn("row_no", F.col("row_no") + F.col("_before")).select(*df.columns, "row_no")
