"""Repeatable stratified splits, folds and class-balanced draws.

Rows are ordered by a hash of seed and key.  Membership is decided by comparing each row's hash with a
threshold found per class, so the rows themselves are never shuffled or ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.operators.ordering import PIECE_ROWS, group_sizes, order_statistics, rank_values
from clinspark.session import stage_table

HASH_RANGE = float(16**15)


def hash_order(key: str, *prefix: object) -> Column:
    """``md5("seed:…:key")`` as text; unique keys give a repeatable random order."""
    parts = [F.lit(f"{p}:") if not isinstance(p, Column) else F.concat(p.cast("string"), F.lit(":")) for p in prefix]
    return F.md5(F.concat(*parts, F.col(key).cast("string")))


def hash_number(digest: Column) -> Column:
    """The first 15 hex digits as a number, in the same order as the text."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def expected_bracket(rank: int, size: int) -> tuple[float, float]:
    """Where the ``rank``-th of ``size`` evenly spread hash numbers lies, with eight deviations of room."""
    share = rank / size
    room = 8 * math.sqrt(share * (1 - share) / size) + 8 / size
    return (share - room) * HASH_RANGE, (share + room) * HASH_RANGE


def _by_class(label: str, values: dict[tuple, object]) -> Column:
    chain = None
    for (cls,), value in values.items():
        if value is None:
            continue
        hit = F.col(label) == F.lit(cls)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return F.lit(None) if chain is None else chain


def _quota_filter(
    df: DataFrame, label: str, digest: Column, sizes: dict[tuple, int], quota: dict[tuple, int], piece_rows: int
) -> Column:
    """True for the ``quota`` rows of each class that come first in hash order."""
    hashed = df.select(label, digest.alias("_h"))
    limits = order_statistics(
        hashed, [label], "_h", {c: [q] for c, q in quota.items() if q > 0}, sizes,
        proxy=hash_number, guess=expected_bracket, piece_rows=piece_rows,
    )
    return F.coalesce(digest <= _by_class(label, {c: v[0] for c, v in limits.items()}), F.lit(False))


def stratified_split(
    df: DataFrame, label: str, key: str, seed: int = 0, share: float = 0.2, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Add ``is_holdout``: 1 for ``round(share * n)`` rows of each class."""
    sizes = group_sizes(df, [label])
    quota = {c: int(share * n + 0.5) for c, n in sizes.items()}
    held = _quota_filter(df, label, hash_order(key, seed), sizes, quota, piece_rows)
    return df.withColumn("is_holdout", held.cast("int"))


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int = 5, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Add ``fold`` 1..k: contiguous blocks of each class in key order, the first ones larger by one row."""
    sizes = group_sizes(df, [label])

    def last_ranks(n: int) -> Sequence[int]:
        base, extra = divmod(n, folds)
        return [base * i + min(i, extra) for i in range(1, folds)]

    ranks = {c: sorted({r for r in last_ranks(n) if r > 0}) for c, n in sizes.items()}
    found = order_statistics(df, [label], key, ranks, sizes, piece_rows=piece_rows)
    fold = F.lit(1)
    for i in range(folds - 1):
        ends = {}
        for c, n in sizes.items():
            rank = last_ranks(n)[i]
            ends[c] = found[c][ranks[c].index(rank)] if rank > 0 else None
        # An empty block ends before the first key.
        empty = _by_class(label, {c: True for c, v in ends.items() if v is None})
        after = F.col(key) > _by_class(label, ends) if any(v is not None for v in ends.values()) else F.lit(None)
        fold = fold + F.coalesce(after, empty, F.lit(False)).cast("int")
    return df.withColumn("fold", fold.cast("int"))


def _balanced_quota(sizes: dict[tuple, int], most: int | None) -> int:
    """Rows of each class in a bag."""
    quota = min(sizes.values(), default=0)
    return quota if most is None or not sizes else min(quota, max(1, most // len(sizes)))


def balanced_limits(
    df: DataFrame, label: str, key: str, seed: int = 0, bags: Sequence[int] = (0,), piece_rows: int = PIECE_ROWS,
    most: int | None = None,
) -> dict[tuple, str]:
    """The largest hash admitted per (bag, class): every class keeps as many rows as the smallest one has.

    ``most`` bounds the rows of a bag.  All bags are served by the same passes: a row holds its hash for each bag side by
    side, is never copied by bag, and nothing but thresholds comes back.
    """
    sizes = group_sizes(df, [label])
    quota = _balanced_quota(sizes, most)
    wanted = {(b, c): [quota] for b in bags for c in sizes}
    limits = rank_values(
        df, [label], {b: hash_order(key, seed, b) for b in bags}, wanted, {(b, c): sizes[c] for b, c in wanted},
        proxy=hash_number, guess=expected_bracket, piece_rows=piece_rows,
    )
    return {(b, *c): v[0] for (b, c), v in limits.items()}


def in_draw(label: str, key: str, seed: int, bag: int, limits: dict[tuple, str]) -> Column:
    """Filter for one bag, given the thresholds of ``balanced_limits``."""
    own = {cls: limit for (b, *cls), limit in limits.items() if b == bag for cls in [tuple(cls)]}
    return F.coalesce(hash_order(key, seed, bag) <= _by_class(label, own), F.lit(False))


def bags_of_row(label: str, key: str, seed: int, bags: int, limits: dict[tuple, str]) -> Column:
    """The numbers of the bags that a row is in."""
    return F.array_compact(F.array(*[F.when(in_draw(label, key, seed, b, limits), F.lit(b)) for b in range(bags)]))


def balanced_draw(
    df: DataFrame, label: str, key: str, seed: int = 0, bag: int = 0, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """One class-balanced draw; each ``bag`` number gives another one."""
    limits = balanced_limits(df, label, key, seed, [bag], piece_rows)
    return df.where(in_draw(label, key, seed, bag, limits))


def balanced_draws(
    df: DataFrame, label: str, key: str, seed: int = 0, bags: int = 1, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Several draws side by side, told apart by ``bag``: one filter per bag over a single scan."""
    limits = balanced_limits(df, label, key, seed, range(bags), piece_rows)
    return df.withColumn("bag", F.explode(bags_of_row(label, key, seed, bags, limits)))


def draw_limits(
    df: DataFrame, label: str, key: str, seed: int, bags: int, most: int | None = None
) -> dict[tuple, str]:
    """Thresholds as of ``balanced_limits`` for all bags, from passes that hash each row once per bag.

    Rows near the expected threshold of their class, with room on both sides, are written; those before them are counted.
    The exact thresholds come from the few that were written.  Where they don't hold one, all rows are searched.
    """
    sizes = group_sizes(df, [label])
    quota = _balanced_quota(sizes, most)
    if not quota:
        return {}
    # A class that is taken as a whole needs no threshold, but rows without a key are in no draw.
    keyed = group_sizes(df.where(F.col(key).isNotNull()), [label])
    limits = {(b, *c): "f" * 32 for c, n in sizes.items() if n == quota == keyed.get(c) for b in range(bags)}
    ends = {c: expected_bracket(quota, n) for c, n in sizes.items() if (0, *c) not in limits}
    if not ends:
        return limits
    low, high = (_by_class(label, {c: _digest_bound(e[i]) for c, e in ends.items()}) for i in (0, 1))
    bag = F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag")
    hashed = df.select(label, key, bag).select("bag", label, hash_order(key, seed, F.col("bag")).alias("_h"))
    near = stage_table(hashed.where((F.col("_h") > low) & (F.col("_h") <= high)), "draws")
    below = {}
    if any(e[0] > 0 for e in ends.values()):
        counted = hashed.where(F.col("_h") <= low).groupBy("bag", label).count()
        below = {(r["bag"], r[label]): r["count"] for r in counted.collect()}
    kind = df.schema[label].dataType.simpleString()
    # A row per bag and class.
    wanted = df.sparkSession.createDataFrame(
        [(b, *c, quota - below.get((b, *c), 0)) for c in ends for b in range(bags)], f"bag int, `{label}` {kind}, _rank long")
    # Equal hashes share the rank of the first of them, so those at the threshold are all in.
    place = F.rank().over(Window.partitionBy("bag", label).orderBy("_h"))
    first = near.withColumn("_r", place).join(F.broadcast(wanted), ["bag", label]).where(F.col("_r") <= F.col("_rank"))
    found = first.groupBy("bag", label).agg(F.max("_h").alias("_limit"), F.count("*").alias("_n"), F.first("_rank").alias("_rank"))
    limits |= {(r["bag"], r[label]): r["_limit"] for r in found.collect() if r["_n"] >= r["_rank"]}
    return limits if len(limits) == bags * len(sizes) else balanced_limits(df, label, key, seed, range(bags), most=most)


def bounded_draws(df: DataFrame, label: str, key: str, seed: int, bags: int, most: int | None = None) -> DataFrame:
    """The rows of ``balanced_draws``, at most ``most`` rows a bag if that is given."""
    limits = draw_limits(df, label, key, seed, bags, most)
    return df.withColumn("bag", F.explode(bags_of_row(label, key, seed, bags, limits)))


def _digest_bound(number: float) -> str:
    """The largest digest whose ``hash_number`` is at most ``number``."""
    return "f" * 32 if number >= HASH_RANGE else f"{max(0, int(number)):015x}" + "f" * 17
