"""Imputation and scaling fitted as plain aggregates and applied as plain projections."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.config import CATEGORICAL_FEATURES, INTERVENTIONS
from clinspark.functions.flags import age_group
from clinspark.operators.ordering import PIECE_ROWS, exact_medians
from clinspark.schemas import STAY_KEYS, nan_to_null, require_columns


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class ColumnGroups:
    numerical: tuple[str, ...]
    categorical: tuple[str, ...]
    interventions: tuple[str, ...]


def column_groups(columns: Sequence[str], exclude: Sequence[str] = (*STAY_KEYS, "target")) -> ColumnGroups:
    """Split feature names by the fixed lists; whatever is in neither list is numerical."""
    features = [c for c in columns if c not in exclude]
    categorical = tuple(c for c in features if c in CATEGORICAL_FEATURES)
    interventions = tuple(c for c in features if c in INTERVENTIONS)
    return ColumnGroups(
        tuple(c for c in features if c not in categorical and c not in interventions), categorical, interventions
    )


@dataclass(frozen=True)
class GroupMeans:
    """Fills a missing value with the mean of its age group and gender; at most one row per group."""

    columns: tuple[str, ...]
    rows: tuple[tuple, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> GroupMeans:
        require_columns(df, ["age", "gender"], "imputer input")
        filled = tuple(c for c in columns if c not in ("age", "gender"))
        if not filled:
            return cls((), ())
        # Seven age groups and none, by the values of gender and none.
        found = group_means(df, filled).collect()
        known = [r for r in found if r["age_group"] is not None and r["gender"] is not None]
        return cls(filled, tuple(tuple(r) for r in known))

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the means of each row's group as ``_m0``, ``_m1``, …; all NULL without a group."""
        kind = df.select("gender").schema[0].dataType.simpleString()
        fields = ["_group string", f"_gender {kind}", *[f"`_m{i}` double" for i in range(len(self.columns))]]
        table = df.sparkSession.createDataFrame(list(self.rows), ", ".join(fields))
        match = (age_group(F.col("age")) == F.col("_group")) & (F.col("gender") == F.col("_gender"))
        return df.join(F.broadcast(table), match, "left")

    def fill(self, name: str, value: Column) -> Column:
        """``value`` or, on rows with attached means, the mean of its group."""
        return F.coalesce(value, F.col(f"_m{self.columns.index(name)}")) if name in self.columns else value

    def transform(self, df: DataFrame) -> DataFrame:
        return self.attach(df).select([self.fill(c, _col(c)).alias(c) for c in df.columns])


def group_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each column per age group and gender."""
    grouped = df.groupBy(age_group(F.col("age")).alias("age_group"), "gender")
    return grouped.agg(*[F.avg(_col(c)).alias(c) for c in columns])


@dataclass(frozen=True)
class Medians:
    """Fills what is still missing with the exact median of the column, 0 for an empty column."""

    values: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], piece_rows: int = PIECE_ROWS) -> Medians:
        return cls(exact_medians(df, columns, piece_rows))

    def fill(self, name: str, value: Column) -> Column:
        return F.coalesce(value.cast("double"), F.lit(float(self.values[name]))) if name in self.values else value

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select([self.fill(c, _col(c)).alias(c) for c in df.columns])


@dataclass(frozen=True)
class Scaling:
    """Centres and divides by the population deviation, or by 1 where it is 0; gender is left alone."""

    mean: dict[str, float]
    deviation: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaling:
        scaled = [c for c in columns if c != "gender"]
        if not scaled:
            return cls({}, {})
        row = df.agg(
            *[F.avg(_col(c)).alias(f"_a{i}") for i, c in enumerate(scaled)],
            *[F.stddev_pop(_col(c)).alias(f"_s{i}") for i, c in enumerate(scaled)],
        ).first()
        return cls(
            {c: float(row[f"_a{i}"] or 0.0) for i, c in enumerate(scaled)},
            {c: float(row[f"_s{i}"] or 0.0) for i, c in enumerate(scaled)},
        )

    def scale(self, name: str, value: Column) -> Column:
        return (value - F.lit(self.mean[name])) / F.lit(self.deviation[name] or 1.0) if name in self.mean else value

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select([self.scale(c, _col(c)).alias(c) for c in df.columns])


@dataclass(frozen=True)
class Preparation:
    """Group means, then medians, then scaling; each step is fitted on the output of the step before."""

    numerical: tuple[str, ...]
    passthrough: tuple[str, ...]
    group_means: GroupMeans
    medians: Medians
    scaling: Scaling

    @classmethod
    def fit(cls, df: DataFrame, numerical: Sequence[str], passthrough: Sequence[str] = ()) -> Preparation:
        columns = [c for c in numerical if c != "gender"] + ["gender"]
        through = tuple(c for c in passthrough if c not in columns)
        data = nan_to_null(df.select(*[_col(c) for c in columns]))
        means = GroupMeans.fit(data, columns)
        filled = means.transform(data)
        medians = Medians.fit(filled, columns)
        return cls(tuple(columns), through, means, medians, Scaling.fit(medians.transform(filled), columns))

    @property
    def features(self) -> tuple[str, ...]:
        return self.numerical + self.passthrough

    def transform(self, df: DataFrame) -> DataFrame:
        """Other columns (keys, label), prepared columns, then the columns passed through untouched.

        One small join and one projection.
        """
        others = [c for c in df.columns if c not in self.features]
        attached = self.group_means.attach(nan_to_null(require_columns(df, self.features, "feature matrix")))

        def prepared(name: str) -> Column:
            filled = self.medians.fill(name, self.group_means.fill(name, _col(name)))
            return self.scaling.scale(name, filled).alias(name)

        return attached.select(
            *[_col(c) for c in others], *[prepared(c) for c in self.numerical], *[_col(c) for c in self.passthrough]
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Preparation:
        d = json.loads(text)
        means = d["group_means"]
        return cls(
            tuple(d["numerical"]), tuple(d["passthrough"]),
            GroupMeans(tuple(means["columns"]), tuple(tuple(r) for r in means["rows"])),
            Medians(d["medians"]["values"]), Scaling(**d["scaling"]),
        )
