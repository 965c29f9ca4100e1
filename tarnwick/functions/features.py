"""Feature functions by name: vectorised user functions over distinct keys, and the assembly of feature arrays.

A featurizer is a function from a pandas series of texts to a series of lists. It runs once for each distinct text, whose features are joined back, since
Catalyst doesn't merge equal inputs of a user function. What parses molecules must be registered by the caller; LETTERS is a stand-in.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[[pd.Series], pd.Series]] = {}


def register(name: str):
    """Adds a featurizer to the registry."""

    def add(f: Callable[[pd.Series], pd.Series]):
        REGISTRY[name] = f
        return f

    return add


@register("letters")
def letters(texts: pd.Series) -> pd.Series:
    """Length, and counts of upper-case letters, digits and other characters."""
    return texts.map(lambda t: [float(len(t)), float(sum(c.isupper() for c in t)), float(sum(c.isdigit() for c in t)), float(sum(not c.isalnum() for c in t))])


def featurize(df: DataFrame, column: str, name: str, to: str) -> DataFrame:
    """df with an array of features of a text column; null for null."""
    f = F.pandas_udf(REGISTRY[name], "array<double>")
    keys = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(keys.withColumn(to, f(column)), column, "left")


def assemble(*parts: Column) -> Column:
    """One array of several; a number counts as one entry."""
    return F.concat(*parts)


class GroupScaler(Estimator):
    """Standardises features by the training rows' mean and population deviation, and adds sums of groups of them (missing members count as 0)."""

    def __init__(self, features: list[str], groups: dict[str, list[str]] | None = None):
        super().__init__()
        self.features, self.groups = features, groups or {}

    def _fit(self, dataset: DataFrame) -> GroupScalerModel:
        row = dataset.agg(*(F.avg(f).alias(f"{f}_m") for f in self.features), *(F.stddev_pop(f).alias(f"{f}_s") for f in self.features)).head()
        return GroupScalerModel({f: (row[f"{f}_m"], row[f"{f}_s"]) for f in self.features}, self.groups)


class GroupScalerModel(Model):
    def __init__(self, moments: dict[str, tuple[float, float]], groups: dict[str, list[str]]):
        super().__init__()
        self.moments, self.groups = moments, groups

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sums = {}
        for g, members in self.groups.items():
            there = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in members if m in dataset.columns]
            sums[g] = sum(there, F.lit(0.0))
        scaled = {f: (F.col(f) - F.lit(m)) / F.lit((s or 0.0) + 1e-8) for f, (m, s) in self.moments.items() if m is not None}
        return dataset.withColumns(sums).withColumns(scaled)
