"""Feature registry: named, versioned frame functions and the checks every one must pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.numeric import pit_cutoff


@dataclass(frozen=True)
class Feature:
    name: str
    version: int
    inputs: tuple[str, ...]
    lookback: int
    outputs: tuple[str, ...]
    nullable: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]

    @property
    def key(self) -> str:
        return f"{self.name}@v{self.version}"


_FEATURES: dict[str, Feature] = {}


def register_feature(feature: Feature) -> Feature:
    if feature.key in _FEATURES:
        raise ValueError(f"{feature.key} is already registered")
    _FEATURES[feature.key] = feature
    return feature


def lookup_feature(key: str) -> Feature:
    if key not in _FEATURES:
        raise KeyError(f"no feature {key}; known: {sorted(_FEATURES)}")
    return _FEATURES[key]


def feature_keys() -> list[str]:
    return sorted(_FEATURES)


def compute_feature(feature: Feature, panel: DataFrame, now: Column | None = None, ts: str = "bar_ts") -> DataFrame:
    """Feature values known at ``now`` from rows known at ``now``."""
    missing = set(feature.inputs) - set(panel.columns)
    if missing:
        raise ValueError(f"{feature.key} needs {sorted(missing)}")
    known = panel if now is None else pit_cutoff(panel, now, ts)
    return feature.compute(known).select("symbol", ts, *feature.outputs)


def pit_differences(feature: Feature, panel: DataFrame, now: Column, ts: str = "bar_ts", digits: int = 9) -> DataFrame:
    """Rows in which the full history and the history up to ``now`` disagree."""
    full = pit_cutoff(compute_feature(feature, panel, None, ts), now, ts)
    cut = compute_feature(feature, panel, now, ts)

    def rounded(df):
        return df.select("symbol", ts, *[F.round(c, digits).alias(c) for c in feature.outputs])

    a, b = rounded(full), rounded(cut)
    return a.exceptAll(b).withColumn("side", F.lit("full")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("cut")))


def null_counts(feature: Feature, values: DataFrame) -> DataFrame:
    """Nulls per output; those of columns declared without nulls are violations."""
    one = values.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in feature.outputs])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.lit(c in feature.nullable).alias("may_be_null"))
        for c in feature.outputs])).alias("_r")).select("_r.*")
