"""Modelling tables: bars, features and targets with disjoint column roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.features import compute_features
from barloom.functions.targets import compute_targets
from barloom.panel import DAILY, series_index
from barloom.schema import CANONICAL, feature_names, require_columns, target_names

ROLE = "role"


def join_features(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Attach feature columns the bars do not have yet, by key."""
    fresh = [c for c in features.columns if c not in bars.columns]
    return bars.join(features.select("symbol", "timestamp", *fresh), ["symbol", "timestamp"], "left")


def label_dataset(bars: DataFrame, features=None, targets=None, drop: bool = False,
                  grain: str = DAILY, parts: int | None = None) -> DataFrame:
    """Bars with features and targets in one plan; windows share the exchange on symbol."""
    featured = compute_features(bars, features, grain=grain, keep_bars=True, parts=parts)
    labelled = compute_targets(featured, targets, grain=grain, parts=parts)
    return labelled.dropna(subset=target_names(labelled.columns)) if drop else labelled


@dataclass(frozen=True)
class ModelingDataset:
    """A labelled table and the roles of its columns."""

    df: DataFrame
    features: tuple[str, ...]
    targets: tuple[str, ...]

    def __post_init__(self):
        both = set(self.features) & set(self.targets)
        if both:
            raise ValueError(f"columns are feature and target at once: {sorted(both)}")
        absent = (set(self.features) | set(self.targets)) - set(self.df.columns)
        if absent:
            raise ValueError(f"columns not in the table: {sorted(absent)}")

    @classmethod
    def infer(cls, df: DataFrame) -> ModelingDataset:
        """Roles from stored column metadata, else from names."""
        roles = {f.name: f.metadata.get(ROLE) for f in df.schema.fields}
        if any(roles.values()):
            return cls(df, tuple(c for c in df.columns if roles[c] == "feature"),
                       tuple(c for c in df.columns if roles[c] == "target"))
        return cls(df, tuple(feature_names(df.columns)), tuple(target_names(df.columns)))

    def x(self, drop: bool = True) -> DataFrame:
        out = self.df.select("timestamp", "symbol", *self.features)
        return out.dropna(subset=list(self.features)) if drop else out

    def y(self, target: str, drop: bool = True) -> DataFrame:
        if target not in self.targets:
            raise ValueError(f"{target} is not a target")
        out = self.df.select("timestamp", "symbol", target)
        return out.dropna(subset=[target]) if drop else out

    def modeling_rows(self, target: str) -> DataFrame:
        """Rows where all features and the chosen target are present."""
        columns = [*self.features, target]
        return self.df.select("timestamp", "symbol", *columns).dropna(subset=columns)

    def valid_rows(self, target: str, grain: str = DAILY) -> DataFrame:
        """Zero-based positions of the modelling rows in their symbol's series."""
        columns = [*self.features, target]
        indexed = series_index(self.df.select("timestamp", "symbol", *columns), grain)
        return indexed.dropna(subset=columns).select(
            "timestamp", "symbol", (F.col("n") - 1).alias("row_position"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write Parquet with the roles in the column metadata."""
        out = self.df
        for role, columns in (("feature", self.features), ("target", self.targets)):
            for c in columns:
                out = out.withMetadata(c, {ROLE: role})
        out.write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelingDataset:
        return cls.infer(require_columns(spark.read.parquet(path), CANONICAL[:2]))
