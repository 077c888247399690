"""Writing bars, features, runs and raw archives with their catalogue entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.features import REGISTRY, feature_report
from barloom.schema import CANONICAL, feature_names, require_columns
from barloom.sources.catalog import catalog_records


def save_mode(overwrite: bool) -> str:
    """Existing data is kept unless the caller says otherwise."""
    return "overwrite" if overwrite else "errorifexists"


def write_bars(bars: DataFrame, path: str, catalog: str | None = None, provider: str = "", timeframe: str = "1d",
               overwrite: bool = False) -> None:
    """Snappy Parquet ordered by symbol and time, so a slice reads few row groups.

    Ranges are cut inside a symbol too, so a large one is written by many tasks.
    """
    require_columns(bars)
    (bars.select(*CANONICAL).repartitionByRange("symbol", "timestamp").sortWithinPartitions("symbol", "timestamp")
     .write.mode(save_mode(overwrite)).option("compression", "snappy").parquet(path))
    if catalog:
        written = bars.sparkSession.read.parquet(path)
        catalog_records(written, provider, timeframe).write.mode("append").parquet(catalog)


def write_features(features: DataFrame, path: str, catalog: str | None = None, overwrite: bool = False) -> None:
    """Feature Parquet and one catalogue row per feature with counts and definition."""
    features.write.mode(save_mode(overwrite)).option("compression", "snappy").parquet(path)
    if catalog:
        written = features.sparkSession.read.parquet(path)
        feature_catalog(written).write.mode("append").parquet(catalog)


def feature_catalog(features: DataFrame) -> DataFrame:
    """Counts per feature joined with its definition; unregistered columns are custom."""
    names = feature_names(features.columns)
    known = REGISTRY.catalog(features.sparkSession).withColumnRenamed("name", "feature").drop("custom")
    joined = feature_report(features, names).join(known, "feature", "left")
    return joined.withColumn("custom", F.col("feature_group").isNull())


def write_raw_archive(raw: DataFrame, path: str, provider: str, ingest_id: str) -> None:
    """Untouched records with their origin, one folder per ingest; an ingest sent again replaces its folder."""
    if not ingest_id:
        raise ValueError("an ingest needs an id")
    (raw.withColumns({"_provider": F.lit(provider), "ingest_id": F.lit(ingest_id)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_id").json(path))


def write_run(path: str, metrics: DataFrame, curve: DataFrame, trades: DataFrame,
              decisions: DataFrame | None = None, overwrite: bool = False) -> None:
    """Tables of back-tests, each partitioned by run."""
    tables = {"equity_curve": curve, "trades": trades} | ({"risk_decisions": decisions} if decisions is not None else {})
    for name, df in tables.items():
        by_time = [c for c in ("timestamp", "exit_time") if c in df.columns]
        df.repartitionByRange("run_id", *by_time).write.mode(save_mode(overwrite)).partitionBy("run_id").parquet(f"{path}/{name}")
    metrics.write.mode(save_mode(overwrite)).parquet(f"{path}/metrics")


def write_summary(summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """Fold summary as one CSV with header; a few rows per run."""
    summary.coalesce(1).write.mode(save_mode(overwrite)).option("header", True).csv(path)
