"""Reading bars and raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.normalize import NormalizeConfig, cast_numeric, map_columns, parse_time
from barloom.schema import BAR_SCHEMA, CANONICAL, NUMERIC, require_columns


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw records by file type; a JSON file may be an array or hold `records`."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "json":
        df = spark.read.option("multiLine", True).json(path)
        return df.select(F.inline("records")) if df.columns == ["records"] or "records" in df.columns else df
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if suffix in ("csv", "txt"):
        return spark.read.option("header", True).csv(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def load_table(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A table given as DataFrame or path."""
    return read_raw(spark, source) if isinstance(source, str) else source


def read_bars(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """Canonical bars; absent columns are an error."""
    df = spark.read.parquet(source) if isinstance(source, str) else source
    return require_columns(df).select(*CANONICAL)


def to_canonical(df: DataFrame) -> DataFrame:
    """Cast any table with canonical names to the canonical schema."""
    require_columns(df)
    cast = df.select(parse_time(df, "timestamp").alias("timestamp"),
                     F.upper(F.trim("symbol")).alias("symbol"),
                     *[cast_numeric(c).alias(c) for c in NUMERIC])
    return cast.to(BAR_SCHEMA)


def features_of(spark: SparkSession, source: DataFrame | str, names, **options) -> DataFrame:
    """Features of a table or of a file holding one."""
    from barloom.functions.features import compute_features

    return compute_features(load_table(spark, source), names, **options)


def load_slice(bars: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Bars of one symbol in a closed time range; both filters reach the scan."""
    kind = bars.schema["timestamp"].dataType.simpleString()
    return bars.filter((F.col("symbol") == symbol) & F.col("timestamp").between(
        F.lit(start).cast(kind), F.lit(end).cast(kind)))


def sql_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Ad-hoc SQL; tables are named {like_this} in the text."""
    return spark.sql(sql, **tables)


def to_utc_frame(df: DataFrame, zone: str) -> DataFrame:
    """Provider frame with local zone-less times to UTC bars; missing volume is zero."""
    named = map_columns(df, NormalizeConfig().column_mapping)
    return named.withColumns({
        "timestamp": F.to_utc_timestamp("timestamp", zone).cast("timestamp_ntz"),
        "symbol": F.upper(F.trim("symbol")),
        "volume": F.coalesce("volume", F.lit(0.0)),
    })
