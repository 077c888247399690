"""Canonical bar layout and column roles."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"
IDENTIFIERS = ("timestamp", "symbol")
PRICES = ("open", "high", "low", "close")
NUMERIC = PRICES + ("volume",)
CANONICAL = IDENTIFIERS + NUMERIC
TARGET_PREFIX = "target_"

BAR_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC]
)


def require_columns(df, columns=CANONICAL):
    """Return `df`, or raise when a needed column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def unexpected_columns(df):
    return [c for c in df.columns if c not in CANONICAL]


def feature_names(columns):
    """Columns that are neither identifiers, bar fields nor targets."""
    return [c for c in columns if c not in CANONICAL and not c.startswith(TARGET_PREFIX)]


def target_names(columns):
    return [c for c in columns if c.startswith(TARGET_PREFIX)]
