"""Raw records to canonical bars."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import CANONICAL, NUMERIC

# Accepted source names per canonical column.
SYNONYMS = {
    "timestamp": ("timestamp", "date", "datetime", "time", "ts"),
    "symbol": ("symbol", "ticker", "sym"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "adj_close", "adjusted_close"),
    "volume": ("volume", "vol", "v"),
}
# Index codes that carry a caret.
CARET_INDICES = ("NSEI", "NSEBANK", "BSESN", "GSPC", "IXIC", "DJI", "VIX", "RUT")
# Named symbol lists.
BASKETS = {
    "nifty50_top5": ("^NSEI", "RELIANCE.NS", "TCS.NS", "HDFCBANK.NS", "INFY.NS", "ICICIBANK.NS"),
    "us_tech_top5": ("SPY", "AAPL", "MSFT", "NVDA", "AMZN", "GOOGL"),
}
ZONED = r"(Z|[+-]\d\d:?\d\d)$"
MILLIS_FROM = 1e11


@dataclass(frozen=True)
class NormalizeConfig:
    deduplicate: bool = False
    column_mapping: dict = field(default_factory=dict)
    timezone: str = "UTC"
    default_symbol: str | None = None


def map_columns(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Rename synonyms to canonical names; of colliding sources the last one wins."""
    known = {alias: name for name, aliases in SYNONYMS.items() for alias in aliases}
    known |= {k.strip().lower(): v for k, v in (mapping or {}).items()}
    chosen: dict[str, str] = {}
    for source in df.columns:
        clean = source.strip().lower()
        chosen[known.get(clean, clean)] = source
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in chosen.items()])


def clean_symbol(symbol: Column, default: str | None = None) -> Column:
    base = symbol if default is None else F.coalesce(symbol, F.lit(default))
    return F.upper(F.trim(base))


def parse_time(df: DataFrame, column: str, zone: str = "UTC") -> Column:
    """UTC instant of a time column, missing when it cannot be read.

    Numbers are epoch seconds, or milliseconds above 1e11; text may carry an
    offset, otherwise it is local to `zone`, as are zone-less timestamps to UTC.
    """
    kind, col = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.NumericType):
        seconds = F.when(col > MILLIS_FROM, col / 1000.0).otherwise(col.cast("double"))
        return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))
    if isinstance(kind, T.StringType):
        text = F.trim(col)
        parsed = text.try_cast("timestamp")
        return F.when(text.rlike(ZONED), parsed).otherwise(F.to_utc_timestamp(parsed, zone))
    return col.cast("timestamp")


def finite(value: Column) -> Column:
    """Missing for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def cast_numeric(column: str) -> Column:
    return finite(F.col(column).try_cast("double"))


def dedupe_first(df: DataFrame, seq: str = "row_seq") -> DataFrame:
    """First row per (symbol, timestamp) by input order.

    The first sequence number per key is combined before the shuffle, so a key
    repeated in a large part of the input costs one row per task.
    """
    firsts = df.groupBy("symbol", "timestamp").agg(F.min(seq).alias(seq))
    return df.join(firsts, ["symbol", "timestamp", seq], "left_semi")


def normalize(raw: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Canonical columns of any raw table; unreadable values become missing.

    Columns besides the canonical ones (such as an input sequence) are kept.
    """
    df = map_columns(raw, config.column_mapping)
    if "symbol" not in df.columns:
        if config.default_symbol is None:
            raise ValueError("raw data has no symbol and no default symbol is given")
        df = df.withColumn("symbol", F.lit(config.default_symbol))
    if "timestamp" not in df.columns:
        raise ValueError("raw data has no time column")
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    extra = [c for c in df.columns if c not in CANONICAL]
    out = df.select(
        parse_time(df, "timestamp", config.timezone).alias("timestamp"),
        clean_symbol(F.col("symbol"), config.default_symbol).alias("symbol"),
        *[cast_numeric(c).alias(c) for c in NUMERIC], *extra)
    if config.deduplicate:
        out = dedupe_first(out, "row_seq")
    return out


def normalize_audit(raw: DataFrame, config: NormalizeConfig = NormalizeConfig()) -> DataFrame:
    """Rows read, distinct keys and rows a dedupe would drop, in one pass."""
    out = normalize(raw, config)
    per_key = out.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(F.sum("c").alias("rows_normalized"),
                       F.sum(F.col("c") - 1).alias("duplicates_dropped"))


def sort_bars(df: DataFrame) -> DataFrame:
    return df.orderBy("symbol", "timestamp")


def index_alias(symbol: Column) -> Column:
    """Known index codes gain their caret; other symbols are only trimmed."""
    code = F.upper(F.trim(symbol))
    return F.when(code.isin(*CARET_INDICES), F.concat(F.lit("^"), code)).otherwise(F.trim(symbol))


def symbol_slug(symbol: Column) -> Column:
    """File-system friendly form of a symbol."""
    bare = F.regexp_replace(F.trim(symbol), r"^\^+", "")
    return F.lower(F.regexp_replace(bare, r"[/\\]", "_"))


def date_argument(value: Column) -> Column:
    """Calendar date part of a date, timestamp or ISO text."""
    return F.split(F.trim(value.cast("string")), "[T ]").getItem(0)


def basket_filter(df: DataFrame, basket: str) -> DataFrame:
    if basket not in BASKETS:
        raise ValueError(f"unknown basket {basket}; known: {sorted(BASKETS)}")
    return df.filter(F.col("symbol").isin(*BASKETS[basket]))


def preview(bars: DataFrame, rows: int = 5) -> DataFrame:
    """First bars in key order, without writing anything."""
    return sort_bars(bars).limit(rows)


def provenance(bars: DataFrame, provider: str, start: str, end: str, adjusted: bool = True,
               timezone: str = "UTC") -> DataFrame:
    """Requested against delivered bounds per symbol."""
    return bars.groupBy("symbol").agg(
        F.min("timestamp").alias("actual_start"), F.max("timestamp").alias("actual_end"),
        F.count(F.lit(1)).alias("row_count"),
    ).select(
        F.lit(provider).alias("provider"), "symbol", F.lit(start).alias("requested_start"),
        F.lit(end).alias("requested_end"), "actual_start", "actual_end",
        F.lit(timezone).alias("timezone"), F.lit(int(adjusted)).alias("adjusted"), "row_count")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], rows: int = 1) -> DataFrame:
    """Top rows per key; the rank limit is applied before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(
        F.col("_rank") <= rows).drop("_rank")
