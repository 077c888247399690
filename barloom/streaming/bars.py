"""Bars, dedupe, quality rules and limit touches on streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.quality import row_findings
from barloom.session import checkpoint_dir, importable
from barloom.streaming.limit_book import LimitBook

CLOSED = datetime(9000, 1, 1)


def stream_table(spark: SparkSession, path: str, pattern: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of the Parquet files below a folder, with the schema of the files present."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def open_end(stream: DataFrame, folder: str) -> DataFrame:
    """`stream` with a second source that stays empty until `close_stream` ends it.

    A watermark trails the newest row, so what it has not reached yet would stay in state
    when a bounded stream ends. The closing row, far in the future, moves the watermark beyond all rows.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def close_stream(spark: SparkSession, folder: str) -> None:
    """Write the closing row: its times lie in the far future, all other columns are null."""
    schema = spark.read.parquet(folder).schema
    far = [F.lit(CLOSED).cast(f.dataType) if "timestamp" in f.dataType.typeName() else F.lit(None).cast(f.dataType) for f in schema]
    spark.range(1).select(*[c.alias(f.name) for c, f in zip(far, schema, strict=True)]).write.mode("append").parquet(folder)


def stream_bars(ticks: DataFrame, symbol: Column, time: Column, price: Column, seq: Column,
                width: str = "1 day", late: str = "1 hour", volume: Column | None = None, closing: str | None = None) -> DataFrame:
    """Bars of an unbounded tick stream; a bar is emitted once the watermark passes its end.

    `closing` names a folder by which a bounded stream is ended (see `open_end`); without it the last bars stay in state.
    """
    trimmed = ticks.select(
        symbol.alias("symbol"), time.cast("timestamp").alias("_t"), price.cast("double").alias("_p"),
        seq.alias("_s"), (F.lit(1.0) if volume is None else volume.cast("double")).alias("_v"))
    trimmed = open_end(trimmed, closing) if closing else trimmed
    return (
        trimmed.withWatermark("_t", late).groupBy(F.window("_t", width), "symbol")
        .agg(F.min_by("_p", "_s").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
             F.max_by("_p", "_s").alias("close"), F.sum("_v").alias("volume"))
        .select(F.col("window.start").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume"))


def stream_dedupe(rows: DataFrame, time: str, keys, late: str = "1 hour") -> DataFrame:
    """First arrival per key; state is dropped once the watermark has passed."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def stream_findings(raw: DataFrame) -> DataFrame:
    """Row rules of the quality module; stateless, so they run on streams as they are."""
    return row_findings(raw)


def stream_limit_touch(orders: DataFrame, bars: DataFrame, late: str = "1 day", closing: str | None = None, shards: int = 1) -> DataFrame:
    """(order_id, symbol, created_at, filled_at): one row for each limit order, once a bar has reached it.

    Orders and bars of a symbol meet as keyed state: a book of price levels from which each bar takes what
    it reaches, so a touched order is gone and an untouched one is looked at by no bar that stays away from its
    level. Rows wait until the watermark has passed them and are worked off in order of time, at the same instant
    orders first; so the result depends neither on arrival order nor on batches. Later rows are dropped by the watermark.
    Orders are independent of each other: with `shards`, those of a symbol are dealt to so many books, and its bars go to
    all of them. Rows without a time, orders without a limit and bars without the price asked for have no effect.
    """
    importable(orders.sparkSession)
    shard = F.pmod(F.xxhash64("order_id"), F.lit(shards)).cast("int")
    book = orders.select("symbol", F.col("created_at").alias("_t"), shard.alias("_shard"), F.lit(0).alias("kind"), F.col("order_id").cast("long").alias("order_id"),
                         (F.col("action") == "BUY").alias("buy"), F.col("limit_price").cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>"))
    tape = bars.select("symbol", F.col("timestamp").alias("_t"), every.alias("_shard"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("order_id"),
                       F.lit(None).cast("boolean").alias("buy"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
    rows = book.unionByName(tape)
    rows = (open_end(rows, closing) if closing else rows).withWatermark("_t", late).filter("_t IS NOT NULL")
    touched = rows.groupBy("symbol", "_shard").transformWithState(
        LimitBook(), "order_id long, symbol string, created_us long, filled_us long", "append", "EventTime")
    return touched.select("order_id", "symbol", F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("filled_us").alias("filled_at"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_table(stream: DataFrame, path: str, mode: str = "append", closing: str | None = None, rocksdb: bool = False) -> DataFrame:
    """Process what is available into Parquet and return the written table.

    The sink's own log makes the write exactly-once across restarts. With `closing`, the folder given to the stream's
    operator, the stream is ended after that: what waits for the watermark is written, too. `rocksdb` keeps state in RocksDB.
    """
    spark = stream.sparkSession
    state = f"{path.rstrip('/')}_state"
    before = spark.conf.get(_PROVIDER)
    if rocksdb:
        spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        for ends in [False, True] if closing else [False]:
            if ends:
                close_stream(spark, closing)
            (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
             .trigger(availableNow=True).start(path).awaitTermination())
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
