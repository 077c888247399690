"""Queries that write and read back, and queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import targets as TG
from barloom.functions.features import compute_features

from barloom.operators import normalize as N
from barloom.operators import quality as Q
from barloom.operators.dataset import ModelingDataset
from barloom.plans import ingest, modeling, trading  # noqa: F401
from barloom.plans.core import SQL_PARTS, query, rounded, rounded_sql
from barloom.sources import readers as RD
from barloom.sources import writers as W
from barloom.streaming import bars as SB

_K = ("timestamp", "symbol")


@query("write_bars", "WITH {bars_s} " + rounded_sql("bars_s", *_K))
def _write_bars(t):
    path = SB.scratch(t.spark, "bars")
    W.write_bars(t.bars_s, path, f"{path}_catalog", "lineitem")
    return rounded(RD.read_bars(path, t.spark))


@query("overwrite_guard", """SELECT 1 AS refused, count(DISTINCT (o_orderdate, c_nationkey)) AS rows
  FROM orders JOIN customer ON o_custkey = c_custkey""")
def _guard(t):
    path = SB.scratch(t.spark, "guarded")
    W.write_bars(t.bars_n, path)
    try:
        W.write_bars(t.bars_n, path)
        refused = 0
    except Exception:  # noqa: BLE001 - Spark refuses to write over existing data
        refused = 1
    return t.spark.read.parquet(path).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("rows"))


@query("write_features", "WITH {bars_n}, {feats_n} SELECT 'return_21d' AS feature, count(*) AS rows, count(*) - count(return_21d) AS missing FROM feats "
       "UNION ALL SELECT 'sma_ratio_10_50', count(*), count(*) - count(sma_ratio_10_50) FROM feats")
def _write_features(t):
    path = SB.scratch(t.spark, "features")
    W.write_features(compute_features(t.bars_n, ["return_21d", "sma_ratio_10_50"]), path, f"{path}_catalog")
    return t.spark.read.parquet(f"{path}_catalog").select("feature", "rows", "missing")


@query("write_modeling", "WITH {labelled_n}, p AS (SELECT timestamp, symbol, " + ", ".join(
    [*modeling.FEATS, modeling.Y]) + " FROM labelled) " + rounded_sql("p", *_K))
def _write_modeling(t):
    path = SB.scratch(t.spark, "modeling")
    modeling.dataset(t).save(path)
    back = ModelingDataset.load(t.spark, path)
    return rounded(back.df.select("timestamp", "symbol", *back.features, modeling.Y))


@query("write_raw_archive", "SELECT o_orderkey, o_totalprice, 'orders' AS provider FROM orders")
def _archive(t):
    path = SB.scratch(t.spark, "raw")
    W.write_raw_archive(t.orders.select("o_orderkey", "o_totalprice"), path, "orders", "first")
    return t.spark.read.json(path).select("o_orderkey", "o_totalprice", F.col("_provider").alias("provider"))


@query("write_run_artifacts", "WITH {chain_n} SELECT symbol AS run_id, count(*) AS trades FROM trips GROUP BY 1")
def _run(t):
    path = SB.scratch(t.spark, "runs")
    W.write_run(path, trading.metrics(t), trading.curved(t), trading.trips(t))
    return t.spark.read.parquet(f"{path}/trades").groupBy("run_id").agg(F.count(F.lit(1)).alias("trades"))


@query("write_wf_summary", """WITH {chain_n}, {perf} SELECT run_id, trade_count FROM perf""")
def _summary(t):
    path = SB.scratch(t.spark, "summary")
    W.write_summary(trading.metrics(t).select("run_id", "trade_count"), path)
    return t.spark.read.option("header", True).csv(path).select("run_id", F.col("trade_count").cast("bigint").alias("trade_count"))


@query("scan_csv", "SELECT o_orderkey AS row_seq, o_orderdate AS timestamp, 'C' || CAST(o_custkey AS VARCHAR) AS symbol, o_totalprice AS close FROM orders")
def _csv(t):
    path = SB.scratch(t.spark, "csv") + ".csv"
    t.orders.select(F.col("o_orderkey").alias("row_seq"), F.col("o_orderdate").alias("Date"),
                    F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("Ticker"),
                    F.col("o_totalprice").alias("Adj_Close")).write.option("header", True).csv(path)
    raw = N.map_columns(RD.read_raw(t.spark, path))
    return raw.select(F.col("row_seq").cast("bigint").alias("row_seq"),
                      N.parse_time(raw, "timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol",
                      N.cast_numeric("close").alias("close"))


@query("scan_json", "SELECT o_orderkey AS row_seq, o_totalprice AS close FROM orders")
def _json(t):
    path = SB.scratch(t.spark, "json") + ".jsonl"
    t.orders.select(F.col("o_orderkey").alias("row_seq"), F.col("o_totalprice").alias("close")).write.json(path)
    return RD.read_raw(t.spark, path).select("row_seq", "close")


@query("dq_err_invalid_record_type", """SELECT 'ERR_INVALID_RECORD_TYPE' AS code, 'error' AS severity, 'order ' || CAST(o_orderkey AS VARCHAR) || ' {' AS message,
  0 AS parsed_fields FROM orders WHERE o_orderstatus = 'P'""")
def _broken_lines(t):
    """Orders as text lines; those with status P are not valid records."""
    path = SB.scratch(t.spark, "lines")
    line = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" {"))) \
        .otherwise(F.to_json(F.struct("o_orderkey", "o_totalprice")))
    t.orders.select(line.alias("value")).write.text(path)
    read = t.spark.read.schema("o_orderkey bigint, o_totalprice double, _corrupt_record string").json(path)
    return Q.invalid_records(read)


@query("dq_schema_issues", """SELECT code, severity, column_name, count(*) AS rows FROM orders, (VALUES ('ERR_MISSING_COLUMN', 'error', 'high'),
  ('ERR_MISSING_COLUMN', 'error', 'low'), ('ERR_MISSING_COLUMN', 'error', 'volume'), ('WARN_UNEXPECTED_COLUMN', 'warning', 'note')) v(code, severity, column_name)
  GROUP BY 1, 2, 3""")
def _schema(t):
    """Schema findings with the number of rows they concern."""
    df = t.orders.select(F.col("o_orderdate").alias("timestamp"), F.col("o_orderstatus").alias("symbol"), F.col("o_totalprice").alias("open"),
                         F.col("o_totalprice").alias("close"), F.col("o_orderpriority").alias("note"))
    found = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(n).alias("column_name"))
                      for c, s, n in Q.schema_issues(df)])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(found), "rows")


query("feature_catalog", """WITH {bars_n}, {feats_n} SELECT 'return_21d' AS feature, 'PRICE' AS feature_group, 21 AS lookback, 0 AS custom,
  count(*) AS rows, count(*) - count(return_21d) AS missing FROM feats UNION ALL SELECT 'vol_std_60d', 'VOLATILITY', 60, 0, count(*), count(*) - count(vol_std_60d) FROM feats
  UNION ALL SELECT 'mine', NULL, 0, 1, count(*), count(*) - count(return_21d) FROM feats""")(
    lambda t: W.feature_catalog(compute_features(t.bars_n, ["return_21d", "vol_std_60d"]).withColumn("mine", F.col("return_21d") * 2)).select(
        "feature", "feature_group", F.coalesce("lookback", F.lit(0)).alias("lookback"), F.col("custom").cast("int").alias("custom"), "rows", "missing"))
query("target_catalog", """WITH {bars_n}, {targets_n} SELECT 'target_fwd_ret_5d' AS target, 'forward_return' AS kind, 'regression' AS task, 5 AS horizon,
  count(*) AS rows, count(*) - count(target_fwd_ret_5d) AS missing FROM labels_t UNION ALL
  SELECT 'target_binary_up_10d', 'binary', 'classification', 10, count(*), count(*) - count(target_binary_up_10d) FROM labels_t""")(
    lambda t: TG.target_report(TG.compute_targets(t.bars_n, ["target_fwd_ret_5d", "target_binary_up_10d"]), ["target_fwd_ret_5d", "target_binary_up_10d"])
    .join(TG.REGISTRY.catalog(t.spark).withColumnRenamed("name", "target"), "target").select("target", "kind", "task", "horizon", "rows", "missing"))


# ---------------------------------------------------------------- streams


def _ticks(t):
    return SB.stream_table(t.spark, t.path, "events.parquet")


@query("stream_bars", "WITH {bars_e} " + rounded_sql("bars_e", *_K))
def _stream_bars(t):
    closing = SB.scratch(t.spark, "stream_end")
    bars = SB.stream_bars(_ticks(t), F.upper("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), "1 hour", closing=closing)
    out = SB.run_to_table(bars, SB.scratch(t.spark, "stream_bars"), closing=closing)
    return rounded(out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


@query("stream_dedupe", "SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events")
def _stream_dedupe(t):
    hours = _ticks(t).select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    out = SB.run_to_table(SB.stream_dedupe(hours, "hour", ["user_id", "hour"], "40 days"), SB.scratch(t.spark, "stream_dedupe"))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("stream_dq", "WITH {raw}, {findings} SELECT code, count(*) AS findings FROM findings WHERE code NOT IN "
       "('ERR_UNSORTED_TIMESTAMPS', 'WARN_TRADING_SESSION_GAP', 'ERR_DUPLICATE_TIMESTAMP') GROUP BY code")
def _stream_dq(t):
    from barloom.sources.fixtures import faulty_records

    raw = N.map_columns(faulty_records(SB.stream_table(t.spark, t.path, "lineitem.parquet")))
    out = SB.run_to_table(SB.stream_findings(raw), SB.scratch(t.spark, "stream_dq"))
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


SQL_PARTS["tape"] = """tape AS (SELECT event_id AS order_id, CAST(user_id AS VARCHAR) AS symbol, ts AS created_at, value * 0.5 AS limit_price
  FROM events WHERE event_type = 'purchase')"""


@query("stream_limit_touch", "WITH {tape} SELECT order_id, tape.symbol, created_at, min(b.ts) AS filled_at FROM tape JOIN events b "
       "ON tape.symbol = CAST(b.user_id AS VARCHAR) AND b.ts >= created_at "
       "AND b.value <= limit_price GROUP BY 1, 2, 3")
def _stream_touch(t):
    ticks = _ticks(t).withColumn("ts", F.col("ts").cast("timestamp"))
    orders = ticks.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("order_id"), F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("created_at"),
        F.lit("BUY").alias("action"), (F.col("value") * 0.5).alias("limit_price"))
    bars = ticks.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"),
                        F.col("value").alias("low"), F.col("value").alias("high"))
    closing = SB.scratch(t.spark, "stream_end")
    out = SB.run_to_table(SB.stream_limit_touch(orders, bars, closing=closing), SB.scratch(t.spark, "stream_touch"), closing=closing, rocksdb=True)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "filled_at")})
