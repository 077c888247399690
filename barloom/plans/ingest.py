"""Queries over scans, normalisation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import normalize as N
from barloom.operators import quality as Q
from barloom.plans.core import SQL_PARTS, nudged, query, rounded, rounded_sql
from barloom.sources import catalog as C
from barloom.sources import readers as R
from barloom.sources.fixtures import faulty_records, synthetic_bars

_K = ("timestamp", "symbol")
SEQ_BLOCK = 8 * 4194304 * 8192  # row_seq range of 8192 order keys

SQL_PARTS["raw"] = """raw AS (SELECT (l_orderkey * 8 + l_linenumber) * 4194304 + (l_partkey * 1009 + l_suppkey * 9176
  + date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) % 4194304 AS row_seq,
  CASE f WHEN 2 THEN 'not-a-date' WHEN 3 THEN NULL WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')
         ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS ts_text,
  CASE f WHEN 1 THEN NULL ELSE upper(trim('s' || CAST(l_suppkey AS VARCHAR) || ' ')) END AS symbol,
  CASE f WHEN 5 THEN 'abc' WHEN 6 THEN '0' ELSE CAST(p AS VARCHAR) END AS o_text,
  CAST(CASE f WHEN 7 THEN p * 0.9::DOUBLE ELSE p * 1.02::DOUBLE END AS VARCHAR) AS h_text,
  CAST(CASE f WHEN 8 THEN p * 1.05::DOUBLE ELSE p * 0.98::DOUBLE END AS VARCHAR) AS l_text,
  CASE f WHEN 9 THEN NULL ELSE CAST(p * 1.01::DOUBLE AS VARCHAR) END AS c_text,
  CASE f WHEN 10 THEN '-5' WHEN 11 THEN '0' ELSE CAST(l_quantity AS VARCHAR) END AS v_text
  FROM (SELECT *, l_orderkey % 101 AS f, l_extendedprice / l_quantity AS p FROM lineitem)),
typed AS (SELECT row_seq, symbol, ts_text, TRY_CAST(ts_text AS TIMESTAMP) AS timestamp,
  TRY_CAST(o_text AS DOUBLE) AS open, TRY_CAST(h_text AS DOUBLE) AS high, TRY_CAST(l_text AS DOUBLE) AS low,
  TRY_CAST(c_text AS DOUBLE) AS close, TRY_CAST(v_text AS DOUBLE) AS volume, o_text,
  (symbol IS NULL OR ts_text IS NULL OR o_text IS NULL OR h_text IS NULL OR l_text IS NULL OR c_text IS NULL
   OR v_text IS NULL) AS missing FROM raw)"""

_RULES = [
    ("missing", "ERR_MISSING_VALUE", "error", ""),
    ("NOT missing AND timestamp IS NULL", "ERR_MALFORMED_TIMESTAMP", "error", "timestamp"),
    ("NOT missing AND timestamp IS NOT NULL AND open IS NULL", "ERR_TYPE_MISMATCH", "error", "open"),
    ("ok AND right(ts_text, 1) <> 'Z'", "ERR_NAIVE_TIMESTAMP", "error", "timestamp"),
    ("ok AND open <= 0", "ERR_NON_POSITIVE_PRICE", "error", "open"),
    ("ok AND volume < 0", "ERR_NEGATIVE_VOLUME", "error", "volume"),
    ("ok AND volume = 0", "WARN_ZERO_VOLUME", "warning", "volume"),
    ("ok AND high < open", "ERR_INVALID_OHLC_HIGH_OPEN", "error", "high"),
    ("ok AND high < close", "ERR_INVALID_OHLC_HIGH_CLOSE", "error", "high"),
    ("ok AND high < low", "ERR_INVALID_OHLC_HIGH_LOW", "error", "high"),
    ("ok AND low > open", "ERR_INVALID_OHLC_LOW_OPEN", "error", "low"),
    ("ok AND low > close", "ERR_INVALID_OHLC_LOW_CLOSE", "error", "low"),
    ("ok AND timestamp < prev", "ERR_UNSORTED_TIMESTAMPS", "error", "timestamp"),
    ("ok AND date_diff('day', prev, timestamp) > 4 AND len(list_filter(range(prev + INTERVAL 1 DAY, timestamp, "
     "INTERVAL 1 DAY), lambda d: isodow(d) < 6)) >= 3", "WARN_TRADING_SESSION_GAP", "warning", "timestamp"),
    ("ok AND dup > 1", "ERR_DUPLICATE_TIMESTAMP", "error", "timestamp"),
]
_FINDINGS = " UNION ALL ".join(
    f"SELECT row_seq, symbol, timestamp, '{code}' AS code, '{sev}' AS severity, '{field}' AS field "
    f"FROM checked WHERE {cond}" for cond, code, sev, field in _RULES) + ")"
SQL_PARTS["findings"] = """flags AS (SELECT *, NOT missing AND timestamp IS NOT NULL AND open IS NOT NULL AS ok FROM typed),
good AS (SELECT row_seq, lag(timestamp) OVER (PARTITION BY symbol ORDER BY row_seq) AS prev,
  row_number() OVER (PARTITION BY symbol, timestamp ORDER BY row_seq) AS dup FROM flags WHERE ok),
checked AS (SELECT f.*, prev, dup FROM flags f LEFT JOIN good USING (row_seq)),
findings AS (""" + _FINDINGS
# Line items may share a row_seq, so what a row sees of others is not joined back by it.
SQL_PARTS["each_finding"] = """flags AS (SELECT *, NOT missing AND timestamp IS NOT NULL AND open IS NOT NULL AS ok FROM typed),
checked AS (SELECT *, CASE WHEN ok THEN lag(timestamp) OVER (PARTITION BY ok, symbol ORDER BY row_seq, timestamp) END AS prev,
  CASE WHEN ok THEN row_number() OVER (PARTITION BY ok, symbol, timestamp ORDER BY row_seq) END AS dup FROM flags),
findings AS (""" + _FINDINGS


def raw(t):
    return N.map_columns(faulty_records(t.lineitem))


def findings(t):
    return Q.find_issues(raw(t), F.floor(F.col("row_seq") / F.lit(SEQ_BLOCK)))


# ---------------------------------------------------------------- scans

query("scan_parquet", "WITH {bars_n} " + rounded_sql("bars_n", *_K))(
    lambda t: rounded(R.read_bars(t.bars_n)))
query("scan_records", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")(
    lambda t: R.load_table(t.spark, f"{t.path}/orders.parquet").select(
        "o_orderkey", "o_orderdate", "o_totalprice"))
query("scan_raw_parquet", """SELECT o_orderdate AS timestamp, CAST(o_custkey AS VARCHAR) AS symbol,
  o_totalprice AS close FROM orders""")(
    lambda t: N.map_columns(t.orders.select(
        F.col("o_orderdate").alias("Date"), F.col("o_custkey").cast("string").alias(" Ticker "),
        F.col("o_totalprice").alias("Adjusted_Close"))))
query("scan_features_input", "WITH {bars_n}, {feats_n}, p AS (SELECT timestamp, symbol, return_1d FROM feats) "
      + rounded_sql("p", *_K))(
    lambda t: rounded(R.features_of(t.spark, t.bars_n, ["return_1d"])))
query("apply_canonical_schema", "WITH {raw} SELECT timestamp, symbol, " + ", ".join(
    f"round({c} + 1.3e-9, 6) AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM typed")(
    lambda t: rounded(R.to_canonical(raw(t)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))))
query("sql_query", """SELECT n_name, count(*) AS orders, round(avg(o_totalprice), 4) AS avg_price FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")(
    lambda t: R.sql_query(
        t.spark,
        "SELECT n_name, count(*) AS orders, round(avg(o_totalprice), 4) AS avg_price FROM {orders} o "
        "JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey GROUP BY n_name",
        orders=t.orders, customer=t.customer, nation=t.nation))
query("load_slice", "WITH {bars_s}, p AS (SELECT * FROM bars_s WHERE symbol = 'S7' AND timestamp "
      "BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30') " + rounded_sql("p", *_K))(
    lambda t: rounded(R.load_slice(t.bars_s, "S7", "1996-01-01", "1997-06-30")))
query("preview", "WITH {bars_n} SELECT timestamp, symbol, close, volume FROM bars_n ORDER BY symbol, timestamp LIMIT 5")(
    lambda t: N.preview(t.bars_n).select("timestamp", "symbol", "close", "volume"))
query("inspect_dataset", """WITH {bars_s} SELECT symbol, count(*) AS rows, min(timestamp) AS start, max(timestamp) AS "end"
  FROM bars_s GROUP BY symbol""")(lambda t: C.bars_by_symbol(t.bars_s))
query("bars_by_symbol", """WITH {bars_n} SELECT symbol, count(*) AS rows, min(timestamp) AS start, max(timestamp) AS "end"
  FROM bars_n GROUP BY symbol""")(lambda t: C.bars_by_symbol(t.bars_n))
query("sql_bar_stats", """WITH {bars_s} SELECT symbol, count(*) AS bars, round(avg(close) + 1.3e-9, 6) AS avg_close,
  round(max(high) + 1.3e-9, 6) AS max_high, round(min(low) + 1.3e-9, 6) AS min_low FROM bars_s GROUP BY symbol""")(
    lambda t: t.bars_s.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), nudged(F.avg("close")).alias("avg_close"),
        nudged(F.max("high")).alias("max_high"), nudged(F.min("low")).alias("min_low")))
query("distinct_symbols", "SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem")(
    lambda t: C.distinct_symbols(t.bars_s))
query("catalog_record", """WITH {bars_n} SELECT 'orders' AS provider, symbol, '1d' AS timeframe, min(timestamp) AS start,
  max(timestamp) AS "end", 'UTC' AS timezone, '1.0.0' AS schema_version, count(*) AS record_count,
  1 AS is_valid FROM bars_n GROUP BY symbol""")(
    lambda t: C.catalog_records(t.bars_n, "orders", "1d").drop("checksum"))
query("fingerprint")(lambda t: C.content_fingerprint(t.bars_n))
query("file_fingerprint")(lambda t: C.file_fingerprints(t.spark, f"{t.path}/*.parquet"))
query("list_datasets")(lambda t: C.list_datasets(t.spark, {
    "orders": f"{t.path}/orders.parquet", "lineitem": f"{t.path}/lineitem.parquet",
    "events": f"{t.path}/events.parquet"}))
query("dataset_totals")(lambda t: C.dataset_totals(C.list_datasets(t.spark, {
    "orders": f"{t.path}/orders.parquet", "lineitem": f"{t.path}/lineitem.parquet"})))
query("list_artifacts")(lambda t: C.newest_files(t.spark, {"tables": t.path}))
query("synthetic_bars")(lambda t: synthetic_bars(
    t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"))))

# ---------------------------------------------------------------- normalisation

query("anomaly_fixtures", "WITH {raw} SELECT row_seq, symbol, ts_text FROM raw")(
    lambda t: raw(t).select("row_seq", F.upper(F.trim("symbol")).alias("symbol"),
                            F.col("timestamp").alias("ts_text")))
query("norm_columns", """SELECT o_orderkey AS row_seq, o_orderdate AS timestamp, o_orderstatus AS symbol,
  o_totalprice * 2 AS close, CAST(o_custkey AS DOUBLE) AS volume, o_orderpriority AS note FROM orders""")(
    lambda t: N.map_columns(t.orders.select(
        F.col("o_orderkey").alias("Id"), F.col("o_orderdate").alias("DateTime"),
        F.col("o_orderstatus").alias(" Sym "), F.col("o_totalprice").alias("Close"),
        (F.col("o_totalprice") * 2).alias("Adj_Close"), F.col("o_custkey").cast("double").alias("VOL"),
        F.col("o_orderpriority").alias("Note")), {"id": "row_seq"}))
query("norm_symbol", """SELECT event_id, upper(trim(coalesce(CASE WHEN event_type <> 'error' THEN ' ' || event_type || ' ' END,
  'spy'))) AS symbol FROM events""")(
    lambda t: t.events.select("event_id", N.clean_symbol(
        F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))),
        "spy").alias("symbol")))


@query("norm_timestamp", """SELECT event_id,
  make_timestamp(epoch_us(date_trunc('second', ts))) AS from_seconds,
  make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_millis,
  date_trunc('second', ts) AS from_zulu,
  date_trunc('second', ts) - INTERVAL 330 MINUTE AS from_offset,
  date_trunc('second', ts) - INTERVAL 330 MINUTE AS from_local,
  ts AS from_naive, NULL::TIMESTAMP AS from_junk FROM events""")
def _norm_timestamp(t):
    instant = F.col("ts").cast("timestamp")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    df = t.events.select(
        "event_id", F.unix_seconds(instant).alias("seconds"), F.unix_millis(instant).alias("millis"),
        F.concat(text, F.lit("Z")).alias("zulu"), F.concat(text, F.lit("+05:30")).alias("offset"),
        text.alias("local"), F.col("ts").alias("naive"), F.lit("soon").alias("junk"))
    forms = {"seconds": "UTC", "millis": "UTC", "zulu": "UTC", "offset": "UTC",
             "local": "Asia/Kolkata", "naive": "UTC", "junk": "UTC"}
    return df.select("event_id", *[N.parse_time(df, c, zone).cast("timestamp_ntz").alias(f"from_{c}")
                                   for c, zone in forms.items()])


query("norm_cast", """WITH {raw} SELECT row_seq, round(open + 1.3e-9, 6) AS open,
  CASE WHEN open IS NULL AND o_text IS NOT NULL THEN 1 ELSE 0 END AS failed FROM typed""")(
    lambda t: raw(t).select("row_seq", nudged(N.cast_numeric("open")).alias("open"),
                            (F.col("open").isNotNull() & N.cast_numeric("open").isNull()).cast("int").alias("failed")))
query("norm_dedupe", """WITH {raw} SELECT min(row_seq) AS row_seq, symbol, timestamp FROM typed
  WHERE symbol IS NOT NULL AND timestamp IS NOT NULL GROUP BY symbol, timestamp""")(
    lambda t: N.normalize(faulty_records(t.lineitem), N.NormalizeConfig(deduplicate=True)).select(
        "row_seq", "symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))
    .dropna(subset=["symbol", "timestamp"]))
query("norm_sort", "WITH {bars_n} SELECT symbol, timestamp, volume FROM bars_n ORDER BY symbol, timestamp")(
    lambda t: N.sort_bars(t.bars_n.select("symbol", "timestamp", "volume")))
query("norm_audit", """WITH {raw}, k AS (SELECT symbol, timestamp, count(*) AS c FROM typed GROUP BY 1, 2)
  SELECT CAST(sum(c) AS BIGINT) AS rows_normalized, CAST(sum(c - 1) AS BIGINT) AS duplicates_dropped FROM k""")(
    lambda t: N.normalize_audit(faulty_records(t.lineitem)))
_CODES = ["nsei", " GSPC ", "aapl", "vix", "^DJI", "brk/b"]
_CODE_SQL = "(CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END)"


def _code():
    return F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("o_orderkey") % 6 + 1).cast("int"))


query("index_alias", f"""SELECT o_orderkey, CASE WHEN upper(trim({_CODE_SQL})) IN ('NSEI','NSEBANK','BSESN','GSPC','IXIC','DJI',
  'VIX','RUT') THEN '^' || upper(trim({_CODE_SQL})) ELSE trim({_CODE_SQL}) END AS symbol FROM orders""")(
    lambda t: t.orders.select("o_orderkey", N.index_alias(_code()).alias("symbol")))
query("symbol_slug", f"""SELECT o_orderkey, lower(replace(replace(ltrim(trim({_CODE_SQL}), '^'), '/', '_'), chr(92), '_')) AS slug
  FROM orders""")(lambda t: t.orders.select("o_orderkey", N.symbol_slug(_code()).alias("slug")))
query("date_arg", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS from_timestamp,
  strftime(ts, '%Y-%m-%d') AS from_text FROM events""")(
    lambda t: t.events.select(
        "event_id", N.date_argument(F.col("ts")).alias("from_timestamp"),
        N.date_argument(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("from_text")))
query("to_utc_frame", """SELECT event_id AS row_seq, ts - INTERVAL 330 MINUTE AS timestamp, upper(event_type) AS symbol,
  value AS close, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value END AS volume FROM events""")(
    lambda t: R.to_utc_frame(t.events.select(
        F.col("event_id").alias("row_seq"), F.col("ts").alias("Datetime"), F.col("event_type").alias("Symbol"),
        F.col("value").alias("Close"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("Volume")),
        "Asia/Kolkata"))
query("provenance_cols", """WITH {bars_n} SELECT 'orders' AS provider, symbol, '1995-01-01' AS requested_start,
  '2001-12-31' AS requested_end, min(timestamp) AS actual_start, max(timestamp) AS actual_end, 'UTC' AS timezone,
  1 AS adjusted, count(*) AS row_count FROM bars_n GROUP BY symbol""")(
    lambda t: N.provenance(t.bars_n, "orders", "1995-01-01", "2001-12-31"))
query("basket_filter", """SELECT o_orderkey, sym AS symbol FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SPY'
  WHEN 1 THEN 'TCS.NS' WHEN 2 THEN 'AAPL' ELSE 'TSLA' END AS sym FROM orders) WHERE sym IN ('SPY', 'AAPL')""")(
    lambda t: N.basket_filter(t.orders.select("o_orderkey", F.element_at(
        F.array(*[F.lit(c) for c in ("SPY", "TCS.NS", "AAPL", "TSLA")]),
        (F.col("o_orderkey") % 4 + 1).cast("int")).alias("symbol")), "us_tech_top5"))

# ---------------------------------------------------------------- quality

_FIND, _EACH = "WITH {raw}, {findings} ", "WITH {raw}, {each_finding} "
query("dq_findings", _EACH + "SELECT row_seq, symbol, timestamp, code, severity, field FROM findings")(
    lambda t: findings(t).select(
        "row_seq", F.upper(F.trim("symbol")).alias("symbol"),
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "code", "severity", "field"))
query("dq_row_rules", _FIND + "SELECT code, count(*) AS findings FROM findings WHERE code NOT IN "
      "('ERR_UNSORTED_TIMESTAMPS', 'WARN_TRADING_SESSION_GAP', 'ERR_DUPLICATE_TIMESTAMP') GROUP BY code")(
    lambda t: Q.row_findings(raw(t)).groupBy("code").agg(F.count(F.lit(1)).alias("findings")))
# Rules that look at other rows; the rest is row-local.
ORDERED = ("ERR_UNSORTED_TIMESTAMPS", "WARN_TRADING_SESSION_GAP", "ERR_DUPLICATE_TIMESTAMP")
for _code_name in ("ERR_MISSING_VALUE", "ERR_MALFORMED_TIMESTAMP", "ERR_TYPE_MISMATCH", "ERR_NAIVE_TIMESTAMP",
                   "ERR_UNSORTED_TIMESTAMPS", "WARN_TRADING_SESSION_GAP", "ERR_DUPLICATE_TIMESTAMP",
                   "ERR_NON_POSITIVE_PRICE", "ERR_NEGATIVE_VOLUME", "WARN_ZERO_VOLUME",
                   "ERR_INVALID_OHLC_HIGH_OPEN", "ERR_INVALID_OHLC_HIGH_CLOSE", "ERR_INVALID_OHLC_HIGH_LOW",
                   "ERR_INVALID_OHLC_LOW_OPEN", "ERR_INVALID_OHLC_LOW_CLOSE"):
    query("dq_" + _code_name.lower(), (_EACH if _code_name in ORDERED else _FIND) + f"SELECT row_seq, field FROM findings WHERE code = '{_code_name}'")(
        lambda t, c=_code_name: (findings(t) if c in ORDERED else Q.row_findings(raw(t)))
        .filter(F.col("code") == c).select("row_seq", "field"))
query("dq_err_unexpected_symbol", _EACH + "SELECT row_seq FROM checked WHERE ok AND symbol <> 'S1'")(
    lambda t: Q.row_findings(raw(t), "S1").filter(F.col("code") == "ERR_UNEXPECTED_SYMBOL").select("row_seq"))
query("dq_warn_date_range_mismatch", """WITH {bars_s}, b AS (SELECT symbol, CAST(min(timestamp) AS DATE) AS a,
  CAST(max(timestamp) AS DATE) AS z FROM bars_s GROUP BY symbol)
  SELECT symbol, 'WARN_DATE_RANGE_MISMATCH' AS code, 'start' AS bound, date_diff('day', DATE '1995-01-01', a) AS days
  FROM b WHERE date_diff('day', DATE '1995-01-01', a) > 7 UNION ALL
  SELECT symbol, 'WARN_DATE_RANGE_MISMATCH', 'end', date_diff('day', z, DATE '2001-10-20') FROM b
  WHERE date_diff('day', z, DATE '2001-10-20') > 7""")(
    lambda t: Q.date_range_issues(t.bars_s, "1995-01-01", "2001-10-20")
    .withColumn("days", F.col("days").cast("bigint")))
query("code_counts", _EACH + "SELECT code, severity, count(*) AS findings FROM findings GROUP BY 1, 2")(
    lambda t: Q.code_counts(findings(t)))
query("dq_summary", _EACH + """SELECT count(*) FILTER (WHERE severity = 'error') AS errors,
  count(*) FILTER (WHERE severity = 'warning') AS warnings, count(DISTINCT code) AS codes, 0 AS is_valid FROM findings""")(
    lambda t: Q.summary(findings(t)))
query("dq_report", _EACH + """, r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY row_seq, code, field) AS position,
  count(*) OVER (PARTITION BY severity) AS total FROM findings)
  SELECT severity, position, row_seq, code, field, greatest(total - 10, 0) AS more FROM r WHERE position <= 10""")(
    lambda t: Q.report(findings(t)))
query("quarantine", _EACH + "SELECT row_seq FROM typed WHERE row_seq NOT IN "
      "(SELECT row_seq FROM findings WHERE severity = 'error')")(
    lambda t: Q.quarantine(raw(t), findings(t))[0].select("row_seq"))
query("quarantine_offenders", _EACH + "SELECT row_seq FROM typed WHERE row_seq IN "
      "(SELECT row_seq FROM findings WHERE severity = 'error')")(
    lambda t: Q.quarantine(raw(t), findings(t))[1].select("row_seq"))


def _order_records(t):
    """Orders as records of their customer; a customer with an odd status text fails."""
    return t.orders.select(
        F.col("o_orderkey").alias("row_seq"), F.col("o_orderdate").alias("timestamp"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        *[F.when(F.col("o_orderkey") % 37 != 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias(c)
          for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))


SQL_PARTS["bad_orders"] = """bad AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS symbol, 4 * count(*) AS errors FROM orders
  WHERE o_orderkey % 37 = 0 AND o_totalprice > 0 GROUP BY 1)"""
query("batch_ingest", """WITH {bad_orders} SELECT symbol, CASE WHEN errors > 0 THEN 'failed' ELSE 'success' END AS status,
  count(*) AS record_count, min(o_orderdate) AS start, max(o_orderdate) AS "end", coalesce(max(errors), 0) AS error_count,
  CASE WHEN errors > 0 THEN 'ERR_NON_POSITIVE_PRICE' END AS first_code
  FROM (SELECT *, 'C' || CAST(o_custkey AS VARCHAR) AS symbol FROM orders) LEFT JOIN bad USING (symbol) GROUP BY symbol, errors""")(
    lambda t: Q.ingest_status(_order_records(t), Q.row_findings(_order_records(t))))
query("clean_symbols", """WITH {bad_orders} SELECT o_orderkey AS row_seq FROM orders
  WHERE 'C' || CAST(o_custkey AS VARCHAR) NOT IN (SELECT symbol FROM bad)""")(
    lambda t: Q.clean_symbols(_order_records(t), Q.row_findings(_order_records(t))).select("row_seq"))
