import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import normalize as N
from barloom.operators import quality as Q
from barloom.panel import running
from barloom.plans import ORACLES, QUERIES
from barloom.sources import catalog as C
from barloom.sources import readers as R
from barloom.sources import writers as W

RAW = "row_seq bigint, timestamp string, symbol string, open string, high string, low string, close string, volume string"


def base():
    return [[i, f"2024-01-{d:02d}T00:00:00Z", "SPY", "100", "102", "99", "101", "1000"]
            for i, d in enumerate([1, 2, 3, 4, 5, 8, 9, 10, 11, 12])]


def swap_times(rows, a, b):
    rows[a][1], rows[b][1] = rows[b][1], rows[a][1]


def _fault(name):
    rows = base()
    if name == "duplicate":
        rows.append([10] + rows[2][1:])
    elif name == "missing":
        rows[3][6] = None
    elif name == "high":
        rows[1][4] = "90"
    elif name == "low":
        rows[4][5] = "116"
    elif name == "negative":
        rows[2][7] = "-500"
    elif name == "unsorted":
        swap_times(rows, 5, 6)
    elif name == "price":
        rows[3][3] = "0"
    elif name == "malformed":
        rows[0][1] = "not-a-time"
    elif name == "nan":
        rows[3][6] = "NaN"
    elif name == "type":
        rows[3][6] = "abc"
    elif name == "naive":
        rows[3][1] = "2024-01-04T00:00:00"
    elif name == "zero":
        rows[3][7] = "0"
    elif name == "gap":
        for i, day in enumerate([8, 9, 10, 11, 12, 15, 29]):
            rows[i][1] = f"2024-01-{day:02d}T00:00:00Z"
        rows = rows[:7]
    return rows


@pytest.mark.parametrize("name, codes", [
    ("valid", set()), ("duplicate", {"ERR_DUPLICATE_TIMESTAMP", "ERR_UNSORTED_TIMESTAMPS"}), ("missing", {"ERR_MISSING_VALUE"}),
    ("high", {"ERR_INVALID_OHLC_HIGH_OPEN", "ERR_INVALID_OHLC_HIGH_CLOSE", "ERR_INVALID_OHLC_HIGH_LOW"}),
    ("low", {"ERR_INVALID_OHLC_LOW_OPEN", "ERR_INVALID_OHLC_LOW_CLOSE", "ERR_INVALID_OHLC_HIGH_LOW"}),
    ("negative", {"ERR_NEGATIVE_VOLUME"}), ("unsorted", {"ERR_UNSORTED_TIMESTAMPS"}),
    ("price", {"ERR_NON_POSITIVE_PRICE", "ERR_INVALID_OHLC_LOW_OPEN"}), ("malformed", {"ERR_MALFORMED_TIMESTAMP"}),
    ("nan", {"ERR_MISSING_VALUE"}), ("type", {"ERR_TYPE_MISMATCH"}), ("naive", {"ERR_NAIVE_TIMESTAMP"}), ("zero", {"WARN_ZERO_VOLUME"}),
    ("gap", {"WARN_TRADING_SESSION_GAP"})])
@pytest.mark.parametrize("width", [3, 1000])
def test_each_fault_gives_its_codes(spark, name, codes, width):
    """The block width must not matter: order rules look across blocks."""
    found = Q.find_issues(spark.createDataFrame(_fault(name), RAW), F.floor(F.col("row_seq") / width))
    got = found.collect()
    assert {r.code for r in got} == codes
    if name == "gap":
        assert len(got) == 1 and got[0].message == "14 calendar days, 9 business days"


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_findings_read_and_parse_the_records_once(spark, tmp_path):
    spark.createDataFrame(_fault("gap"), RAW).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    found = Q.find_issues(raw, F.floor(F.col("row_seq") / 3))
    assert _scans(found) == 1 and _scans(Q.summary(found)) == 1
    assert _scans(Q.quarantine(raw, found)[0]) == 2  # the rows themselves once more


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_order_rules_equal_a_plain_loop(spark, width):
    """Hot symbol, repeated keys, faulty rows and blocks that a symbol leaves out."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        symbol = rng.choice(["spy", " SPY", "SPY ", "B", "C", None])
        day = f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T00:00:00Z" if rng.random() < 0.6 else "2024-03-01T00:00:00Z"
        rows.append([i, rng.choice([day, day, day, "never", None]), symbol, rng.choice(["100", "100", "x"]), "102", "99", "101", "5"])
    want, last, seen = set(), {}, set()
    for i, day, symbol, price, *_ in rows:
        if symbol is None or day in (None, "never") or price == "x":
            continue
        who, at = symbol.strip().upper(), datetime.fromisoformat(day)
        before = last.get(who)
        if before and at < before:
            want.add((i, "ERR_UNSORTED_TIMESTAMPS"))
        if before and (at - before).days > 4:
            between = sum((before + timedelta(days=d)).weekday() < 5 for d in range(1, (at - before).days))
            if between >= 3:
                want.add((i, "WARN_TRADING_SESSION_GAP"))
        if (who, at) in seen:
            want.add((i, "ERR_DUPLICATE_TIMESTAMP"))
        last[who] = at
        seen.add((who, at))
    found = Q.find_issues(spark.createDataFrame(rows, RAW), F.floor(F.col("row_seq") / width)).filter(
        F.col("code").isin("ERR_UNSORTED_TIMESTAMPS", "WARN_TRADING_SESSION_GAP", "ERR_DUPLICATE_TIMESTAMP")).collect()
    assert len(found) == len(want) and {(r.row_seq, r.code) for r in found} == want


@pytest.mark.parametrize("width", [1, 4, 10_000])
def test_rows_of_one_number_stand_in_time_order(spark, width):
    """Whatever order they arrive in, and also where they are the first or last of a block."""
    times = {0: [5], 1: [20, 3, 3], 4: [30, 30], 5: [9, 2], 8: [28, 28, 1]}
    rows = [[i, f"2024-01-{d:02d}T00:00:00Z", "SPY", "100", "102", "99", "101", "5"] for i, days in times.items() for d in days]
    ordered = [(i, d) for i, days in times.items() for d in sorted(days)]
    want = sorted((i, d) for (_, before), (i, d) in zip(ordered, ordered[1:]) if d < before)
    for given in (rows, rows[::-1]):
        found = Q.find_issues(spark.createDataFrame(given, RAW), F.floor(F.col("row_seq") / width)).collect()
        assert sorted((r.row_seq, r.timestamp.day) for r in found if r.code == "ERR_UNSORTED_TIMESTAMPS") == want
        assert sum(r.code == "ERR_DUPLICATE_TIMESTAMP" for r in found) == 3


def test_quality_queries_equal_their_sql_where_line_items_share_a_number(spark, tmp_path):
    """Other part and supplier, or part and day, and yet the same number."""
    rows = [(o, p + dp, s + ds, 1 + o % 3, 2.0, 20.0, datetime(2000, 1, 1) + timedelta(days=o * 7 % 300 + dd))
            for o in range(300) for p, s in [(10 + o % 2, 1010 + o % 4)]
            for dp, ds, dd in [(0, 0, 0)] + [(9176, -1009, 0)] * (o % 3 == 0) + [(1, 0, -1009)] * (o % 4 == 0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("dq_findings", "dq_report", "dq_summary", "dq_warn_trading_session_gap", "quarantine", "quarantine_offenders",
                 "code_counts", "dq_err_duplicate_timestamp", "dq_err_unexpected_symbol", "dq_err_unsorted_timestamps"):
        mine = QUERIES[name](spark, str(tmp_path))
        got = sorted(repr(tuple(r)) for r in mine.collect())
        assert got == sorted(repr(r) for r in db.execute(f"SELECT {', '.join(mine.columns)} FROM ({ORACLES[name]})").fetchall()), name


def test_findings_of_an_empty_table(spark):
    assert Q.find_issues(spark.createDataFrame([], RAW), F.lit(0)).count() == 0


def test_schema_issues_and_unexpected_symbol(spark):
    df = spark.createDataFrame(base(), RAW)
    assert ("ERR_MISSING_COLUMN", "error", "close") in Q.schema_issues(df.drop("close"))
    assert ("WARN_UNEXPECTED_COLUMN", "warning", "row_seq") in Q.schema_issues(df)
    with pytest.raises(ValueError):
        Q.row_findings(df.drop("close"))
    assert {r.code for r in Q.row_findings(df, "QQQ").collect()} == {"ERR_UNEXPECTED_SYMBOL"}


def test_date_range_warning(spark):
    df = spark.createDataFrame([(datetime(2024, 6, 1), "SPY")], "timestamp timestamp_ntz, symbol string")
    rows = Q.date_range_issues(df, "2024-01-01", "2024-06-05").collect()
    assert [(r.bound, r.days) for r in rows] == [("start", 152)]


def test_weekday_count_matches_calendar(spark):
    days = [datetime(2023, 12, 20) + timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(a, b) for a in days for b in days if a < b], "a timestamp_ntz, b timestamp_ntz")
    got = df.select("a", "b", (Q.weekdays_before(F.to_date("b")) - Q.weekdays_before(F.to_date("a"))).alias("w")).collect()
    for r in got:
        assert r.w == sum((r.a + timedelta(days=i)).weekday() < 5 for i in range((r.b - r.a).days))


def test_summary_report_quarantine(spark):
    raw = spark.createDataFrame(_fault("high"), RAW)
    found = Q.find_issues(raw, F.lit(0))
    assert Q.summary(found).first().asDict() == {"errors": 3, "warnings": 0, "codes": 3, "is_valid": 0}
    assert Q.report(found, rows=2).filter("more = 1").count() == 2
    clean, bad = Q.quarantine(raw, found)
    assert (clean.count(), bad.count()) == (9, 1)
    status = Q.ingest_status(raw, found).first()
    assert (status.status, status.record_count, status.error_count) == ("failed", 10, 3)


def test_synonyms_and_last_column_wins(spark):
    df = spark.createDataFrame([("2024-01-02", "spy ", 1.0, 2.0, 3.0)], "Date string, Ticker string, Close double, Adj_Close double, Vol double")
    out = N.map_columns(df)
    assert out.columns == ["timestamp", "symbol", "close", "volume"] and out.first().close == 2.0
    assert N.map_columns(df, {"Vol": "size"}).columns[-1] == "size"


def test_normalize_dedupes_first(spark):
    rows = base() + [[10] + base()[2][1:6] + ["55", "1"]]
    out = N.normalize(spark.createDataFrame(rows, RAW), N.NormalizeConfig(deduplicate=True))
    assert out.count() == 10 and out.filter("close = 55").count() == 0
    assert N.normalize_audit(spark.createDataFrame(rows, RAW)).first().asDict() == {"rows_normalized": 11, "duplicates_dropped": 1}


def test_default_symbol(spark):
    df = spark.createDataFrame(base(), RAW).drop("symbol")
    with pytest.raises(ValueError):
        N.normalize(df)
    assert N.normalize(df, N.NormalizeConfig(default_symbol="qqq")).first().symbol == "QQQ"


def test_symbols_and_baskets(spark):
    df = spark.createDataFrame([(" nsei",), ("AAPL",), ("^brk/b",)], "symbol string")
    assert [r[0] for r in df.select(N.index_alias(F.col("symbol"))).collect()] == ["^NSEI", "AAPL", "^brk/b"]
    assert [r[0] for r in df.select(N.symbol_slug(F.col("symbol"))).collect()] == ["nsei", "aapl", "brk_b"]
    assert N.basket_filter(df, "us_tech_top5").count() == 1
    with pytest.raises(ValueError):
        N.basket_filter(df, "none")


def test_write_read_guard_and_catalog(spark, bars, tmp_path):
    df, path = bars([1, 2, 3]), str(tmp_path / "bars")
    W.write_bars(df, path, str(tmp_path / "cat"), "test")
    with pytest.raises(Exception):
        W.write_bars(df, path)
    W.write_bars(df, path, overwrite=True)
    row = spark.read.parquet(str(tmp_path / "cat")).first()
    assert (row.record_count, row.is_valid) == (3, 1)
    assert R.read_bars(path, spark).count() == 3
    assert R.load_slice(R.read_bars(path, spark), "AAA", "2024-01-02", "2024-01-09").count() == 2
    assert C.content_fingerprint(df).first() == C.content_fingerprint(df.orderBy(F.desc("timestamp"))).first()
    with pytest.raises(ValueError):
        R.read_bars(df.drop("close"))


def test_read_raw_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"o": 1}, {"o": 2}]')
    (tmp_path / "b.json").write_text('{"records": [{"o": 1}, {"o": 2}, {"o": 3}]}')
    (tmp_path / "c.csv").write_text("o,h\n1,2\n")
    assert R.read_raw(spark, str(tmp_path / "a.json")).count() == 2
    assert R.read_raw(spark, str(tmp_path / "b.json")).count() == 3
    assert R.read_raw(spark, str(tmp_path / "c.csv")).dtypes == [("o", "string"), ("h", "string")]
    with pytest.raises(ValueError):
        R.read_raw(spark, "x.xyz")


def test_running_equals_plain_window_for_a_hot_key(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("i"),
        (F.pmod(F.xxhash64("id"), F.lit(100))).alias("v"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("s"))
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"a": F.sum("v").over(w), "b": F.max("v").over(w), "c": F.last("s", True).over(w), "e": F.min("v").over(w),
                           "d": F.last("s", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / 37), {
        "a": ("sum", "v"), "b": ("max", "v"), "c": ("last", "s"), "e": ("min", "v"), "d": ("prev", "s")})
    assert got.count() == 3000 and want.exceptAll(got.select(want.columns)).count() == 0
