"""Data-quality rules over raw or typed bars.

All row rules are columns of one plan that emits a long table of findings. The
rules that look at other rows (earlier than the previous row, calendar gap, key
seen before) go through the same plan: records are read and parsed once, dealt
by (symbol, block), and what a block can't know by itself is handed on in narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.normalize import ZONED, parse_time
from barloom.schema import CANONICAL, NUMERIC, PRICES, require_columns, unexpected_columns

ERROR, WARNING = "error", "warning"
GAP_DAYS, GAP_WEEKDAYS, RANGE_SLACK_DAYS = 4, 3, 7
FAULTY_PARTS = 1024   # groups that rows without a readable key are dealt to


def schema_issues(df: DataFrame) -> list[tuple[str, str, str]]:
    """(code, severity, column) for absent and unexpected columns, from the schema alone."""
    absent = [("ERR_MISSING_COLUMN", ERROR, c) for c in CANONICAL if c not in df.columns]
    return absent + [("WARN_UNEXPECTED_COLUMN", WARNING, c) for c in unexpected_columns(df)]


def weekdays_before(day: Column) -> Column:
    """Number of Mondays to Fridays before a date, counted from a fixed Monday."""
    since_monday = F.datediff(day, F.lit("1969-12-29").cast("date"))
    return F.floor(since_monday / 7) * 5 + F.least(F.pmod(since_monday, F.lit(7)), F.lit(5))


def _finding(when: Column, code: str, severity: str, field: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                                 F.lit(field).alias("field"), text.alias("message")))


def _typed(raw: DataFrame) -> DataFrame:
    """Parsed copies (_ts, _open …) and the stage at which a row is given up."""
    text = {c: F.col(c).try_cast("double") for c in NUMERIC}
    odd = {c: F.isnan(v) | (F.abs(v) == float("inf")) for c, v in text.items()}
    missing = F.lit(False)
    for c in CANONICAL:
        gone = F.col(c).isNull()
        missing = missing | (gone | F.coalesce(odd[c], F.lit(False)) if c in odd else gone)
    parsed = raw.withColumns(
        {"_ts": parse_time(raw, "timestamp"), "_missing": missing}
        | {f"_{c}": v for c, v in text.items()})
    unreadable = F.lit(False)
    for c in NUMERIC:
        unreadable = unreadable | F.col(f"_{c}").isNull()
    return parsed.withColumns({
        "_malformed": ~F.col("_missing") & F.col("_ts").isNull(),
        "_mismatch": ~F.col("_missing") & F.col("_ts").isNotNull() & unreadable,
    }).withColumn("_ok", ~(F.col("_missing") | F.col("_malformed") | F.col("_mismatch")))


def _row_rules(raw: DataFrame, expected_symbol: str | None) -> list[Column]:
    ok = F.col("_ok")
    o, h, lo, c, v = (F.col(f"_{x}") for x in NUMERIC)
    rules = [
        _finding(F.col("_missing"), "ERR_MISSING_VALUE", ERROR, "", "a canonical field is missing"),
        _finding(F.col("_malformed"), "ERR_MALFORMED_TIMESTAMP", ERROR, "timestamp",
                 "timestamp cannot be read"),
    ]
    rules += [_finding(F.col("_mismatch") & F.col(f"_{x}").isNull(), "ERR_TYPE_MISMATCH", ERROR, x,
                       f"{x} is not a number") for x in NUMERIC]
    if isinstance(raw.schema["timestamp"].dataType, T.StringType):
        rules.append(_finding(ok & ~F.trim("timestamp").rlike(ZONED), "ERR_NAIVE_TIMESTAMP", ERROR,
                              "timestamp", "timestamp has no zone"))
    if expected_symbol is not None:
        rules.append(_finding(ok & (F.upper(F.trim("symbol")) != expected_symbol.upper()),
                              "ERR_UNEXPECTED_SYMBOL", ERROR, "symbol", "symbol was not asked for"))
    rules += [_finding(ok & (F.col(f"_{x}") <= 0), "ERR_NON_POSITIVE_PRICE", ERROR, x,
                       f"{x} is not positive") for x in PRICES]
    rules += [
        _finding(ok & (v < 0), "ERR_NEGATIVE_VOLUME", ERROR, "volume", "volume is negative"),
        _finding(ok & (v == 0), "WARN_ZERO_VOLUME", WARNING, "volume", "volume is zero"),
        _finding(ok & (h < o), "ERR_INVALID_OHLC_HIGH_OPEN", ERROR, "high", "high is below open"),
        _finding(ok & (h < c), "ERR_INVALID_OHLC_HIGH_CLOSE", ERROR, "high", "high is below close"),
        _finding(ok & (h < lo), "ERR_INVALID_OHLC_HIGH_LOW", ERROR, "high", "high is below low"),
        _finding(ok & (lo > o), "ERR_INVALID_OHLC_LOW_OPEN", ERROR, "low", "low is above open"),
        _finding(ok & (lo > c), "ERR_INVALID_OHLC_LOW_CLOSE", ERROR, "low", "low is above close"),
    ]
    return rules


def row_findings(raw: DataFrame, expected_symbol: str | None = None) -> DataFrame:
    """Findings of the stateless rules only; also works on a stream."""
    typed = _typed(require_columns(raw))
    keep = [c for c in ("row_seq", "symbol") if c in raw.columns]
    return typed.select(
        *keep, F.col("_ts").alias("timestamp"),
        F.inline(F.array_compact(F.array(*_row_rules(raw, expected_symbol)))))


def _order_rules(ts: Column, prev: Column) -> list[Column]:
    """Findings of a valid row against the valid row before it; none without one."""
    days = F.datediff(ts, prev)
    business = weekdays_before(F.to_date(ts)) - weekdays_before(F.date_add(F.to_date(prev), 1))
    return [
        _finding(ts < prev, "ERR_UNSORTED_TIMESTAMPS", ERROR, "timestamp", "earlier than the previous row"),
        _finding((ts > prev) & (days > GAP_DAYS) & (business >= GAP_WEEKDAYS),
                 "WARN_TRADING_SESSION_GAP", WARNING, "timestamp",
                 F.concat(days.cast("string"), F.lit(" calendar days, "),
                          business.cast("string"), F.lit(" business days"))),
    ]


def find_issues(raw: DataFrame, block: Column, seq: str = "row_seq",
                expected_symbol: str | None = None) -> DataFrame:
    """All findings, one row each: seq, symbol, timestamp, code, severity, field, message.

    `seq` is the input order; rows of a symbol that share a number stand in the order of
    their timestamps. `block` cuts it into ranges of bounded size. Each record is read and parsed once. Inside (symbol, block) a row sees the
    row before it and earlier rows of its timestamp. A block's first and last row
    meet those of the symbol's other blocks, and the first row of a timestamp in a block meets
    that of other blocks, so a key repeated any number of times is one row per block there.
    Rows without a readable key take no part in either and are dealt by their number.
    """
    def dealt(number):
        return F.pmod(F.xxhash64(number), F.lit(FAULTY_PARTS)).cast("int")

    rows = _typed(require_columns(raw)).select(
        F.col(seq).alias("row_seq"), "symbol", F.col("_ts"), "_ok",
        F.when(F.col("_ok"), F.upper(F.trim("symbol"))).alias("_who"),
        F.when(F.col("_ok"), F.lit(-1)).otherwise(dealt(seq)).alias("_part"), block.alias("_blk"),
        F.array_compact(F.array(*_row_rules(raw, expected_symbol))).alias("_found"))
    place = ["_who", "_part", "_blk"]
    inside = Window.partitionBy(*place).orderBy("row_seq", "_ts")
    local = rows.withColumns({"_prev": F.lag("_ts").over(inside), "_last": F.lead("row_seq").over(inside).isNull()}).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*place, "_ts").orderBy("row_seq")))

    def duplicate(when):
        return _finding(when, "ERR_DUPLICATE_TIMESTAMP", ERROR, "timestamp", "key was seen before")

    def onward(who, at, part, start, found):
        return F.struct(who.alias("_who"), at.alias("_at"), part.alias("_part"), start.alias("_start"), found.alias("_found"))

    ok, ts, prev, first = F.col("_ok"), F.col("_ts"), F.col("_prev"), F.col("_rank") == 1
    here = F.concat("_found", F.array_compact(F.array(*[F.when(ok, r) for r in (*_order_rules(ts, prev), duplicate(~first))])))
    no, asks = F.lit(None), ok & first
    own = F.when(asks | (F.size(here) > 0), onward(
        F.when(asks, F.col("_who")), F.when(asks, ts), F.when(asks, F.lit(-1)).otherwise(dealt("row_seq")), F.lit(False), here))
    edge = F.when(ok & (prev.isNull() | F.col("_last")), onward(
        F.col("_who"), no.cast(rows.schema["_ts"].dataType), F.lit(-1), prev.isNull(), F.slice("_found", 1, 0)))
    passed = local.select("row_seq", "symbol", "_ts", F.inline(F.array_compact(F.array(own, edge))))
    before = F.lag("_ts").over(Window.partitionBy("_who", "_at", "_part").orderBy("row_seq", "_ts", F.desc("_start")))
    met = passed.withColumn("_before", before)
    seen = F.col("_before").isNotNull() & F.col("_who").isNotNull()
    across = [F.when(F.col("_start") & seen, r) for r in _order_rules(ts, F.col("_before"))] + [duplicate(seen & F.col("_at").isNotNull())]
    return met.select("row_seq", "symbol", F.col("_ts").alias("timestamp"),
                      F.inline(F.concat("_found", F.array_compact(F.array(*across)))))


def invalid_records(raw: DataFrame, column: str = "_corrupt_record") -> DataFrame:
    """Input lines the reader could not take apart, kept by Spark in a column of their own.

    `parsed_fields` counts what could be read; it also makes the reader parse the
    lines, which Spark demands of queries on that column.
    """
    parsed = sum((F.col(c).isNotNull().cast("int") for c in raw.columns if c != column), F.lit(0))
    return raw.filter(F.col(column).isNotNull()).select(
        F.lit("ERR_INVALID_RECORD_TYPE").alias("code"), F.lit(ERROR).alias("severity"), F.col(column).alias("message"),
        parsed.alias("parsed_fields"))


def date_range_issues(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Symbols whose data begin or end more than a week inside the requested range."""
    span = bars.groupBy("symbol").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    late = F.datediff("first", F.lit(start).cast("date"))
    early = F.datediff(F.lit(end).cast("date"), "last")
    code = "WARN_DATE_RANGE_MISMATCH"
    return span.select("symbol", F.inline(F.array_compact(F.array(
        F.when(late > RANGE_SLACK_DAYS, F.struct(
            F.lit(code).alias("code"), F.lit("start").alias("bound"), late.alias("days"))),
        F.when(early > RANGE_SLACK_DAYS, F.struct(
            F.lit(code).alias("code"), F.lit("end").alias("bound"), early.alias("days")))))))


def code_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("findings"))


def summary(findings: DataFrame) -> DataFrame:
    """Totals and verdict of a data set."""
    return findings.agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
        F.countDistinct("code").alias("codes"),
    ).withColumn("is_valid", (F.col("errors") == 0).cast("int"))


def report(findings: DataFrame, rows: int = 10) -> DataFrame:
    """First findings of each severity with the number left out."""
    window = Window.partitionBy("severity").orderBy("row_seq", "code", "field")
    first = (findings.withColumn("position", F.row_number().over(window))
             .filter(F.col("position") <= rows))
    totals = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("total"))
    return first.join(F.broadcast(totals), "severity").select(
        "severity", "position", "row_seq", "code", "field",
        F.greatest(F.col("total") - rows, F.lit(0)).alias("more"))


def quarantine(raw: DataFrame, findings: DataFrame, seq: str = "row_seq"):
    """(clean rows, offending rows); warnings do not quarantine.

    `seq` is all that names a row, so rows that share a number are clean or offending together.
    """
    offending = findings.filter(F.col("severity") == ERROR).select(
        F.col("row_seq").alias(seq)).distinct()
    return raw.join(offending, seq, "left_anti"), raw.join(offending, seq, "left_semi")


def clean_symbols(bars: DataFrame, findings: DataFrame) -> DataFrame:
    """Strict mode: a symbol with any error is kept out as a whole."""
    offending = findings.filter(F.col("severity") == ERROR).select("symbol").distinct()
    return bars.join(offending, "symbol", "left_anti")


def ingest_status(raw: DataFrame, findings: DataFrame) -> DataFrame:
    """One status row per symbol; a failing symbol does not stop the others."""
    rows = raw.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("record_count"), F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"))
    errors = findings.filter(F.col("severity") == ERROR).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_errors"), F.min("code").alias("first_code"))
    return rows.join(errors, "symbol", "left").select(
        "symbol", F.when(F.col("_errors") > 0, F.lit("failed")).otherwise("success").alias("status"),
        "record_count", "start", "end", F.coalesce("_errors", F.lit(0)).alias("error_count"),
        "first_code")
