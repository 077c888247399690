"""Test inputs that grow with the tables they are derived from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAULTS = 101  # one fault class per residue of the order key


def record_seq():
    """Input order of a line item as one bigint.

    Order and line number alone repeat; the low 22 bits mix in the other keys.
    """
    rest = (F.col("l_partkey") * 1009 + F.col("l_suppkey") * 9176
            + F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")))
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4194304 + F.pmod(rest, F.lit(4194304))


def faulty_records(lineitem: DataFrame) -> DataFrame:
    """Every line item as a raw text record, with one kind of fault per residue class.

    Names follow a foreign convention (Date, Ticker, O …) so the records also
    exercise column mapping.
    """
    fault = F.col("l_orderkey") % FAULTS
    price = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")

    def text(value, **faults):
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for residue, bad in faults.items():
            out = out.when(fault == int(residue[1:]), bad)
        return out.otherwise(value.cast("string"))

    none = F.lit(None).cast("string")
    return lineitem.select(
        record_seq().alias("row_seq"),
        text(F.concat(day, F.lit("T00:00:00Z")), f2=F.lit("not-a-date"), f3=none,
             f4=F.concat(day, F.lit("T00:00:00"))).alias("Date"),
        text(F.concat(F.lit("s"), F.col("l_suppkey"), F.lit(" ")), f1=none).alias("Ticker"),
        text(price, f5=F.lit("abc"), f6=F.lit("0")).alias("O"),
        text(price * 1.02, f7=(price * 0.9).cast("string")).alias("H"),
        text(price * 0.98, f8=(price * 1.05).cast("string")).alias("L"),
        text(price * 1.01, f9=none).alias("Adj_Close"),
        text(F.col("l_quantity"), f10=F.lit("-5"), f11=F.lit("0")).alias("Vol"),
    )


def synthetic_bars(symbols: DataFrame, days: int = 250, start: str = "2020-01-01",
                   base: float = 100.0, swing: float = 0.02) -> DataFrame:
    """Valid daily bars for a table with a `symbol` column, the same on every run.

    Returns come from a hash of (symbol, day); prices are their running product.
    The series length is the parameter `days`, so windows stay bounded.
    """
    def noise(tag):
        return F.pmod(F.xxhash64("symbol", "i", F.lit(tag)), F.lit(1_000_000)) / 1e6

    path = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy("symbol").orderBy("i")
    grid = symbols.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    close = grid.withColumn("r", (noise("r") - 0.5) * 2 * swing).withColumn(
        "close", F.lit(base) * F.exp(F.sum(F.log1p("r")).over(path)))
    opened = close.withColumn("open", F.coalesce(F.lag("close").over(step), F.lit(base)))
    return opened.select(
        F.date_add(F.lit(start).cast("date"), F.col("i")).cast("timestamp_ntz").alias("timestamp"),
        "symbol", "open",
        (F.greatest("open", "close") * (1 + noise("h") * swing)).alias("high"),
        (F.least("open", "close") * (1 - noise("l") * swing)).alias("low"),
        "close", F.floor(noise("v") * 1e6 + 1000).cast("double").alias("volume"))
