"""Registered queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass
class Tables:
    """The given tables of one directory and the bars derived from them."""

    spark: SparkSession
    path: str
    _seen: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._seen[name]

    @property
    def bars_s(self) -> DataFrame:
        return B.supplier_bars(self.lineitem)

    def over_bars_s(self, use) -> DataFrame:
        """`use(bars_s)` for windows over symbols: its ticks move once, symbols get their names at the end."""
        bars, parts = B.supplier_series(self.lineitem)
        return B.named(use(bars, parts=parts), "S")

    @property
    def bars_n(self) -> DataFrame:
        return B.nation_bars(self.orders, self.customer, self.nation)

    @property
    def bars_e(self) -> DataFrame:
        return B.event_bars(self.events)


# The same derived tables in SQL, used as {name} inside the oracle texts.
SQL_PARTS = {
    "bars_s": """bars_s AS (SELECT CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS timestamp,
  'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
  min_by(p, k) AS open, max(p) AS high, min(p) AS low, max_by(p, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p,
        (l_orderkey * 8 + l_linenumber) * 65536 + l_partkey % 65536 AS k FROM lineitem) GROUP BY ALL)""",
    "bars_n": """bars_n AS (SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS timestamp, n_name AS symbol,
  min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""",
    "bars_e": """bars_e AS (SELECT date_trunc('hour', ts) AS timestamp, upper(event_type) AS symbol,
  min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
  max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)""",
}


def expand(sql: str) -> str:
    """Insert the derived tables named as {part}."""
    for _ in range(4):
        for name, text in SQL_PARTS.items():
            sql = sql.replace("{" + name + "}", text)
    return sql


# Added before rounding output: decimal ties (…5) then round alike in every engine.
NUDGE = 1.3e-9
# The same for sums of money in cents, whose last binary digit is coarser.
MONEY_NUDGE = 1.3e-6


def rounded_sql(source: str, *keep: str, digits: int = 6) -> str:
    """Select list rounding every column of `source` but the kept ones."""
    names = ", ".join(keep)
    kept = f"{names}, " if keep else ""
    rest = f"* EXCLUDE ({names})" if keep else "*"
    return f"SELECT {kept}round(COLUMNS({rest}) + {NUDGE}, {digits}) FROM {source}"


def nudged(value, digits: int = 6):
    """Round one column for output."""
    scale = F.lit(float(10 ** digits))
    nudge = NUDGE if digits > 2 else MONEY_NUDGE
    return F.rint(((F.col(value) if isinstance(value, str) else value) + F.lit(nudge)) * scale) / scale


def rounded(df: DataFrame, digits: int = 6, special: dict[str, int] | None = None) -> DataFrame:
    """Round every double once, for output; `special` columns have their own digits."""
    return df.select(*[
        nudged(c, (special or {}).get(c, digits)).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType)
        else F.col(c) for c in df.columns])


def query(name: str, sql: str | None = None):
    """Register a plan taking `Tables`, with its SQL equivalent if there is one."""
    def wrap(plan):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = lambda spark, path: plan(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return plan
    return wrap
