"""Seconds DuckDB needs for the SQL of given queries (results counted, not fetched)."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from barloom.plans import ORACLES  # noqa: E402
from tools.compare import TABLES  # noqa: E402

path, names = sys.argv[1], sys.argv[2:]
db = duckdb.connect()
db.execute("SET threads = 8")
for t in TABLES:
    db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
for n in names:
    best = 1e9
    for _ in range(2):
        begin = time.perf_counter()
        db.execute(f"CREATE OR REPLACE TEMP TABLE out AS {ORACLES[n]}")
        best = min(best, time.perf_counter() - begin)
    print(n, round(best, 3), flush=True)
