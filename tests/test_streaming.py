"""Streams over several files, with late and unordered rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.streaming import bars as SB
from barloom.streaming.limit_book import level_of

START = datetime(2024, 1, 1)
SCHEMA = "kind string, id long, symbol string, ts timestamp, action string, price double, high double"


def written_in_files(spark, folder, files):
    for number, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        # Files are taken in the order of their times.
        spark.sparkContext._jvm.java.lang.Thread.sleep(1100 if number + 1 < len(files) else 0)


@pytest.fixture(scope="module")
def tape(spark, tmp_path_factory):
    """Four files whose rows overlap in time by up to a day; the last one brings rows that are days too late."""
    rnd, rows = random.Random(11), []
    for i in range(600):
        symbol = "HOT" if rnd.random() < 0.6 else f"S{rnd.randrange(3)}"
        ts = START + timedelta(minutes=rnd.randrange(40) * 240)
        if rnd.random() < 0.5:
            rows.append(("order", i, symbol, ts, rnd.choice(["BUY", "SELL"]), rnd.choice([0.0, -1.0, 80.0, 95.5, 100.0, 103.0, 130.0, 400.0]), None))
        else:
            low = rnd.uniform(85, 110)
            rows.append(("bar", i, symbol, ts, None, low, low + rnd.uniform(0, 12)))
    rows.sort(key=lambda r: r[3] + timedelta(hours=rnd.randrange(20)))
    odd = [("order", 900, "HOT", START, "BUY", None, None), ("order", 901, "HOT", START, "SELL", float("nan"), None), ("order", 902, "HOT", None, "BUY", 500.0, None),
           ("bar", 903, "HOT", START, None, None, None), ("order", 904, None, START, "BUY", 100.0, None), ("bar", 905, None, START, None, 99.0, 99.5)]
    late = [("bar", 950, "HOT", START - timedelta(days=30), None, 0.0, 1e9), ("order", 951, "HOT", START - timedelta(days=30), "BUY", 1e6, None)]
    files = [rows[:200] + odd, rows[200:350], rows[350:500], rows[500:] + late]
    folder = str(tmp_path_factory.mktemp("tape"))
    written_in_files(spark, folder, files)
    return folder, rows + odd


def touches(spark, folder, place, **options):
    stream = SB.stream_table(spark, folder, "*.parquet")
    orders = stream.filter("kind = 'order'").select(F.col("id").alias("order_id"), "symbol", F.col("ts").alias("created_at"), "action", F.col("price").alias("limit_price"))
    bars = stream.filter("kind = 'bar'").select("symbol", F.col("ts").alias("timestamp"), F.col("price").alias("low"), "high")
    closing = f"{place}/end"
    found = SB.stream_limit_touch(orders, bars, closing=closing, **options)
    return SB.run_to_table(found, f"{place}/out", closing=closing, rocksdb=True)


def plain_touches(rows):
    bars, out = [r for r in rows if r[0] == "bar"], {}
    for _, i, symbol, ts, action, price, _ in (r for r in rows if r[0] == "order"):
        if ts is None or price is None or price != price:
            continue
        hits = [b[3] for b in bars if b[2] == symbol and b[3] >= ts and b[5] is not None
                and (b[5] <= price if action == "BUY" else b[6] >= price)]
        if hits:
            out[i] = min(hits)
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_each_order_is_touched_once_whatever_the_arrival_order(spark, tape, tmp_path, shards):
    folder, rows = tape
    got = touches(spark, folder, tmp_path, shards=shards).collect()
    expected = plain_touches(rows)
    assert len(got) == len({r.order_id for r in got})
    assert {r.order_id: r.filled_at for r in got} == expected and len(expected) > 100
    created = {r[1]: r[3] for r in rows}
    assert all(r.created_at == created[r.order_id] for r in got)
    # Only untouched orders are left in state.
    book = spark.read.format("statestore").option("path", f"{tmp_path}/out_state").option("stateVarName", "book").load()
    left = {i for r in book.select(F.col("user_map_value.ids").alias("ids")).collect() for i in r.ids}
    live = {r[1] for r in rows if r[0] == "order" and r[3] is not None and r[5] is not None and r[5] == r[5]}
    assert left == live - set(expected)


def test_levels_grow_with_the_price():
    prices = [-5.0, 0.0, 1e-9, 0.5, 0.504, 1.0, 99.0, 100.0, 1e9]
    assert [level_of(p) for p in prices] == sorted(level_of(p) for p in prices)


def test_a_closed_stream_leaves_no_bar_behind(spark, tape, tmp_path):
    folder, rows = tape
    ticks = SB.stream_table(spark, folder, "*.parquet").filter("kind = 'bar' AND price IS NOT NULL")
    bars = SB.stream_bars(ticks, F.col("symbol"), F.col("ts"), F.col("price"), F.col("id"), "1 day", "1 day", closing=f"{tmp_path}/end")
    got = SB.run_to_table(bars, f"{tmp_path}/out", closing=f"{tmp_path}/end").collect()
    assert len(got) == len({(r.symbol, r.timestamp) for r in got})
    by_day = {}
    for kind, i, symbol, ts, _, price, _ in rows:
        if kind == "bar" and price is not None:
            by_day.setdefault((symbol, ts.replace(hour=0, minute=0)), []).append((i, price))
    assert {(r.symbol, r.timestamp): (r.open, r.high, r.low, r.close, r.volume) for r in got} == {
        k: (min(v)[1], max(p for _, p in v), min(p for _, p in v), max(v)[1], len(v)) for k, v in by_day.items()}
