"""Headline plans at one scale; prints one JSON line. Results go to a no-op sink."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from barloom.session import local_session  # noqa: E402

PATH = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def plans():
    from barloom.functions.features import compute_features
    from barloom.operators import dataset, metrics, performance, quality, screener, signals
    from barloom.panel import cut
    from barloom.plans import market, modeling, trading
    from barloom.plans.ingest import findings

    def held(t):
        return signals.held_bars(scored(t), 0.8, 0.3)

    def scored(t):
        from pyspark.sql import functions as F

        f = compute_features(t.bars_s, ["range_pos_20d"], keep_bars=True)
        return f.withColumn("p", 1 - F.col("range_pos_20d")).drop("range_pos_20d")

    def perf(t):
        from pyspark.sql import functions as F

        h = cut(held(t))
        eq = signals.signal_equity(h, fraction=0.005)
        curve = performance.drawdown_curve(eq.select(
            F.col("symbol").alias("run_id"), "timestamp", (F.col("equity") * 1e5).alias("portfolio_equity"), "daily_return",
            (F.col("held") * F.col("equity")).alias("gross_exposure")), 1e5)
        return performance.perf_metrics(curve, signals.round_trips(h).withColumnRenamed("symbol", "run_id"), 1e5)

    return {
        "resample_bars": lambda t: t.bars_s,
        "feature_matrix": lambda t: compute_features(t.bars_s),
        "label_dataset": lambda t: dataset.label_dataset(t.bars_s),
        "feature_matrix_hourly": lambda t: compute_features(t.bars_e, grain="hour"),
        "barrier_exit": lambda t: signals.barrier_exits(scored(t), 0.8, 0.3, signals.Barriers(0.05, 0.10, 21)),
        "perf_metrics": perf,
        "dq_summary": lambda t: quality.summary(findings(t)),
        "screen": lambda t: screener.screen(t.bars_s),
        "roc_auc": lambda t: metrics.roc_auc(modeling.scored(t), ["fold"]),
        "limit_first_touch": lambda t: market.J.limit_first_touch(market.limit_orders(t), t.bars_n),
        "risk_decisions": lambda t: trading.K.evaluate_orders(trading.orders(t), trading.LIMITS),
    }


def main():
    spark = local_session(CPUS, **{
        "spark.sql.shuffle.partitions": str(2 * int(CPUS)) if CPUS.isdigit() else "16", "spark.driver.memory": "12g",
        "spark.log.level": "ERROR"})
    from barloom.plans.core import Tables

    spent = {}
    for name, plan in plans().items():
        runs = []
        for _ in range(2):
            begin = time.perf_counter()
            plan(Tables(spark, PATH)).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        spent[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": PATH.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
