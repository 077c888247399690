"""Queries over modelling tables, splits, folds and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import features as FT
from barloom.functions import targets as TG
from barloom.operators import dataset as D
from barloom.operators import metrics as M
from barloom.operators import splits as S
from barloom.operators.order_stats import exact_quantiles
from barloom.panel import DAILY
from barloom.plans.core import SQL_PARTS, nudged, query, rounded, rounded_sql

_K = ("timestamp", "symbol")
FEATS = ["return_1d", "return_5d", "range_pos_20d", "vol_std_20d"]
ALL_FEATS = [f.name for f in FT.REGISTRY.select()]
Y, R = "target_binary_up_5d", "target_fwd_ret_5d"

for _x, _bars in (("s", "bars_s"), ("n", "bars_n")):
    SQL_PARTS[f"labelled_{_x}"] = (
        f"{{{_bars}}}, {{feats_{_x}}}, {{targets_{_x}}}, labelled AS (SELECT * FROM {_bars} "
        "JOIN feats USING (timestamp, symbol) JOIN labels_t USING (timestamp, symbol))")

_ALL = ALL_FEATS + [x.name for x in TG.REGISTRY.select()]
query("label_dataset", "WITH {labelled_s}, p AS (SELECT timestamp, symbol, open, high, low, close, volume, "
      + ", ".join(_ALL) + " FROM labelled) " + rounded_sql("p", *_K))(
    lambda t: rounded(t.over_bars_s(D.label_dataset)))
query("label_dataset_drop", "WITH {labelled_n}, p AS (SELECT timestamp, symbol, close, return_5d, target_fwd_ret_5d "
      "FROM labelled WHERE target_fwd_ret_5d IS NOT NULL) " + rounded_sql("p", *_K))(
    lambda t: rounded(D.label_dataset(t.bars_n, ["return_5d"], [R], drop=True)
                      .select("timestamp", "symbol", "close", "return_5d", R)))
query("join_features", "WITH {bars_n}, {feats_n}, p AS (SELECT timestamp, symbol, close, volume, return_1d, sma_ratio_10_50 "
      "FROM bars_n JOIN feats USING (timestamp, symbol)) " + rounded_sql("p", *_K))(
    lambda t: rounded(D.join_features(t.bars_n, FT.compute_features(t.bars_n, ["return_1d", "sma_ratio_10_50"]))
                      .select("timestamp", "symbol", "close", "volume", "return_1d", "sma_ratio_10_50")))


def labelled(t):
    return D.label_dataset(t.bars_n, FEATS, [Y, R])


def labelled_all(t):
    """All features with both labels, for the models."""
    return D.label_dataset(t.bars_n, ALL_FEATS, [Y, R])


def dataset(t):
    return D.ModelingDataset.infer(labelled(t))


_PRESENT = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)
query("get_x", f"WITH {{labelled_n}}, p AS (SELECT timestamp, symbol, {', '.join(FEATS)} FROM labelled WHERE {_PRESENT}) "
      + rounded_sql("p", *_K))(lambda t: rounded(dataset(t).x()))
query("get_y", f"WITH {{labelled_n}}, p AS (SELECT timestamp, symbol, {R} FROM labelled WHERE {R} IS NOT NULL) "
      + rounded_sql("p", *_K))(lambda t: rounded(dataset(t).y(R)))
query("modeling_rows", f"WITH {{labelled_n}}, p AS (SELECT timestamp, symbol, {', '.join(FEATS)}, {Y} FROM labelled "
      f"WHERE {_PRESENT} AND {Y} IS NOT NULL) " + rounded_sql("p", *_K))(
    lambda t: rounded(dataset(t).modeling_rows(Y)))
query("valid_row_indices", f"""WITH {{labelled_n}}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1
  AS row_position FROM labelled) SELECT timestamp, symbol, row_position FROM p WHERE {_PRESENT} AND {Y} IS NOT NULL""")(
    lambda t: dataset(t).valid_rows(Y))
query("role_split", "WITH {bars_n} SELECT c AS column_name, r AS role, count(*) AS rows FROM bars_n, (VALUES "
      + ", ".join(f"('{c}', 'feature')" for c in FEATS) + f", ('{R}', 'target'), ('{Y}', 'target')) v(c, r) GROUP BY 1, 2")(
    lambda t: _roles(t))


def _roles(t):
    ds = dataset(t)
    roles = F.create_map(*[F.lit(x) for c in ds.features for x in (c, "feature")],
                         *[F.lit(x) for c in ds.targets for x in (c, "target")])
    return ds.df.select(F.explode(roles).alias("column_name", "role")).groupBy("column_name", "role").agg(
        F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- splits

_SPLIT_SQL = """b AS (SELECT timestamp, symbol, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars_n),
c AS (SELECT *, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS z FROM b),
split AS (SELECT timestamp, symbol, CASE WHEN i < greatest(1, a - 5) THEN 'train' WHEN i >= z THEN 'test'
  WHEN i >= a AND i < (CASE WHEN z - a > 5 THEN z - 5 ELSE z END) THEN 'validation' ELSE 'purged' END AS fold FROM c)"""
SQL_PARTS["split"] = _SPLIT_SQL
query("split_by_ratio", "WITH {bars_n}, {split} SELECT timestamp, symbol, fold FROM split")(
    lambda t: S.split_by_ratio(t.bars_n.select("timestamp", "symbol"), gap=5))
query("split_by_ratio_hourly", "WITH {bars_e}, {split} SELECT timestamp, symbol, fold FROM split".replace(
    "{split}", _SPLIT_SQL.replace("bars_n", "bars_e")))(
    lambda t: S.split_by_ratio(t.bars_e.select("timestamp", "symbol"), gap=5, grain="hour"))
query("split_summary", """WITH {bars_n}, {split} SELECT symbol, fold, count(*) AS rows, min(timestamp) AS start,
  max(timestamp) AS "end" FROM split GROUP BY 1, 2""")(
    lambda t: S.split_summary(S.split_by_ratio(t.bars_n.select("timestamp", "symbol"), gap=5), "symbol"))
_BY_DATE = """f AS (SELECT timestamp, symbol, CASE WHEN timestamp < TIMESTAMP '{0}' THEN 'unused'
  WHEN timestamp <= TIMESTAMP '{1}' THEN 'train' WHEN timestamp <= TIMESTAMP '{2}' THEN 'validation'
  ELSE 'test' END AS fold FROM bars_n),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY timestamp DESC) AS k,
  count(*) OVER (PARTITION BY symbol, fold) AS c FROM f)
SELECT timestamp, symbol, CASE WHEN fold IN ('train', 'validation') AND c > 5 AND k <= 5 THEN 'purged' ELSE fold END AS fold FROM r"""
query("split_by_date", "WITH {bars_n}, " + _BY_DATE.format("1995-07-01", "1998-12-31", "1999-12-31"))(
    lambda t: S.split_by_date(t.bars_n.select("timestamp", "symbol"), "1998-12-31", "1999-12-31",
                              "1995-07-01", gap=5))
query("split_by_date_hourly", "WITH {bars_e}, " + _BY_DATE.format("2024-01-03", "2024-01-20", "2024-01-25").replace("bars_n", "bars_e"))(
    lambda t: S.split_by_date(t.bars_e.select("timestamp", "symbol"), "2024-01-20", "2024-01-25", "2024-01-03", gap=5, grain="hour"))
query("panel_split", """WITH {bars_n}, d AS (SELECT DISTINCT timestamp FROM bars_n),
i AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, (SELECT count(*) FROM d) AS n FROM d),
c AS (SELECT *, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS z FROM i)
SELECT timestamp, symbol, CASE WHEN i < greatest(1, a - 5) THEN 'train' WHEN i >= z THEN 'test'
  WHEN i >= a AND i < (CASE WHEN z - a > 5 THEN z - 5 ELSE z END) THEN 'validation' ELSE 'purged' END AS fold
FROM bars_n JOIN c USING (timestamp)""")(
    lambda t: S.panel_split(t.bars_n.select("timestamp", "symbol"), gap=5))



def _panel_fold(name, features):
    """Complete rows of `labelled` with their fold on the common calendar of these rows."""
    present = " AND ".join(f"{c} IS NOT NULL" for c in [*features, Y])
    return f"""{name}_r AS (SELECT timestamp, symbol, {Y} AS y FROM labelled WHERE {present}),
{name}_d AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT timestamp FROM {name}_r)),
{name}_c AS (SELECT *, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS z FROM {name}_d),
{name} AS (SELECT r.*, CASE WHEN i < greatest(1, a - 5) THEN 'train' WHEN i >= z THEN 'test'
  WHEN i >= a AND i < (CASE WHEN z - a > 5 THEN z - 5 ELSE z END) THEN 'validation' ELSE 'purged' END AS fold
  FROM {name}_r r JOIN {name}_c USING (timestamp))"""


SQL_PARTS["pfold"] = _panel_fold("pfold", FEATS)
SQL_PARTS["pfold_all"] = _panel_fold("pfold_all", ALL_FEATS)

WF = S.WalkForward(n_folds=3, min_train=120, gap=5)
SQL_PARTS["wf"] = """tot AS (SELECT symbol, count(*) AS n FROM bars_n GROUP BY 1),
sized AS (SELECT *, greatest(10, (n - 125) // 3) AS s FROM tot WHERE n >= 135),
wf AS (SELECT symbol, k AS fold_idx, 0 AS train_start, n - (2 - k) * s - s - 5 AS train_end,
  n - (2 - k) * s - s AS test_start, n - (2 - k) * s AS test_end FROM sized, (VALUES (0), (1), (2)) v(k)
  WHERE n - (2 - k) * s - s >= 125 AND n - (2 - k) * s - s - 5 >= 120)"""
_LONG = "CAST({0} AS BIGINT) AS {0}"
query("wf_windows", "WITH {bars_n}, {wf} SELECT symbol, " + ", ".join(
    _LONG.format(c) for c in ("fold_idx", "train_start", "train_end", "test_start", "test_end")) + " FROM wf")(
    lambda t: S.wf_windows(t.bars_n, WF).withColumn("fold_idx", F.col("fold_idx").cast("bigint")))
query("wf_windows_rolling", """WITH {bars_n}, tot AS (SELECT symbol, count(*) AS n FROM bars_n GROUP BY 1),
  w AS (SELECT symbol, k AS fold_idx, n - (3 - k) * 40 - 40 AS ts, n FROM tot, (VALUES (0), (1), (2), (3)) v(k) WHERE n >= 115)
  SELECT symbol, CAST(fold_idx AS BIGINT) AS fold_idx, CAST(greatest(0, ts - 5 - 100) AS BIGINT) AS train_start,
  CAST(ts - 5 AS BIGINT) AS train_end, CAST(ts AS BIGINT) AS test_start, CAST(ts + 40 AS BIGINT) AS test_end
  FROM w WHERE ts >= 105""")(
    lambda t: S.wf_windows(t.bars_n, S.WalkForward(4, 100, 5, test_size=40, expanding=False))
    .withColumn("fold_idx", F.col("fold_idx").cast("bigint")))
SQL_PARTS["folded"] = """placed AS (SELECT timestamp, symbol, fold_idx, CASE WHEN i >= train_start AND i < train_end THEN 'train'
  WHEN i >= test_start AND i < test_end THEN 'test' END AS part
  FROM (SELECT timestamp, symbol, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM bars_n)
  JOIN wf USING (symbol))"""
query("fold_rows", "WITH {bars_n}, {wf}, {folded} SELECT timestamp, symbol, CAST(fold_idx AS BIGINT) AS fold_idx, part "
      "FROM placed WHERE part IS NOT NULL")(
    lambda t: S.fold_rows(t.bars_n.select("timestamp", "symbol"), WF)
    .withColumn("fold_idx", F.col("fold_idx").cast("bigint")))

# Features with holes: values above a level are treated as missing.
_HOLED = ["return_5d", "vol_std_20d"]
SQL_PARTS["holed"] = """holed AS (SELECT p.timestamp, p.symbol, fold_idx, part,
  CASE WHEN abs(return_5d) < 1 THEN return_5d END AS return_5d, CASE WHEN vol_std_20d < 1 THEN vol_std_20d END AS vol_std_20d
  FROM placed p JOIN feats USING (timestamp, symbol) WHERE part IS NOT NULL),
medians AS (SELECT symbol, fold_idx, median(return_5d) AS m1, median(vol_std_20d) AS m2 FROM holed WHERE part = 'train' GROUP BY 1, 2)"""


def holed(t, bars="bars_n", grain=DAILY):
    feats = FT.compute_features(getattr(t, bars), _HOLED, grain=grain)
    feats = feats.select("timestamp", "symbol",
                         F.when(F.abs("return_5d") < 1, F.col("return_5d")).alias("return_5d"),
                         F.when(F.col("vol_std_20d") < 1, F.col("vol_std_20d")).alias("vol_std_20d"))
    return S.fold_rows(feats, WF, grain).withColumn("fold_idx", F.col("fold_idx").cast("bigint"))


_WF_WITH = "WITH {bars_n}, {feats_n}, {wf}, {folded}, {holed} "
query("fold_medians", _WF_WITH + "SELECT symbol, CAST(fold_idx AS BIGINT) AS fold_idx, round(m1 + 1.3e-9, 6) AS return_5d_median, "
      "round(m2 + 1.3e-9, 6) AS vol_std_20d_median FROM medians")(
    lambda t: rounded(S.fold_medians(holed(t), _HOLED)))
_IMPUTED = """SELECT timestamp, symbol, CAST(fold_idx AS BIGINT) AS fold_idx, part,
  round(coalesce(last_value(return_5d IGNORE NULLS) OVER w, m1, 0) + 1.3e-9, 6) AS return_5d,
  round(coalesce(last_value(vol_std_20d IGNORE NULLS) OVER w, m2, 0) + 1.3e-9, 6) AS vol_std_20d
  FROM (SELECT * FROM holed WHERE part = 'test') LEFT JOIN medians USING (symbol, fold_idx)
  WINDOW w AS (PARTITION BY symbol, fold_idx ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"""
query("wf_impute", _WF_WITH + _IMPUTED)(lambda t: rounded(S.wf_impute(holed(t), _HOLED)))
# The same on hourly series, whose groups have no bound: radix selection, two-level fills and positions.
_WF_HOURLY = "WITH {bars_e}, {feats_e}, " + ", ".join(
    SQL_PARTS[part].replace("bars_n", "bars_e") for part in ("wf", "folded", "holed")) + " "
query("fold_medians_hourly", _WF_HOURLY + "SELECT symbol, CAST(fold_idx AS BIGINT) AS fold_idx, round(m1 + 1.3e-9, 6) AS return_5d_median, "
      "round(m2 + 1.3e-9, 6) AS vol_std_20d_median FROM medians")(
    lambda t: rounded(S.fold_medians(holed(t, "bars_e", "hour"), _HOLED, "hour")))
query("wf_impute_hourly", _WF_HOURLY + _IMPUTED)(
    lambda t: rounded(S.wf_impute(holed(t, "bars_e", "hour"), _HOLED, "hour")))
query("tick_quantiles", """SELECT event_type, unnest(['value', 'user_id']) AS name, round(unnest([q1, q2]) + 1.3e-9, 6) AS q05,
  round(unnest([m1, m2]) + 1.3e-9, 6) AS q50, round(unnest([h1, h2]) + 1.3e-9, 6) AS q95 FROM (SELECT event_type,
  quantile_cont(value, 0.05) AS q1, median(value) AS m1, quantile_cont(value, 0.95) AS h1, quantile_cont(user_id::DOUBLE, 0.05) AS q2,
  median(user_id::DOUBLE) AS m2, quantile_cont(user_id::DOUBLE, 0.95) AS h2 FROM events GROUP BY 1)""")(lambda t: _tick_quantiles(t))


def _tick_quantiles(t):
    long = exact_quantiles(t.events, ["event_type"], ["value", "user_id"], [0.05, 0.5, 0.95])
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    return rounded(long.groupBy("event_type", "name").agg(at(0.05).alias("q05"), at(0.5).alias("q50"), at(0.95).alias("q95")))


query("train_dropna", _WF_WITH + """SELECT timestamp, symbol, CAST(fold_idx AS BIGINT) AS fold_idx FROM holed
  WHERE part = 'train' AND return_5d IS NOT NULL AND vol_std_20d IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY symbol, fold_idx) >= 10""")(
    lambda t: S.train_rows(holed(t), _HOLED).select("timestamp", "symbol", "fold_idx"))

# ---------------------------------------------------------------- baselines, scaling, metrics

SQL_PARTS["scored"] = f"""{{labelled_n}}, {{split}}, scored AS (SELECT timestamp, symbol, fold, {Y} AS y, range_pos_20d AS p,
  CASE WHEN range_pos_20d >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y_hat, {R} AS r, return_5d AS r_hat
  FROM labelled JOIN split USING (timestamp, symbol)
  WHERE {Y} IS NOT NULL AND range_pos_20d IS NOT NULL AND return_5d IS NOT NULL)"""


def scored(t):
    """Stored predictions: position in the range as probability, past return as forecast."""
    rows = labelled(t).select("timestamp", "symbol", F.col(Y).alias("y"), F.col("range_pos_20d").alias("p"),
                              F.col(R).alias("r"), F.col("return_5d").alias("r_hat"))
    folded = S.split_by_ratio(rows, gap=5)
    return folded.dropna(subset=["y", "p", "r_hat"]).withColumn(
        "y_hat", (F.col("p") >= 0.5).cast("double"))


_SC = "WITH {scored} "
query("predictions", _SC + rounded_sql("scored", "timestamp", "symbol", "fold"))(lambda t: rounded(scored(t)))
query("class_prior", _SC + """SELECT symbol, round(avg(y) + 1.3e-9, 6) AS prior, CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END AS majority
  FROM scored WHERE fold = 'train' GROUP BY symbol""")(
    lambda t: rounded(M.class_prior(scored(t).filter("fold = 'train'"), ["symbol"])))
query("target_mean_median", _SC + """SELECT symbol, round(avg(r) + 1.3e-9, 6) AS mean, round(median(r) + 1.3e-9, 6) AS median
  FROM scored WHERE fold = 'train' GROUP BY symbol""")(
    lambda t: rounded(M.mean_median(scored(t).filter("fold = 'train'"), ["symbol"], "r")))
query("baseline_clf", _SC + """SELECT timestamp, s.symbol, y, CASE WHEN prior >= 0.5 THEN 1 ELSE 0 END AS y_hat,
  round(prior + 1.3e-9, 6) AS p FROM scored s JOIN (SELECT symbol, avg(y) AS prior FROM scored WHERE fold = 'train' GROUP BY 1) b
  ON s.symbol = b.symbol WHERE fold = 'test'""")(lambda t: _baseline_clf(t))
query("baseline_reg", _SC + """SELECT timestamp, s.symbol, round(r + 1.3e-9, 6) AS y, round(m + 1.3e-9, 6) AS y_mean,
  round(d + 1.3e-9, 6) AS y_median, 0.0::DOUBLE AS y_zero FROM scored s JOIN (SELECT symbol, avg(r) AS m, median(r) AS d
  FROM scored WHERE fold = 'train' GROUP BY 1) b ON s.symbol = b.symbol WHERE fold = 'test'""")(lambda t: _baseline_reg(t))


def _baseline_clf(t):
    rows = scored(t)
    prior = M.class_prior(rows.filter("fold = 'train'"), ["symbol"])
    return rows.filter("fold = 'test'").join(prior, "symbol").select(
        "timestamp", "symbol", "y", F.col("majority").alias("y_hat"), nudged("prior").alias("p"))


def _baseline_reg(t):
    rows = scored(t)
    levels = M.mean_median(rows.filter("fold = 'train'"), ["symbol"], "r")
    return rounded(rows.filter("fold = 'test'").join(levels, "symbol").select(
        "timestamp", "symbol", F.col("r").alias("y"), F.col("mean").alias("y_mean"),
        F.col("median").alias("y_median"), F.lit(0.0).alias("y_zero")))


query("scale_features", _SC + """, st AS (SELECT symbol, avg(p) AS m, stddev_pop(p) AS s, avg(r_hat) AS m2, stddev_pop(r_hat) AS s2
  FROM scored WHERE fold = 'train' GROUP BY 1) SELECT timestamp, symbol, round((p - m) / CASE WHEN s > 0 THEN s ELSE 1 END + 1.3e-9, 6) AS p,
  round((r_hat - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END + 1.3e-9, 6) AS r_hat FROM scored JOIN st USING (symbol)""")(
    lambda t: _scaled(t))


def _scaled(t):
    from barloom.operators.ml import standardize

    rows = scored(t)
    return rounded(standardize(rows, ["p", "r_hat"], F.col("fold") == "train", ["symbol"]).select(
        "timestamp", "symbol", "p", "r_hat"))


SQL_PARTS["clf"] = """clf AS (SELECT fold, symbol, count(*) AS rows, avg(CASE WHEN y = y_hat THEN 1.0 ELSE 0 END) AS accuracy,
  coalesce(sum(y * y_hat) / nullif(sum(y_hat), 0), 0) AS precision, coalesce(sum(y * y_hat) / nullif(sum(y), 0), 0) AS recall,
  coalesce(2 * sum(y * y_hat) / nullif(sum(y) + sum(y_hat), 0), 0) AS f1, avg((p - y) ** 2) AS brier_score,
  avg(-CASE WHEN y = 1 THEN ln(greatest(1e-15, least(p, 1 - 1e-15))) ELSE ln(1 - greatest(1e-15, least(p, 1 - 1e-15))) END) AS log_loss
  FROM scored GROUP BY GROUPING SETS ((fold, symbol), (fold)))"""
SQL_PARTS["auc"] = """ranked AS (SELECT fold, symbol, y, rank() OVER (PARTITION BY fold, symbol ORDER BY p)
  + (count(*) OVER (PARTITION BY fold, symbol, p) - 1) / 2.0 AS k FROM scored),
auc AS (SELECT fold, symbol, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS roc_auc
  FROM ranked GROUP BY 1, 2)"""
query("clf_metrics", _SC + ", {clf} SELECT fold, symbol, rows, " + ", ".join(
    f"round({c} + 1.3e-9, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "brier_score", "log_loss"))
    + " FROM clf WHERE symbol IS NOT NULL")(
    lambda t: rounded(M.classification(scored(t), ["fold", "symbol"])))
query("clf_metrics_overall", _SC + ", {clf} SELECT fold, rows, " + ", ".join(
    f"round({c} + 1.3e-9, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "brier_score", "log_loss"))
    + " FROM clf WHERE symbol IS NULL")(lambda t: rounded(M.classification(scored(t), ["fold"])))
query("brier", _SC + "SELECT fold, round(avg((p - y) ** 2) + 1.3e-9, 6) AS brier_score FROM scored GROUP BY fold")(
    lambda t: rounded(M.classification(scored(t), ["fold"]).select("fold", "brier_score")))
query("log_loss", _SC + ", {clf} SELECT fold, round(log_loss + 1.3e-9, 6) AS log_loss FROM clf WHERE symbol IS NULL")(
    lambda t: rounded(M.classification(scored(t), ["fold"]).select("fold", "log_loss")))
query("roc_auc", _SC + ", {auc} SELECT fold, symbol, round(roc_auc + 1.3e-9, 6) AS roc_auc FROM auc")(
    lambda t: rounded(M.roc_auc(scored(t), ["fold", "symbol"])))
query("roc_auc_overall", _SC + ", {auc} SELECT round(roc_auc + 1.3e-9, 6) AS roc_auc FROM auc".replace(
    "fold, symbol", "1") .replace("{auc}", SQL_PARTS["auc"].replace("SELECT fold, symbol, y", "SELECT y").replace(
        "PARTITION BY fold, symbol ORDER", "ORDER").replace("PARTITION BY fold, symbol, p", "PARTITION BY p").replace(
        "SELECT fold, symbol, (sum", "SELECT (sum").replace(" GROUP BY 1, 2", "")))(
    lambda t: rounded(M.roc_auc(scored(t), [])))
_REG = """SELECT fold, count(*) AS rows, round(avg(abs(r - r_hat)) + 1.3e-9, 6) AS mae, round(sqrt(avg((r - r_hat) ** 2)) + 1.3e-9, 6) AS rmse,
  round(1 - sum((r - r_hat) ** 2) / nullif(var_pop(r) * count(*), 0) + 1.3e-9, 6) AS r2,
  round(avg(CASE WHEN sign(r) = sign(r_hat) THEN 1.0 ELSE 0 END) + 1.3e-9, 6) AS directional_accuracy,
  round(corr(r, r_hat) + 1.3e-9, 6) AS pearson_corr FROM scored GROUP BY fold"""
query("reg_metrics", _SC + _REG)(lambda t: rounded(M.regression(scored(t), ["fold"], "r", "r_hat")))
query("metrics_dispatch", _SC + ", {clf}, {auc}, both_m AS (SELECT * FROM clf JOIN auc USING (fold, symbol)) " + " UNION ALL ".join(
    f"SELECT fold, symbol, '{c}' AS metric, round({c} + 1.3e-9, 6) AS value FROM both_m"
    for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "brier_score", "log_loss")))(
    lambda t: rounded(M.evaluate(scored(t), "classification", ["fold", "symbol"])))
