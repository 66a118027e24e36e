"""Queries on backtests, calibration, drift, metrics, splits and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import drift, evaluate, signals, splits
from ..sources.shared import written
from .fixtures import BARS, DRIFT, PREDS, SCORED, Inputs
from .registry import query

PR = f"{BARS},{PREDS}"
P = "PARTITION BY symbol ORDER BY ts"
BT1 = f"""{PR},
bt AS (SELECT symbol, "interval", ts, r, CASE WHEN p_hat > last_price THEN 1.0 ELSE -1.0 END::DOUBLE AS direction, 0.0::DOUBLE AS ev FROM (SELECT *, (target - last_price) / last_price AS r FROM preds)),
tr AS (SELECT *, direction * r - 0.0005 * abs(direction) AS trade_return FROM bt)"""
BT2 = f"""{PR},
pr AS (SELECT *, (target - last_price) / last_price AS r, least(greatest(coalesce(lag(prob) OVER ({P}), 0), 0), 1) AS q FROM preds),
bt AS (SELECT *, q * greatest(r, 0) - (1 - q) * greatest(-r, 0) - 0.0007::DOUBLE AS ev FROM pr),
tr AS (SELECT *, CASE WHEN ev > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS direction, (CASE WHEN ev > 0 THEN 1 ELSE 0 END) * r - 0.0007::DOUBLE * (CASE WHEN ev > 0 THEN 1 ELSE 0 END) AS trade_return FROM bt)"""
EQ = f"SELECT symbol, ts, direction, ev, trade_return, exp(sum(ln(1 + trade_return)) OVER ({P})) AS equity FROM tr"
METRICS = f"""SELECT symbol, "interval", exp(sum(ln(1 + trade_return))) - 1 AS pnl, avg(trade_return) / (stddev_pop(trade_return) + 1e-9) * sqrt(count(*)) AS sharpe, count(*) FILTER (abs(direction) > 0) AS trades,
 avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (abs(direction) > 0) AS hit_rate, avg(ev) FILTER (abs(direction) > 0) AS avg_ev FROM tr GROUP BY ALL"""


def direction(s: Inputs) -> DataFrame:
    return evaluate.backtest(s.preds(), fee=0.0005)


def expected(s: Inputs) -> DataFrame:
    return evaluate.backtest(s.preds(), "prob", fee=0.0005, slippage_bps=2.0, latency=1)


COLS = ["symbol", "ts", "direction", "ev", "trade_return", "equity"]
query("agg1_win27_backtest_direction", EQ, "direction ev trade_return equity", ctes=BT1)(lambda s: direction(s).select(*COLS))
query("agg2_backtest_expected_value", EQ, "direction ev trade_return equity", ctes=BT2)(lambda s: expected(s).select(*COLS))
query("agg3_backtest_metrics", METRICS, "pnl sharpe hit_rate avg_ev", "trades", BT2)(lambda s: evaluate.backtest_metrics(expected(s)))
query("agg3_direction_metrics", METRICS, "pnl sharpe hit_rate avg_ev", "trades", BT1)(lambda s: evaluate.backtest_metrics(direction(s)))
CL = "least(greatest(y_prob, 1e-6), 1 - 1e-6)"
query("agg4_reliability", f"""SELECT b.bin, coalesce(count, 0) AS count, avg_pred, avg_true FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (
 SELECT len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: {CL} > e)) AS bin, count(*) AS count, avg({CL}) AS avg_pred, avg(CAST(y_true AS DOUBLE)) AS avg_true FROM scored GROUP BY 1) g ON b.bin = g.bin""", "avg_pred avg_true", "bin count", SCORED)(lambda s: evaluate.reliability(s.scored()))
query("agg5_probability_scores", f"SELECT avg(({CL} - y_true) ** 2) AS brier, avg(-(y_true * ln({CL}) + (1 - y_true) * ln(1 - {CL}))) AS log_loss FROM scored", "brier log_loss", ctes=SCORED)(lambda s: s.scored().agg(*[c.alias(n) for n, c in evaluate.probability_scores(F.col("y_true"), F.col("y_prob")).items()]))
query("agg6_hit_rates", "SELECT avg(y_prob) AS expected, avg(CAST(y_true AS DOUBLE)) AS actual FROM scored", "expected actual", ctes=SCORED)(lambda s: s.scored().agg(*[c.alias(n) for n, c in evaluate.hit_rates(F.col("y_true"), F.col("y_prob")).items()]))
query("agg7_by_regime", f"SELECT regime, avg(({CL} - y_true) ** 2) AS brier, avg(CASE WHEN (y_prob >= 0.5) = (y_true = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS count FROM scored GROUP BY regime", "brier accuracy", "count", SCORED)(lambda s: evaluate.by_regime(s.scored(), {"brier": evaluate.probability_scores(F.col("y_true"), F.col("y_prob"))["brier"], "accuracy": F.avg(((F.col("y_prob") >= 0.5) == (F.col("y_true") == 1)).cast("double"))}))
CONF = "q AS (SELECT list_sort(list(abs(y_true - {p}))) AS r FROM scored WHERE doc_id % 2 = 0), v AS (SELECT r[CAST(ceil((len(r) - 1) * (1 - 0.1 * (1 + 1.0::DOUBLE / len(r))) - 1e-12) AS INT) + 1] AS q FROM q)"
query("agg8_conformal", "SELECT doc_id, y_prob - q AS lower, y_prob + q AS upper FROM scored, v WHERE doc_id % 2 = 1", "lower upper", ctes=f"{SCORED},\n{CONF.format(p='y_prob')}")(lambda s: evaluate.conformal(s.scored().where("doc_id % 2 = 0"), s.scored().where("doc_id % 2 = 1"), "y_true", "y_prob", "y_prob").select("doc_id", "lower", "upper"))
query("agg9_conformal_touch", f"SELECT doc_id, greatest({CL} - q, 0) AS lower, least({CL} + q, 1) AS upper FROM scored, v WHERE doc_id % 2 = 1", "lower upper", ctes=f"{SCORED},\n{CONF.format(p=CL)}")(lambda s: evaluate.conformal(s.scored().where("doc_id % 2 = 0"), s.scored().where("doc_id % 2 = 1"), "y_true", "y_prob", "y_prob", touch=True).select("doc_id", "lower", "upper"))
FEATURES = ["quantity", "price", "discount", "tax"]
LONG = f"{DRIFT},\nlong AS (UNPIVOT drift ON quantity, price, discount, tax INTO NAME feature VALUE value)"
PSI = f"""{LONG},
cuts AS (SELECT feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM long WHERE NOT is_current GROUP BY feature),
cell AS (SELECT feature, len(list_filter(cuts, lambda e: e <= value)) AS b, count(*) FILTER (NOT is_current) AS x, count(*) FILTER (is_current) AS y FROM long JOIN cuts USING (feature) GROUP BY ALL),
psi AS (SELECT feature, sum(CASE WHEN x > 0 AND y > 0 THEN (y / ny - x / nx) * ln((y / ny) / (x / nx)) ELSE 0 END) AS psi FROM (SELECT *, sum(x) OVER (PARTITION BY feature)::DOUBLE AS nx, sum(y) OVER (PARTITION BY feature)::DOUBLE AS ny FROM cell) GROUP BY feature),
val AS (SELECT feature, value, count(*) FILTER (NOT is_current) AS x, count(*) FILTER (is_current) AS y FROM long GROUP BY ALL),
ks AS (SELECT feature, max(abs(cx / nx - cy / ny)) AS ks FROM (SELECT feature, sum(x) OVER (PARTITION BY feature ORDER BY value)::DOUBLE AS cx, sum(y) OVER (PARTITION BY feature ORDER BY value)::DOUBLE AS cy, sum(x) OVER (PARTITION BY feature)::DOUBLE AS nx, sum(y) OVER (PARTITION BY feature)::DOUBLE AS ny FROM val) GROUP BY feature)"""
query("agg10_psi", "SELECT feature, psi FROM psi", "psi", ctes=PSI)(lambda s: drift.psi(drift.unpivoted(s.drift(), FEATURES)))
query("agg11_ks", "SELECT feature, ks FROM ks", "ks", ctes=PSI)(lambda s: drift.ks(drift.unpivoted(s.drift(), FEATURES)))
query("agg12_drift_table", "SELECT feature, psi, ks, psi > 0.2 AS psi_alert, ks > 0.1 AS ks_alert FROM psi JOIN ks USING (feature)", "psi ks", ctes=PSI)(lambda s: drift.drift_table(s.drift(), FEATURES))
SPANS = {"year": (1995, 1996), "next": (1996, 1997)}
LINES = "l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax"
SPAN_LONG = "drift AS (" + " UNION ALL ".join(f"SELECT '{n}' AS span, {LINES}, year(l_shipdate) = {b} AS is_current FROM lineitem WHERE year(l_shipdate) IN ({a}, {b})" for n, (a, b) in SPANS.items()) + "),\nwide AS (UNPIVOT drift ON quantity, price, discount, tax INTO NAME f VALUE value),\nlong AS (SELECT span || ':' || f AS feature, value, is_current FROM wide)"


@query("agg12_drift_spans", "SELECT feature, psi, ks, psi > 0.2 AS psi_alert, ks > 0.1 AS ks_alert FROM psi JOIN ks USING (feature)", "psi ks", ctes=PSI.replace(LONG, SPAN_LONG))
def spans(s: Inputs) -> DataFrame:
    """Two pairs of years from one table of daily counts."""
    days = s.table("lineitem").select(*[F.col(c).alias(n) for c, n in (("l_quantity", "quantity"), ("l_extendedprice", "price"), ("l_discount", "discount"), ("l_tax", "tax"))], F.to_date("l_shipdate").alias("day"))
    counts, out = written(drift.daily_counts(days, FEATURES, F.col("day")), "days"), None
    for name, (a, b) in SPANS.items():
        one = drift.measured(drift.between(counts, F.year("day") == a, F.year("day") == b)).withColumn("feature", F.concat(F.lit(f"{name}:"), "feature"))
        out = one if out is None else out.unionByName(one)
    return out


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
query("agg13_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM drift" for a, b in PAIRS), "corr", ctes=DRIFT)(lambda s: drift.correlations(s.drift(), FEATURES))
# A chain: the second goes with the first and with the third, which stays as the second has gone.
CHAIN = {"quantity": "quantity", "both": "quantity + price / 2000", "price": "price", "discount": "discount", "falling": "1 - discount + tax / 100", "tax": "tax"}
query("agg13_drop_correlated", f"""SELECT feature FROM (SELECT abs(corr(quantity, both_)) AS qb, abs(corr(quantity, price)) AS qp, abs(corr(both_, price)) AS bp, abs(corr(discount, falling)) AS df FROM (SELECT *, {CHAIN['both']} AS both_, {CHAIN['falling']} AS falling FROM drift)),
 (SELECT unnest(['quantity', 'both', 'price', 'discount', 'falling', 'tax']) AS feature) WHERE feature NOT IN ('both', 'price', 'falling') OR feature = 'both' AND qb <= 0.68 OR feature = 'price' AND qp <= 0.68 AND (qb > 0.68 OR bp <= 0.68) OR feature = 'falling' AND df <= 0.68""", ctes=DRIFT)(
    lambda s: s.spark.createDataFrame([(f,) for f in drift.drop_correlated(s.drift().select(*[F.expr(e).alias(n) for n, e in CHAIN.items()]), list(CHAIN), 0.68)], "feature string"))
CONFUSION = """c AS (SELECT count(*) FILTER (y_true = 1 AND p = 1) AS tp, count(*) FILTER (y_true = 0 AND p = 1) AS fp, count(*) FILTER (y_true = 1 AND p = 0) AS fn, count(*) FILTER (y_true = 0 AND p = 0) AS tn FROM (SELECT *, CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS p FROM scored)),
f AS (SELECT *, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, 2.0::DOUBLE * tn / (2 * tn + fp + fn) AS f0, (tp + fp + fn + tn)::DOUBLE AS n FROM c)"""
query("agg14_classification", "SELECT tp, fp, fn, tn, (tp + tn) / n AS accuracy, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, f1, (f1 * (tp + fn) + f0 * (tn + fp)) / n AS f1_weighted FROM f", "accuracy precision recall f1 f1_weighted", "tp fp fn tn", f"{SCORED},\n{CONFUSION}")(lambda s: evaluate.classification(s.scored().withColumn("p", F.when(F.col("y_prob") >= 0.5, 1).otherwise(0)), "y_true", "p"))
query("agg14_roc_auc", "SELECT sum(CASE WHEN a.y_prob > b.y_prob THEN 1.0 WHEN a.y_prob = b.y_prob THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS roc_auc FROM scored a JOIN scored b ON a.y_true = 1 AND b.y_true = 0", "roc_auc", ctes=SCORED)(lambda s: evaluate.auc(s.scored(), "y_true", "y_prob"))
query("agg15_regression", f"""SELECT symbol, "interval", sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(target) * count(*)) AS r2, avg(abs(e) / greatest(abs(target), 1e-8)) AS mape, avg(CASE WHEN sign(dt) = sign(dp) THEN 1.0::DOUBLE WHEN dt IS NOT NULL THEN 0 END) AS directional_accuracy
 FROM (SELECT *, target - p_hat AS e, target - lag(target) OVER ({P}) AS dt, p_hat - lag(p_hat) OVER ({P}) AS dp FROM preds) GROUP BY ALL""", "rmse mae r2 mape directional_accuracy", ctes=PR)(lambda s: evaluate.regression(s.preds(), "target", "p_hat"))
query("agg16_best_threshold", """SELECT t AS threshold, f1 FROM (SELECT k / 100.0::DOUBLE AS t, coalesce(2.0::DOUBLE * count(*) FILTER (y_true = 1 AND floor(round(y_prob * 100, 9)) >= k) / nullif(count(*) FILTER (floor(round(y_prob * 100, 9)) >= k) + count(*) FILTER (y_true = 1), 0), 0) AS f1
 FROM scored, (SELECT unnest(range(101)) AS k) GROUP BY k) ORDER BY f1 DESC, t LIMIT 1""", "threshold f1", ctes=SCORED)(lambda s: evaluate.best_threshold(s.scored(), "y_true", "y_prob"))


def importances(s: Inputs) -> DataFrame:
    names = [("tbr_base", "l_quantity"), ("deriv_oi", "l_tax"), ("mom_ret3", "l_discount"), ("vol_x", "l_extendedprice")]
    one = s.table("lineitem").agg(*[F.stddev_pop(c).alias(n) for n, c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n, _ in names])))


IMP = "imp AS (SELECT 'tbr_base' AS feature, stddev_pop(l_quantity) AS importance FROM lineitem UNION ALL SELECT 'deriv_oi', stddev_pop(l_tax) FROM lineitem UNION ALL SELECT 'mom_ret3', stddev_pop(l_discount) FROM lineitem UNION ALL SELECT 'vol_x', stddev_pop(l_extendedprice) FROM lineitem)"
query("agg17_group_importance", """SELECT CASE feature WHEN 'tbr_base' THEN 'orderflow' WHEN 'deriv_oi' THEN 'derivatives' WHEN 'mom_ret3' THEN 'momentum_vol' ELSE 'other' END AS "group", importance, importance / sum(importance) OVER () * 100 AS share FROM imp""", "importance share", ctes=IMP)(lambda s: evaluate.group_importance(importances(s), S.feature_group(F.col("feature"))))
query("srt2_3_top_features", "SELECT feature, importance, '120m' AS horizon FROM imp ORDER BY importance DESC, feature LIMIT 3", "importance", ctes=IMP)(lambda s: evaluate.top_features(importances(s), 3, horizon="120m"))
query("agg18_class_weights", "SELECT doc_id, y_true, n / (k * c)::DOUBLE AS weight FROM scored JOIN (SELECT y_true, count(*) AS c, sum(count(*)) OVER () AS n, count(*) OVER () AS k FROM scored GROUP BY y_true) USING (y_true)", "weight", "y_true", SCORED)(lambda s: evaluate.class_weights(s.scored(), "y_true").select("doc_id", "y_true", "weight"))
query("agg19_positive_scale", "SELECT sum(y_prob) FILTER (y_true = 0) / nullif(sum(y_prob) FILTER (y_true = 1), 0) AS scale FROM scored", "scale", ctes=SCORED)(lambda s: s.scored().agg(evaluate.positive_scale(F.col("y_true"), F.col("y_prob")).alias("scale")))
query("rul5_ensemble", "SELECT symbol, ts, (close + open + high) / 3 AS p FROM bars", "p", ctes=BARS)(lambda s: signals.ensemble(s.bars().select("symbol", "ts", F.inline(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in ("close", "open", "high")]))), ["symbol", "ts"]))

# splits
query("spl1_holdout", f"SELECT symbol, ts, CASE WHEN i >= n - ceil(n * 0.2) THEN 'test' ELSE 'train' END AS role FROM (SELECT *, row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)", ctes=BARS)(lambda s: splits.holdout(s.bars()).select("symbol", "ts", "role"))
DAY = 86400


def folds_sql(table: str) -> str:
    return f"SELECT symbol, ts, fold, 'train' AS role FROM {table} f JOIN bars ON ts >= a AND ts < b UNION ALL SELECT symbol, ts, fold, 'test' FROM {table} f JOIN bars ON ts >= c AND ts < d"


WF = f"""{BARS},
m AS (SELECT min(ts) AS lo, max(ts) AS hi FROM bars),
f AS (SELECT i AS fold, s - 7 * {DAY} AS a, s AS b, s AS c, s + 3 * {DAY} AS d FROM (SELECT i, lo + 10 * {DAY} + i * 3 * {DAY} AS s, hi FROM m, (SELECT unnest(range(100)) AS i)) WHERE s + 3 * {DAY} <= hi)"""
query("spl2_jn6_walk_forward", folds_sql("f"), "", "fold", WF)(lambda s: splits.walk_forward_split(s.bars(), 7, 3, 3, 10).select("symbol", "ts", "fold", "role"))
PWF = f"""{BARS},
m AS (SELECT min(ts) AS lo, max(ts) + 3600 AS hi FROM bars),
f AS (SELECT i AS fold, s - 7 * {DAY} AS a, s - 7200 AS b, s AS c, s + 3 * {DAY} AS d FROM (SELECT i, lo + 10 * {DAY} + i * (3 * {DAY} + 3600) AS s, hi FROM m, (SELECT unnest(range(100)) AS i)) WHERE s + 3 * {DAY} <= hi)"""
query("spl3_purged_walk_forward", folds_sql("f"), "", "fold", PWF)(lambda s: splits.walk_forward_split(s.bars(), 7, 3, 3, 10, 120, 60).select("symbol", "ts", "fold", "role"))
PK = f"""{BARS},
n AS (SELECT *, row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
t AS (SELECT *, len(list_filter([1, 2, 3, 4], lambda j: i >= floor(n * j / 5.0))) - 1 AS g FROM n),
w AS (SELECT symbol, g, min(ts) - 7200 AS lo, max(ts) + 7200 AS hi FROM t WHERE g >= 0 GROUP BY ALL),
tr AS (SELECT t.symbol, t.ts, k.g AS fold FROM t JOIN w k ON t.symbol = k.symbol AND k.g > t.g WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.symbol = t.symbol AND x.g <= k.g AND t.ts BETWEEN x.lo AND x.hi))"""
query("spl4_purged_kfold", "SELECT symbol, ts, fold, 'train' AS role FROM tr UNION ALL SELECT symbol, ts, g, 'test' FROM t WHERE g >= 0 AND (symbol, g) IN (SELECT symbol, fold FROM tr)", "", "fold", PK)(lambda s: splits.purged_kfold(s.bars(), 4, 120).select("symbol", "ts", "fold", "role"))
query("spl6_expanding", f"""SELECT symbol, ts, fold, CASE WHEN i >= st THEN 'test' ELSE 'train' END AS role FROM (SELECT *, n - (n // 5) * (4 - fold) AS st, n // 5 AS sz FROM (SELECT symbol, ts, row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), (SELECT unnest(range(4)) AS fold)) WHERE (i >= st AND i < st + sz) OR i < st - 5""", "", "fold", BARS)(lambda s: splits.expanding(s.bars(), 4, 5).select("symbol", "ts", "fold", "role"))
query("spl5_stratified_holdout")(lambda s: splits.stratified_holdout(s.scored(), "y_true", "doc_id").select("doc_id", "y_true", "role"))
query("spl7_stratified_kfold")(lambda s: splits.stratified_kfold(s.scored(), "y_true", "doc_id").select("doc_id", "y_true", "fold"))
SIZES = "(SELECT y_true, count(*) AS n FROM scored GROUP BY y_true)"
query("spl5_stratified_holdout_sizes", f"SELECT y_true, role, n FROM (SELECT y_true, 'test' AS role, CAST(round(n * 0.2) AS BIGINT) AS n FROM {SIZES} UNION ALL SELECT y_true, 'train', n - CAST(round(n * 0.2) AS BIGINT) FROM {SIZES}) WHERE n > 0", "", "y_true n", SCORED)(
    lambda s: splits.stratified_holdout(s.scored(), "y_true", "doc_id").groupBy("y_true", "role").agg(F.count("*").alias("n")))
query("spl7_stratified_kfold_sizes", f"SELECT y_true, f AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n FROM {SIZES}, (SELECT unnest(range(5)) AS f) WHERE n > f", "", "y_true fold n", SCORED)(
    lambda s: splits.stratified_kfold(s.scored(), "y_true", "doc_id").groupBy("y_true", "fold").agg(F.count("*").alias("n")))
