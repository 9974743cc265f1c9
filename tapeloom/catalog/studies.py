"""Parameter-study queries (inventory rows G01-G09)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tapeloom.catalog.base import BARS_SQL, machine_cte, query, sroll, with_bars
from tapeloom.catalog.events import SOFT, condition_ctes, edge_sql
from tapeloom.catalog.indicators import r4
from tapeloom.catalog.trades import COST, RULES, flag_ctes
from tapeloom.operators import events as ev
from tapeloom.operators.signals import min_rows_needed
from tapeloom.plans import grids, studies

GRID = {"num_std": [1.5, 2.0], "breakout_max_wait": [5, 10], "squeeze_threshold": [None, 3.0]}
SETS = grids.param_sets({**ev.BASE_PARAMS["bollinger_squeeze"], **SOFT}, GRID)


@query("g01_param_sets", with_bars(
    """SELECT symbol, experiment_id, param_label, squeeze_lookback, rows FROM (SELECT symbol, count(*) AS rows FROM bars GROUP BY 1),
  (SELECT row_number() OVER (ORDER BY i, j, k) AS experiment_id, 'num_std=' || a || ' | breakout_max_wait=' || b || ' | squeeze_threshold=' || c AS param_label, 60 AS squeeze_lookback
   FROM (VALUES (1, '1.5'), (2, '2.0')) x(i, a), (VALUES (1, '5'), (2, '10')) y(j, b), (VALUES (1, 'None'), (2, '3.0')) z(k, c))"""))
def _(t):
    rows = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return grids.attach_grid(rows, SETS).select("symbol", "experiment_id", "param_label", "squeeze_lookback", "rows")


@query("g02_bollinger_grids", with_bars(
    """SELECT mode, symbol, count(*) AS candidates, count(*) FILTER (rows >= need) AS usable FROM (SELECT symbol, count(*) AS rows FROM bars GROUP BY 1), (
  SELECT 'breakout' AS mode, greatest(w + 2, d + 1, CASE WHEN g > 0 THEN (CASE WHEN g = 1 THEN 40 ELSE 60 END) + 3 ELSE 0 END, CASE WHEN v > 0 THEN 21 ELSE 0 END) AS need
    FROM unnest([14, 20, 26]) a(w), unnest([1.8, 2.0, 2.2]) b(k), unnest([0, 1]) c(d), unnest([0, 1, 2]) e(g), unnest([0, 1, 2]) f(v)
  UNION ALL SELECT 'mean_reversion', greatest(w + 2, d + 1) FROM unnest([14, 20, 26, 34]) a(w), unnest([1.6, 1.8, 2.0, 2.2]) b(k), unnest([0, 1]) c(d)
  UNION ALL SELECT 'squeeze', greatest(w + 2, 60 + w, CASE WHEN g = 1 THEN 63 ELSE 0 END) FROM unnest([18, 20, 26]) a(w), unnest([1.8, 2.0, 2.2]) b(k), unnest([0.1, 0.2]) q(q), unnest([0, 1]) c(d), unnest([0, 1]) e(g), unnest([0, 1]) f(s)
  UNION ALL SELECT 'double', greatest(w + 2, 63, n + w) FROM unnest([14, 20, 26]) a(w), unnest([1.8, 2.0, 2.2]) b(k), unnest([2, 3]) e(n), unnest([0, 1]) c(d)) GROUP BY ALL"""))
def _(t):
    rows = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    all_rows = [{"mode": m, "need": min_rows_needed(c)} for m in grids.BOLLINGER_AXES for c in grids.bollinger_grid(m)]
    df = grids.attach_grid(rows, all_rows)
    return df.groupBy("mode", "symbol").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("rows") >= F.col("need")).alias("usable"))


def scan_sql(body):
    """Every parameter set by the fold of the squeeze condition, one after the other."""
    ctes, parts = [BARS_SQL], []
    for s in SETS:
        name = f"x{s['experiment_id']}"
        fold = list(condition_ctes(k=s["num_std"], wait=s["breakout_max_wait"], name=name))
        if s["squeeze_threshold"] is not None:
            fold = [c.replace(f"{sroll('quantile_cont({}, 0.3)', 'bandwidth', 60, 20)} AS condition_threshold", f"{s['squeeze_threshold']}::DOUBLE AS condition_threshold") for c in fold]
        ctes += fold
        parts.append(f"SELECT {s['experiment_id']} AS experiment_id, symbol, date, close, rn, n, condition FROM {name}")
    ctes.append("allx AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append("runs AS (SELECT * FROM (SELECT *, coalesce(lag(condition) OVER (PARTITION BY experiment_id, symbol ORDER BY date), FALSE) AS was FROM allx) WHERE condition AND NOT was)")
    ctes.append("""kept_l AS (SELECT experiment_id, symbol, unnest(list_reduce(list_transform(list(rn ORDER BY rn), lambda x: [x]),
  lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 20 THEN list_append(acc, x[1]) ELSE acc END)) AS rn FROM runs GROUP BY experiment_id, symbol)""")
    ctes.append("kept AS (SELECT r.* FROM runs r JOIN kept_l USING (experiment_id, symbol, rn) WHERE r.rn > 30 AND r.rn + 30 <= r.n)")
    ctes.append("""fwd AS (SELECT e.experiment_id, e.symbol, b.rn - e.rn AS horizon, b.close / e.close - 1 AS v FROM kept e JOIN x1 b ON b.symbol = e.symbol AND b.rn - e.rn IN (1, 5, 10, 20, 30))""")
    figs = ", ".join(f"round(avg(v) FILTER (horizon = {h}), 4) AS mean_return_{h}d, round(median(v) FILTER (horizon = {h}), 4) AS median_return_{h}d, "
                     f"round(avg((v > 0)::INT) FILTER (horizon = {h}), 4) AS win_rate_{h}d, count(v) FILTER (horizon = {h}) AS sample_count_{h}d" for h in ev.FORWARD_HORIZONS)
    ctes.append(f"figs AS (SELECT experiment_id, {figs} FROM fwd GROUP BY 1)")
    ctes.append("""cnt AS (SELECT experiment_id, CAST(sum(c) AS BIGINT) AS event_count, count(*) AS symbol_count, round(avg(c), 4) AS avg_events_per_symbol FROM (SELECT experiment_id, symbol, count(*) AS c FROM kept GROUP BY ALL) GROUP BY 1)""")
    ctes.append("skips AS (SELECT experiment_id, count(*) AS skip_symbol_count FROM (SELECT DISTINCT experiment_id, symbol FROM allx EXCEPT SELECT DISTINCT experiment_id, symbol FROM kept_l) GROUP BY 1)")
    label = "CASE experiment_id " + " ".join(f"WHEN {s['experiment_id']} THEN '{s['param_label']}'" for s in SETS) + " END"
    text = "CASE experiment_id " + " ".join(
        f"WHEN {s['experiment_id']} THEN '{json.dumps({k: v for k, v in s.items() if k not in ('experiment_id', 'param_label')}, ensure_ascii=False, sort_keys=True)}'" for s in SETS) + " END"
    counts = ", ".join(f"coalesce(sample_count_{h}d, 0) AS sample_count_{h}d" for h in ev.FORWARD_HORIZONS)
    ctes.append(f"summary_ AS (SELECT experiment_id, {label} AS param_label, {text} AS params_json, coalesce(event_count, 0) AS event_count, coalesce(symbol_count, 0) AS symbol_count, "
                "coalesce(avg_events_per_symbol, 0) AS avg_events_per_symbol, coalesce(skip_symbol_count, 0) AS skip_symbol_count, "
                f"figs.* EXCLUDE (experiment_id) REPLACE ({counts}), mean_return_20d AS rank_metric FROM (SELECT DISTINCT experiment_id FROM allx) LEFT JOIN cnt USING (experiment_id) "
                "LEFT JOIN figs USING (experiment_id) LEFT JOIN skips USING (experiment_id))")
    return "WITH " + ",\n".join(ctes) + "\n" + body


def summary(t):
    out = studies.experiment_summary(t.bars, "bollinger_squeeze", SETS)
    figures = [c for c in out.columns if c.startswith(("mean_", "median_", "win_", "avg_", "rank_"))]
    return out.withColumns({c: F.round(c, 4) for c in figures})


@query("g03_scan", store=True, sql=scan_sql("SELECT experiment_id, symbol, count(*) FILTER (condition) AS condition_days, min(date) FILTER (condition) AS first_day FROM allx GROUP BY ALL"))
def _(t):
    df = studies.scan_conditions(t.bars, "bollinger_squeeze", SETS)
    return df.groupBy("experiment_id", "symbol").agg(F.count_if("condition").alias("condition_days"), F.min(F.when(F.col("condition"), F.col("date"))).alias("first_day"))


@query("g04_experiment_summary", store=True, sql=scan_sql("SELECT * FROM summary_"))
def _(t):
    return summary(t)


@query("g05_best_experiment", store=True, sql=scan_sql("SELECT experiment_id, param_label, event_count, rank_metric FROM summary_ WHERE event_count >= 6 ORDER BY rank_metric DESC, event_count DESC, experiment_id LIMIT 1"))
def _(t):
    return studies.best_experiment(summary(t)).select("experiment_id", "param_label", "event_count", "rank_metric")


# ---- Bollinger study: 32 mean-reversion candidates

CANDIDATES = grids.bollinger_grid("mean_reversion")
PERIODS = {"train": ("1995-01-01", "1998-12-31"), "valid": ("1999-01-01", "2000-12-31")}
TEST = ("2001-01-01", "2001-12-31")
HORIZONS = (1, 5, 10)
CAPITAL = 30_000_000.0  # covers one trade of every symbol at a time
KEYS = "cid, period, symbol"


def part(keys):
    return f"PARTITION BY {keys} ORDER BY date"


CAND_CTES = (
    "cand AS (SELECT row_number() OVER (ORDER BY w, k, d) AS cid, w, k, d FROM unnest([14, 20, 26, 34]) a(w), unnest([1.6::DOUBLE, 1.8::DOUBLE, 2.0::DOUBLE, 2.2::DOUBLE]) b(k), unnest([0, 1]) c(d))",
    "bw AS (" + " UNION ALL ".join(f"SELECT *, {w} AS w, {sroll('avg', 'close', w)} AS mid, {sroll('stddev_samp', 'close', w)} AS sd FROM bars" for w in (14, 20, 26, 34)) + ")",
    "bl AS (SELECT *, lag(close) OVER x AS pc, lag(mid) OVER x AS pmid, lag(sd) OVER x AS psd, count(*) OVER (PARTITION BY symbol, w) AS nn FROM bw WINDOW x AS (PARTITION BY symbol, w ORDER BY date))",
    "cb AS (SELECT cid, k, d, bl.*, mid + k * sd AS up, mid - k * sd AS lo, pmid + k * psd AS pup, pmid - k * psd AS plo FROM bl JOIN cand USING (w))",
    machine_cte("mr", "cb", "pc <= plo AND close > lo", "pc >= pup AND close < up", "close > mid AND pc <= pmid", "close < mid AND pc >= pmid",
                "up IS NOT NULL AND lo IS NOT NULL", out="raw", keys="cid, symbol"),
    f"cs AS (SELECT cid, symbol, date, CASE WHEN nn < greatest(w + 2, d + 1) THEN 0 WHEN d = 0 THEN raw ELSE coalesce(lag(raw) OVER ({part('cid, symbol')}), 0) END AS signal FROM mr)")


def account_ctes(periods):
    case = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in periods.items()) + " END"
    so_far = f"OVER ({part(KEYS)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (
        *flag_ctes("bars"),
        f"cp AS (SELECT * FROM (SELECT cid, signal, fl.*, {case} AS period FROM cs JOIN fl USING (symbol, date)) WHERE period IS NOT NULL)",
        f"l1 AS (SELECT *, coalesce(last_value(CASE WHEN signal = 1 AND NOT susp AND NOT lim_up AND lots > 0 THEN 1 WHEN signal = -1 AND NOT susp AND NOT lim_down THEN 0 END IGNORE NULLS) {so_far}, 0) AS st FROM cp)",
        f"l2 AS (SELECT *, st - coalesce(lag(st) OVER ({part(KEYS)}), 0) AS trade FROM l1)",
        "l3 AS (SELECT *, CASE trade WHEN 1 THEN close * (1 + 0.0001::DOUBLE) WHEN -1 THEN close * (1 - 0.0001::DOUBLE) END AS px FROM l2)",
        f"l4 AS (SELECT *, last_value(CASE WHEN trade = 1 THEN lots END IGNORE NULLS) {so_far} AS qty, last_value(CASE WHEN trade = 1 THEN lots * px + {COST.format(v='(lots * px)')} END IGNORE NULLS) {so_far} AS pcost FROM l3)",
        f"l5 AS (SELECT *, CASE WHEN st = 1 THEN qty ELSE 0 END AS held, CASE trade WHEN 1 THEN -pcost WHEN -1 THEN qty * px - {COST.format(v='(qty * px)')} - qty * px * 0.0005::DOUBLE ELSE 0 END AS flow FROM l4)",
        "day_ AS (SELECT cid, period, date, sum(flow) AS f, sum(held * close) AS worth FROM l5 GROUP BY ALL)",
        "val AS (SELECT cid, period, date, 30000000 + sum(f) OVER x + worth AS v FROM day_ WINDOW x AS (PARTITION BY cid, period ORDER BY date))",
        "vr AS (SELECT *, v / lag(v) OVER x - 1 AS r, max(v) OVER x AS mx FROM val WINDOW x AS (PARTITION BY cid, period ORDER BY date))",
        """m1 AS (SELECT *, pow(1 + total_return, 252.0 / n) - 1 AS annual_return FROM (SELECT cid, period, arg_max(v, date) / arg_min(v, date) - 1 AS total_return, count(*) AS n,
  stddev_samp(r) * sqrt(252) AS vol, min((v - mx) / mx) AS max_drawdown FROM vr GROUP BY ALL))""",
        "m2 AS (SELECT *, CASE WHEN vol > 0 THEN (annual_return - 0.03) / vol ELSE 0 END AS sharpe_ratio, CASE WHEN max_drawdown = 0 THEN 0 ELSE annual_return / abs(max_drawdown) END AS calmar_ratio FROM m1)",
        "m3 AS (SELECT cid, period, count(*) FILTER (trade = -1) AS sell_trade_count, count(*) FILTER (trade = -1 AND flow > pcost) / nullif(count(*) FILTER (trade = -1), 0) AS win_rate FROM l5 GROUP BY ALL)",
        "deals AS (SELECT cid, period, symbol, date, CASE trade WHEN 1 THEN 'buy' ELSE 'sell' END AS action FROM l5 WHERE trade <> 0)",
        "m4 AS (" + edge_sql("deals", "bars", HORIZONS, "cid, period").replace("round(", "(").replace(", 4) AS", ") AS") + ")",
        "res AS (SELECT cid, period, total_return, annual_return, sharpe_ratio, max_drawdown, calmar_ratio, sell_trade_count, coalesce(win_rate, 0) AS win_rate, "
        + ", ".join(f"coalesce({x}, 0) AS {x}" for x in ["signal_event_count", "signal_mean_mfe_10", "signal_mean_mae_10"] + [f"signal_{a}_{h}" for h in HORIZONS for a in ("mean_edge", "hit_rate")])
        + " FROM m2 JOIN m3 USING (cid, period) LEFT JOIN m4 USING (cid, period))")


FIGURES = ["total_return", "annual_return", "sharpe_ratio", "max_drawdown", "calmar_ratio", "sell_trade_count", "win_rate", "signal_event_count",
           "signal_mean_edge_1", "signal_mean_edge_5", "signal_mean_edge_10", "signal_hit_rate_5", "signal_mean_mfe_10", "signal_mean_mae_10"]
EXACT = {"sell_trade_count", "signal_event_count"}


def wide_sql(periods):
    return ", ".join((f"any_value({f}) FILTER (period = '{p}') AS {p}_{f}" if f in EXACT else f"round(any_value({f}) FILTER (period = '{p}'), 4) AS {p}_{f}") for p in periods for f in FIGURES)


def rounded(df, extra, periods):
    return df.select(*extra, *[F.col(f"{p}_{f}") if f in EXACT else F.round(f"{p}_{f}", 4).alias(f"{p}_{f}") for p in periods for f in FIGURES])


def evaluated(t):
    out = studies.evaluate_candidates(t.bars, CANDIDATES, PERIODS, RULES, HORIZONS, CAPITAL)
    return studies.with_parameters(out, CANDIDATES, grids.parameter_columns("mean_reversion"))


@query("g06_evaluate_grid", store=True, sql=with_bars(
    f"SELECT CAST(cid AS INT) AS experiment_id, 'mean_reversion' AS mode, w AS \"window\", k AS num_std, d AS signal_delay, {wide_sql(PERIODS)} FROM res JOIN cand USING (cid) GROUP BY ALL",
    *CAND_CTES, *account_ctes(PERIODS)))
def _(t):
    return rounded(evaluated(t), ["experiment_id", "mode", "window", "num_std", "signal_delay"], PERIODS)


def pv(period, x):
    return f"any_value({x}) FILTER (period = '{period}')"


SCORE = f"""sc AS (SELECT cid, any_value(w) AS w, any_value(k) AS k, {pv('valid', 'sharpe_ratio')} AS vs, {pv('train', 'sharpe_ratio')} AS ts, {pv('valid', 'annual_return')} AS va, {pv('train', 'annual_return')} AS ta,
  {pv('valid', 'calmar_ratio')} AS vc, {pv('valid', 'sell_trade_count')} AS vn, {pv('valid', 'max_drawdown')} AS vd, {pv('valid', 'signal_event_count')} AS ve,
  {' + '.join(pv('valid', f'signal_mean_edge_{h}') for h in HORIZONS)} AS vem, {' + '.join(pv('train', f'signal_mean_edge_{h}') for h in HORIZONS)} AS tem,
  {' + '.join(pv('valid', f'signal_hit_rate_{h}') for h in HORIZONS)} AS vh, {pv('valid', 'signal_mean_edge_5')} AS e5, {pv('valid', 'signal_mean_mfe_10')} AS mfe, {pv('valid', 'signal_mean_mae_10')} AS mae
  FROM res JOIN cand USING (cid) GROUP BY 1),
sd AS (SELECT *, abs(ts - vs) + 0.5 * abs(ta - va) AS pen, abs(tem / 3 - vem / 3) AS spen FROM sc),
se AS (SELECT *, vs + 0.35 * vc + 0.10 * va - 0.5 * pen AS psc, e5 * 100 + vh / 3 + 0.5 * mfe * 100 + 0.25 * mae * 100 - 0.5 * spen * 100 AS ssc, vn >= 3 AND vd >= -0.2 AS pp, ve >= 10 AS sp FROM sd),
ranked AS (SELECT *, 0.5 * psc + 0.5 * ssc AS score, pp AND sp AS pass, row_number() OVER (ORDER BY pp AND sp DESC, 0.5 * psc + 0.5 * ssc DESC NULLS LAST, vs DESC, va DESC, cid) AS rank FROM se)"""


def ranked(t):
    return studies.score_candidates(evaluated(t), "combined", HORIZONS, 5, 3, 10, 0.2)


@query("g07_score_candidates", store=True, sql=with_bars(
    "SELECT CAST(cid AS INT) AS experiment_id, w AS \"window\", k AS num_std, rank, pass AS validation_pass, round(score, 4) AS selection_score, round(psc, 4) AS portfolio_selection_score, round(ssc, 4) AS signal_selection_score FROM ranked",
    *CAND_CTES, *account_ctes(PERIODS), SCORE))
def _(t):
    return ranked(t).select("experiment_id", "window", "num_std", "rank", "validation_pass", *r4("selection_score", "portfolio_selection_score", "signal_selection_score"))




def renamed(ctes, names, suffix):
    """The same chain of CTEs again under other names, for a second set of periods."""
    import re

    out = []
    for c in ctes:
        for n in names:
            c = re.sub(rf"\b{n}\b(?!\s*\()", n + suffix, c) if n in ("val", "res", "cp") else re.sub(rf"\b{n}\b", n + suffix, c)
        out.append(c)
    return out


ACCOUNT_NAMES = ["cp", "l1", "l2", "l3", "l4", "l5", "day_", "val", "vr", "m1", "m2", "m3", "m4", "deals", "res"]


@query("g08_top_on_test", store=True, sql=with_bars(
    f"SELECT CAST(cid AS INT) AS experiment_id, any_value(rank) AS rank, {wide_sql({'test': TEST})} FROM res_t JOIN ranked USING (cid) WHERE rank <= 5 GROUP BY 1",
    *CAND_CTES, *account_ctes(PERIODS), SCORE, *renamed(account_ctes({"test": TEST})[3:], ACCOUNT_NAMES, "_t")))
def _(t):
    out = studies.evaluate_top(t.bars, CANDIDATES, ranked(t), 5, TEST, RULES, horizons=HORIZONS, initial_capital=CAPITAL)
    return rounded(out, ["experiment_id", "rank"], ["test"])


STDS = [1.6, 1.8, 2.0, 2.2]


@query("g09_sharpe_heatmap", store=True, sql=with_bars(
    "SELECT w AS \"window\", " + ", ".join(f"round(avg(vs) FILTER (k = {s}), 4) AS \"{s}\"" for s in STDS) + " FROM sc GROUP BY 1", *CAND_CTES, *account_ctes(PERIODS), SCORE))
def _(t):
    wide = studies.sharpe_heatmap(ranked(t), STDS)
    return wide.select("window", *[F.round(F.col(f"`{s}`"), 4).alias(str(s)) for s in STDS])


