"""Queries of the panel operators over the feature table, the calls and the orders of nations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.functions.scalars import clip, contains_query, escape_html, p_bucket, quarter_index, quarter_key, quarter_label, round_exact
from quarterloom.operators import panel as P
from quarterloom.operators import stats as S
from quarterloom.operators.timestamps import with_norm
from quarterloom.plans import fit_sql as Q
from quarterloom.plans import pipelines as L
from quarterloom.sources import more, table
from quarterloom.sources.lexicons import loaded_lexicons

_LEAST = 300
_r = lambda c: F.round(c, 6)
_FEATURES = ["feature_id", "ticker", "company", "sector", "year", "quarter", "datacqtr", "earnings_date", "feed", "qa_isolated", "total_tokens_qa", "uncertainty_density_qa", "negation_excluded_full", "eps_ttm", "eps_ttm_next_q", "eps_ttm_growth_next_q", *(f"{c}_density_qa" for c in L.CONTROLS)]


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table with one row per ticker, year and quarter: the earliest of rows that come twice."""
    rows = table(spark, folder, "tech_uncertainty_features").select(*_FEATURES)
    return P.keep_best(rows, L.KEYS, [-F.col("feature_id")])


def recent_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Recent calls later than the whole panel, on its scale."""
    feeds = table(spark, folder, "call_feeds").select("feed", F.col("home_zone").alias("__hz"), F.col("date_order").alias("__do"))
    recent = with_norm(table(spark, folder, "recent_corpus").join(feeds, "feed", "left"), "call_date", "__hz", "__do")
    return L.recent_signals(recent, panel(spark, folder), "norm", loaded_lexicons(spark)["uncertainty"], least_tokens=_LEAST)


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return L.growth_sample(panel(spark, folder), _LEAST)


def _zs(spark: SparkSession, folder: str) -> DataFrame:
    return L.standardized_sample(panel(spark, folder), _LEAST)


def _section(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).where(P.sample_filter(_LEAST)).withColumn("density", F.col("uncertainty_density_qa"))


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations by quarter with order totals: a balanced panel as long as every nation orders in every quarter."""
    orders, customers, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    q = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("bigint")
    return rows.groupBy(F.col("n_name").alias("ticker"), q.alias("q")).agg(F.sum("o_totalprice").alias("x"), F.count("*").cast("double").alias("y"))


def pr1_universe(spark, folder):
    rows = table(spark, folder, "tech_uncertainty_features")
    return rows.where(P.universe(("Information Technology", "Energy"), ("ZANNO", "ZJJMT"))).select("feature_id", "ticker", "sector")


def pr2_keys_present(spark, folder):
    return table(spark, folder, "corpus").dropna(subset=["ticker", "year", "quarter"]).select("corpus_id", F.col("year").cast("bigint").alias("year"), F.col("quarter").cast("bigint").alias("quarter"))


def pr6_sample(spark, folder):
    return panel(spark, folder).where(P.sample_filter(_LEAST, "eps_ttm_growth_next_q")).select("feature_id", "ticker", "total_tokens_qa")


def pr7_quarter_axis(spark, folder):
    rows = panel(spark, folder)
    return rows.select("feature_id", quarter_index("year", "quarter").alias("qidx"), quarter_key("year", "quarter").alias("key"), quarter_label("year", "quarter").alias("label"))


def pr9_winsorize(spark, folder):
    return _sample(spark, folder).select("feature_id", _r("growth_w").alias("growth_w"))


def pr9_winsorize_by_sector(spark, folder):
    return P.winsorize(panel(spark, folder).where("sector is not null"), "eps_ttm_growth_next_q", "w", by=["sector"]).select("feature_id", _r("w").alias("w"))


def pr13_strictly_newer(spark, folder):
    rows = panel(spark, folder)
    return P.strictly_newer(rows, rows.where("year < 2020")).select("feature_id", "ticker", F.col("year").cast("bigint").alias("year"))


def pr14_bucket(spark, folder):
    return panel(spark, folder).select("feature_id", p_bucket(F.col("uncertainty_density_qa") / 100).alias("bucket"))


def pr15_rounded(spark, folder):
    """Rounding of the exact binary value."""
    return panel(spark, folder).select("feature_id", round_exact("uncertainty_density_qa", F.lit(2)).alias("density_2"))


def pr18_tagged(spark, folder):
    return panel(spark, folder).select("feature_id", F.lit(True).alias("qa_isolated"), F.lit("panel").alias("source"))


def pr19_innovation(spark, folder):
    return panel(spark, folder).select("feature_id", _r(P.innovation("eps_ttm", "eps_ttm_next_q")).alias("yoy"))


def a1_summary(spark, folder):
    return panel(spark, folder).agg(F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), F.min("year").cast("bigint").alias("first_year"), F.max("year").cast("bigint").alias("last_year"))


def a2_last_quarter(spark, folder):
    return panel(spark, folder).groupBy("ticker").agg(F.max(quarter_index("year", "quarter")).alias("last_q"))


def a3_mean_median(spark, folder):
    g = "eps_ttm_growth_next_q"
    return _sample(spark, folder).groupBy("ticker").agg(F.count("*").alias("n"), _r(F.avg(g)).alias("mean_growth"), _r(F.expr(f"percentile({g}, 0.5D)")).alias("median_growth")).where("n >= 12")


def a6_pearson(spark, folder):
    return _sample(spark, folder).groupBy("ticker").agg(F.count("*").alias("n"), _r(S.correlation("density", "growth_w")).alias("r")).where("n >= 12")


def a6_correlations(spark, folder):
    """Pearson and Spearman with p-values, mean and median, by ticker."""
    rows = S.correlations(_sample(spark, folder), "ticker", "density", "growth_w", "eps_ttm_growth_next_q")
    return rows.select("ticker", "n_quarters", *(_r(c).alias(c) for c in ("pearson_r", "pearson_p", "spearman_rho", "spearman_p", "mean_growth", "median_growth")))


def a7_spearman(spark, folder):
    rows = S.correlations(_sample(spark, folder), "ticker", "density", "growth_w", "eps_ttm_growth_next_q")
    return rows.select("ticker", _r("spearman_rho").alias("rho"))


def a8_deviation(spark, folder):
    return _section(spark, folder).groupBy("ticker").agg(_r(F.stddev_pop("density")).alias("sd"))


def a10_conditional_counts(spark, folder):
    rows = a6_pearson(spark, folder)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("positive"), F.count_if(F.col("r") < -0.2).alias("below"))


def a11_histogram(spark, folder):
    counts = panel(spark, folder).groupBy(quarter_key("year", "quarter").alias("key")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("key").desc()).limit(6)


def a12_calibration(spark, folder):
    rows = S.calibration(panel(spark, folder), "uncertainty_density_qa", "negative_density_qa")
    return rows.select("n", _r("slope").alias("slope"), _r("intercept").alias("intercept"), _r("corr").alias("corr"))


def a13_one_way(spark, folder):
    fit = S.slope_by(_zs(spark, folder), "growth_w", "density_z", "ticker")
    return fit.select("n", "entities", _r("beta").alias("beta"), _r("se").alias("se"), _r("t").alias("t"))


def a13_by_sector(spark, folder):
    rows = L.sector_table(panel(spark, folder), 20, 2, _LEAST)
    return rows.select("sector", "n", "tickers", _r("beta_pp").alias("beta_pp"), _r("t").alias("t"))


def _rounded(fit: DataFrame) -> DataFrame:
    return fit.withColumns({c: F.round(c, 4) for c in ("coef", "se", "t", "p", "r2_within") if c in fit.columns})


def a14_two_way(spark, folder):
    fit = S.fe_fit(nations(spark, folder), "y", ["x"], "ticker", "q")
    return fit.select("n", "entities", F.round(F.col("coef") * 1e6, 5).alias("coef_e6"), F.round(F.col("se") * 1e6, 5).alias("se_e6"))


def a14_two_way_unbalanced(spark, folder):
    return _rounded(S.fe_fit(_zs(spark, folder), "growth_w", ["density_z"], "ticker", "datacqtr"))


def a15_controls(spark, folder):
    """Each control beside the density, then all jointly, with entity effects."""
    return _rounded(L.control_fits(_zs(spark, folder)))


def a15_controls_two_way(spark, folder):
    """The same with both effects."""
    return _rounded(L.control_fits(_zs(spark, folder), "datacqtr"))


def a15_momentum(spark, folder):
    return _rounded(L.momentum_fit(_zs(spark, folder)))


def a15_momentum_two_way(spark, folder):
    return _rounded(L.momentum_fit(_zs(spark, folder), "datacqtr"))


def a16_within_r2(spark, folder):
    return S.fe_fit(_zs(spark, folder), "growth_w", ["density_z"], "ticker").select(F.round("r2_within", 8).alias("r2_within"))


def a17_control_correlations(spark, folder):
    rows = L.with_controls(_zs(spark, folder))
    return rows.agg(*(_r(S.correlation("density_z", f"{c}_z")).alias(c) for c in L.CONTROLS))


def a18_median_split(spark, folder):
    rows = a3_mean_median(spark, folder).join(a6_pearson(spark, folder).select("ticker", "r"), "ticker")
    split = S.median_split(rows, "r", "median_growth")
    return split.select(F.round("mean_high", 5).alias("mean_high"), F.round("mean_low", 5).alias("mean_low"))


def a19_longest(spark, folder):
    """The longest transcript of each call; only its length is moved."""
    return P.longest_text(table(spark, folder, "corpus"), L.KEYS, "transcript", "corpus_id").select("corpus_id", "ticker", F.col("n_chars").cast("bigint").alias("n_chars"))


def a21_trend(spark, folder):
    """Per company mean, least, most and the trend from first to last."""
    q = quarter_index("year", "quarter")
    rows = _section(spark, folder).groupBy("ticker").agg(_r(F.avg("density")).alias("mean"), F.min("density").alias("low"), F.max("density").alias("high"), F.min_by("density", q).alias("a"), F.max_by("density", q).alias("b"))
    return rows.select("ticker", "mean", _r("low").alias("low"), _r("high").alias("high"), F.when(F.col("b") > F.col("a"), "up").when(F.col("b") < F.col("a"), "down").otherwise("flat").alias("trend"))


def k8_audit(spark, folder):
    return L.audit(panel(spark, folder)).withColumn("isolated_pct", _r("isolated_pct"))


def w1_forward_gap(spark, folder):
    rows = P.with_forward_outcome(panel(spark, folder).select("feature_id", "ticker", "year", "quarter", "eps_ttm"), value="eps_ttm")
    return rows.select("feature_id", "eps_next_q", _r("eps_growth_next_q").alias("eps_growth_next_q"))


def w2_lag(spark, folder):
    rows = _sample(spark, folder)
    both = P.with_previous(P.with_previous(rows, "growth_w", "plain"), "growth_w", "guarded", guard=True)
    return both.select("feature_id", _r("plain").alias("plain"), _r("guarded").alias("guarded"))


def w2_lead_lag(spark, folder):
    rows = L.lead_lag(_zs(spark, folder))
    return rows.select(_r("r_current").alias("r_current"), "n_current", _r("r_next").alias("r_next"), "n_next")


def w3_momentum(spark, folder):
    return P.with_momentum(_section(spark, folder), "density").select("feature_id", _r("momentum").alias("momentum"))


def w4_zscore(spark, folder):
    return P.standardize(_section(spark, folder), {"density": "z"}, "ticker").select("feature_id", _r("z").alias("z"))


def _latest(spark, folder):
    return P.latest_signals(_section(spark, folder), "density")


def w5_latest(spark, folder):
    rows = _latest(spark, folder)
    return rows.select("ticker", "company", "quarter", "quarters_behind", "n_history", *(_r(c).alias(c) for c in ("density_qa", "density_z", "density_pctile", "change_vs_prev_call")))


def _companies(documents: DataFrame) -> DataFrame:
    return documents.select("ticker", "name", F.size("quarters").cast("bigint").alias("n_quarters"), "r", "latestLabel", "latestZ")


def w6_companies(spark, folder):
    """Companies of the panel alone, like its SQL; w6_companies_recent has the recent quarters as well."""
    return _companies(L.company_documents(panel(spark, folder), least_tokens=_LEAST))


def w6_companies_recent(spark, folder):
    """Companies with their calibrated recent quarters."""
    return _companies(L.company_documents(panel(spark, folder), recent_signals(spark, folder), least_tokens=_LEAST))


def w11_segments(spark, folder):
    return P.segments(panel(spark, folder), "eps_ttm_growth_next_q").select("feature_id", "segment")


def w12_growth_from_previous(spark, folder):
    """Growth from the row before; a growth of nothing counts as missing."""
    rows = P.with_previous(panel(spark, folder), "eps_ttm", "before")
    growth = F.nullif(F.try_divide(F.col("eps_ttm") - F.col("before"), F.nullif("before", F.lit(0.0))) * 100, F.lit(0.0))
    return rows.select("feature_id", _r(growth).alias("growth"))


def o2_sorted_signals(spark, folder):
    return w5_latest(spark, folder).orderBy(F.col("density_z").desc_nulls_last(), "ticker")


def o3_top_bottom(spark, folder):
    rows = P.fresh(w5_latest(spark, folder), 8).select("ticker", "density_z", "quarters_behind")
    top = rows.orderBy(F.col("density_z").desc(), "ticker").limit(10).withColumn("end", F.lit("top"))
    return top.unionByName(rows.orderBy("density_z", "ticker").limit(5).withColumn("end", F.lit("bottom")))


def _watchlist(companies: DataFrame) -> DataFrame:
    rows = companies.where("latestZ is not null").orderBy(F.col("latestZ").desc(), "ticker").limit(10)
    return rows.select("ticker", "latestZ", F.when(F.col("latestZ") >= 1, "high").when(F.col("latestZ") <= -1, "low").otherwise("mid").alias("colour"))


def o4_watchlist(spark, folder):
    return _watchlist(w6_companies(spark, folder))


def o4_watchlist_recent(spark, folder):
    return _watchlist(w6_companies_recent(spark, folder))


def u1_append(spark, folder):
    rows = panel(spark, folder).select("ticker", "year", "quarter", "eps_ttm")
    recent = table(spark, folder, "recent_corpus").select("ticker", F.lit(2030).alias("year"), F.lit(1).alias("quarter"))
    return P.append_recent(rows, recent).groupBy("ticker").agg(F.count("*").alias("n"), F.count("eps_ttm").alias("n_eps"))


def u2_distinct_calls(spark, folder):
    return table(spark, folder, "tech_uncertainty_features").select("ticker", "datacqtr", F.col("year").cast("bigint").alias("year"), F.col("quarter").cast("bigint").alias("quarter"), "earnings_date").dropDuplicates()


def j2_overlap(spark, folder):
    left = panel(spark, folder).select("ticker", "datacqtr", "uncertainty_density_qa")
    calls = table(spark, folder, "corpus").select("ticker", "datacqtr", "corpus_id")
    return calls.join(left, ["ticker", "datacqtr"]).select("corpus_id", _r("uncertainty_density_qa").alias("density"))


def j3_last_quarter_lookup(spark, folder):
    last = a2_last_quarter(spark, folder)
    return table(spark, folder, "recent_corpus").select("recent_id", "ticker").join(last, "ticker", "left").select("recent_id", "last_q")


def j5_known_tickers(spark, folder):
    return table(spark, folder, "recent_corpus").join(panel(spark, folder).select("ticker").distinct(), "ticker", "left_semi").select("recent_id", "ticker")


def _search(companies: DataFrame) -> DataFrame:
    return companies.where(contains_query(["ticker", "name"], " holdings ")).select("ticker", F.col("name"), escape_html("name").alias("shown")).orderBy("ticker").limit(72)


def x1_search(spark, folder):
    return _search(w6_companies(spark, folder))


def x1_search_recent(spark, folder):
    return _search(w6_companies_recent(spark, folder))


def _lookup(companies: DataFrame) -> DataFrame:
    return companies.where("ticker = 'ZANNO'").select("ticker", "n_quarters").limit(1)


def x3_lookup(spark, folder):
    return _lookup(w6_companies(spark, folder))


def x3_lookup_recent(spark, folder):
    return _lookup(w6_companies_recent(spark, folder))


def x4_axis(spark, folder):
    rows = _section(spark, folder).groupBy("ticker")
    return rows.agg(
        _r(F.greatest(F.max("density"), F.lit(1.0)) * 1.12).alias("top"), _r(F.greatest(F.max("eps_ttm_growth_next_q"), F.lit(5.0))).alias("eps_high"), _r(F.least(F.min("eps_ttm_growth_next_q"), F.lit(-4.0))).alias("eps_low"),
    )


def x5_ticks(spark, folder):
    return P.thinned(panel(spark, folder)).select("feature_id")


def x7_header(spark, folder):
    rows = L.panel_stats(panel(spark, folder), _LEAST)
    low, high = F.least(F.abs("coefLow"), F.abs("coefHigh")), F.greatest(F.abs("coefLow"), F.abs("coefHigh"))
    return rows.select("n", F.concat(F.format_string("%.2f", low * F.signum("coefLow")), F.lit(" to "), F.format_string("%.2f", high * F.signum("coefHigh"))).alias("range"), "p")


def _bars(companies: DataFrame) -> DataFrame:
    """Width of a watchlist bar, held within nought and one."""
    return companies.where("latestZ is not null").select("ticker", clip(F.col("latestZ") / 4 + 0.5, F.lit(0.0), F.lit(1.0)).alias("width"))


def x2_bars(spark, folder):
    return _bars(w6_companies(spark, folder))


def x2_bars_recent(spark, folder):
    return _bars(w6_companies_recent(spark, folder))


def k5_explorer_json(spark, folder):
    """The page's document, with the calibrated recent quarters."""
    stats = L.panel_stats(panel(spark, folder), _LEAST)
    return L.explorer_document(stats, L.company_documents(panel(spark, folder), recent_signals(spark, folder), least_tokens=_LEAST))


def s2_feature_build(spark, folder):
    """The whole build: corpus to features."""
    return L.build_features(table(spark, folder, "corpus"), loaded_lexicons(spark), F.lit(True))


def s8_inspect(spark, folder):
    return more.inspected(table(spark, folder, "tech_uncertainty_features")).select("column", "type", "rows", "filled")


def a14_robustness(spark, folder):
    return _rounded(L.robustness(panel(spark, folder), _LEAST))


_PANEL = "panel as (select * from (select *, row_number() over (partition by ticker, year, quarter order by feature_id) as rn, year::bigint * 4 + quarter - 1 as q from tech_uncertainty_features where ticker is not null and year is not null and quarter is not null) where rn = 1)"
_SEC = f"{_PANEL}, sec as (select *, uncertainty_density_qa as density from panel where qa_isolated and total_tokens_qa >= {_LEAST})"
_GRO = f"{_SEC}, base as (select * from sec where eps_ttm_growth_next_q is not null), edge as (select quantile_cont(eps_ttm_growth_next_q, 0.01) as lo, quantile_cont(eps_ttm_growth_next_q, 0.99) as hi from base), gro as (select base.*, greatest(lo, least(hi, eps_ttm_growth_next_q)) as growth_w from base, edge)"
_Z = f"{_GRO}, zs as (select * from (select *, (density - avg(density) over (partition by ticker)) / nullif(stddev_pop(density) over (partition by ticker), 0) as density_z from gro) where density_z is not null)"
_CORR = "case when stddev_pop({0}) = 0 or stddev_pop({1}) = 0 then null else corr({0}, {1}) end"
_FIT = "cells as (select {by} ticker, count(*)::double as n, covar_pop({x}, {y}) * count(*) as xy, var_pop({x}) * count(*) as xx from {src} group by all), fit as (select {by} sum(xy) / nullif(sum(xx), 0) as beta, sum(xx) as sxx, sum(n) as n, count(*)::double as g from cells group by all), meat as (select {cby} any_value(beta) as beta, any_value(sxx) as sxx, any_value(fit.n) as n, any_value(fit.g) as g, sum((xy - beta * xx) * (xy - beta * xx)) as m from cells join fit {on} group by all), done as (select *, sqrt(g / nullif(g - 1, 0) * (n - 1) / nullif(n - 1 - g, 0) * m) / sxx as se from meat)"
_LATEST = f"{_SEC}, h as (select *, row_number() over (partition by ticker order by q desc) as back, count(*) over w as n_history, avg(density) over w as mu, stddev_pop(density) over w as sd, lag(density) over (partition by ticker order by q) as prev, max(q) over () as newest, first_value(density) over (partition by ticker order by q desc) as last_d from sec window w as (partition by ticker order by q rows between unbounded preceding and 1 preceding)), below as (select ticker, count(*) filter (where density < last_d and back > 1) as b from h group by ticker), lat as (select h.ticker, company, datacqtr as quarter, newest - q as quarters_behind, n_history, round(density, 6) as density_qa, round((density - mu) / sd, 6) as density_z, round(b::double / n_history * 100, 6) as density_pctile, round(density - prev, 6) as change_vs_prev_call from h join below using (ticker) where back = 1 and n_history >= 12 and sd <> 0)"
_WEB = f"{_SEC}, e as (select quantile_cont(eps_ttm_growth_next_q, 0.01) as lo, quantile_cont(eps_ttm_growth_next_q, 0.99) as hi from sec), w as (select sec.*, case when eps_ttm_growth_next_q is not null then greatest(lo, least(hi, eps_ttm_growth_next_q)) end as eps_w, round(density, 2) as d2 from sec, e), r as (select *, row_number() over (partition by ticker order by q desc) as back from w), p as (select ticker, avg(d2) filter (where back > 1) as mu, stddev_pop(d2) filter (where back > 1) as sd, count(*) as n, max_by(company, q) filter (where company is not null) as name, max_by(d2, q) as last_d, count(eps_w) as np, case when stddev_pop(density) filter (where eps_w is not null) = 0 or stddev_pop(eps_w) = 0 then null else corr(density, eps_w) end as c, max_by('Q' || quarter || ' ''' || lpad((year % 100)::varchar, 2, '0'), q) as lbl from r group by ticker), web as (select ticker, name, n as n_quarters, case when np >= 12 then round(c, 2) end as r, lbl as \"latestLabel\", case when n > 12 and sd > 0 then round((last_d - mu) / sd, 2) end as \"latestZ\" from p)"
_NAT = "nat as (select n_name as ticker, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::bigint as q, sum(o_totalprice) as x, count(*)::double as y from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"

_CTRL = f"{_Z}, c0 as (select *, " + ", ".join(f"({c}_density_qa - avg({c}_density_qa) over (partition by ticker)) / nullif(stddev_pop({c}_density_qa) over (partition by ticker), 0) as {c}_z" for c in L.CONTROLS) + " from zs), ctrl as (select * from c0 where " + " and ".join(f"{c}_z is not null" for c in L.CONTROLS) + ")"
_MOM = f"{_CTRL}, mo as (select *, case when q - lag(q) over w = 1 then density_z - lag(density_z) over w end as momentum from ctrl window w as (partition by ticker order by q))"
_MODELS = {c: ["density_z", f"{c}_z"] for c in L.CONTROLS} | {"joint": ["density_z", *(f"{c}_z" for c in L.CONTROLS)]}
_ROUND = ", ".join(f"round({c}, 4) as {c}" for c in ("coef", "se", "t", "p", "r2_within"))
_ROBUST = f"{_SEC}, z0 as (select *, (density - avg(density) over (partition by ticker)) / nullif(stddev_pop(density) over (partition by ticker), 0) as density_z, (eps_ttm_next_q - eps_ttm) / nullif(abs(eps_ttm) / 4, 0) * 100 as yoy from sec), z1 as (select * from z0 where density_z is not null), " + ", ".join(f"e{k} as (select quantile_cont({o}, 0.01) as lo, quantile_cont({o}, 0.99) as hi from z1), w{k} as (select z1.*, greatest(lo, least(hi, {o})) as out_w from z1, e{k} where {o} is not null)" for k, o in enumerate(("eps_ttm_growth_next_q", "yoy")))


def _controls_sql(time: str | None) -> str:
    fits = ", ".join(Q.fit(f"f_{name}", "ctrl", "growth_w", xs, "ticker", time) for name, xs in _MODELS.items())
    return f"with recursive {_CTRL}, {fits} " + " union all ".join(f"select '{name}' as controls, term, n, entities, {_ROUND} from f_{name}" for name in _MODELS)


def _robust_sql() -> str:
    fits, ends = [], []
    for k, o in enumerate(("eps_ttm_growth_next_q", "yoy")):
        for spec, time in (("entity", None), ("entity+time", "datacqtr")):
            name = f"f{k}{'t' if time else ''}"
            fits.append(Q.fit(name, f"w{k}", "out_w", ["density_z"], "ticker", time))
            ends.append(f"select '{o}' as outcome, '{spec}' as spec, n, {_ROUND} from {name}")
    return f"with recursive {_ROBUST}, {', '.join(fits)} " + " union all ".join(ends)


_X7 = (
    f"with recursive {_Z}, {Q.fit('f1', 'zs', 'growth_w', ['density_z'], 'ticker')}, {Q.fit('f2', 'zs', 'growth_w', ['density_z'], 'ticker', 'datacqtr')}, h as (select f1.n, round(f2.coef, 2) as lo, round(f1.coef, 2) as hi, f2.p from f1, f2) "
    "select n, printf('%.2f', least(abs(lo), abs(hi)) * sign(lo)) || ' to ' || printf('%.2f', greatest(abs(lo), abs(hi)) * sign(hi)) as range, case when p < 0.001 then '< 0.001' when p < 0.01 then '< 0.01' when p < 0.02 then '< 0.02' when p < 0.05 then '< 0.05' else '= ' || printf('%.2f', p) end as p from h"
)

QUERIES = {name: f for name, f in globals().items() if re.match(r"(?:pr|[ajkosuwx])\d+_", name)}
ORACLE = {
    "pr15_rounded": f"with {_PANEL} select feature_id, printf('%.2f', uncertainty_density_qa)::double as density_2 from panel",
    "a6_correlations": f"with {_GRO}, rk as (select *, rank() over (partition by ticker order by density) + (count(*) over (partition by ticker, density) - 1) / 2.0 as rx, rank() over (partition by ticker order by eps_ttm_growth_next_q) + (count(*) over (partition by ticker, eps_ttm_growth_next_q) - 1) / 2.0 as ry from gro where density is not null), c as (select ticker, count(*) as n, {_CORR.format('density', 'growth_w')} as r, {_CORR.format('rx', 'ry')} as rho, avg(eps_ttm_growth_next_q) as m, quantile_cont(eps_ttm_growth_next_q, 0.5) as med from rk group by ticker having count(*) >= 12) select ticker, n as n_quarters, round(r, 6) as pearson_r, round({Q.correlation_tail('r', 'n')}, 6) as pearson_p, round(rho, 6) as spearman_rho, round({Q.correlation_tail('rho', 'n')}, 6) as spearman_p, round(m, 6) as mean_growth, round(med, 6) as median_growth from c",
    "a14_two_way_unbalanced": f"with recursive {_Z}, {Q.fit('f', 'zs', 'growth_w', ['density_z'], 'ticker', 'datacqtr')} select term, n, entities, {_ROUND} from f",
    "a15_controls": _controls_sql(None),
    "a15_controls_two_way": _controls_sql("datacqtr"),
    "a15_momentum": f"with recursive {_MOM}, {Q.fit('f', 'mo', 'growth_w', ['density_z', 'momentum'], 'ticker')} select term, n, entities, {_ROUND} from f",
    "a15_momentum_two_way": f"with recursive {_MOM}, {Q.fit('f', 'mo', 'growth_w', ['density_z', 'momentum'], 'ticker', 'datacqtr')} select term, n, entities, {_ROUND} from f",
    "a14_robustness": _robust_sql(),
    "x7_header": _X7,
    "pr1_universe": "select feature_id, ticker, sector from tech_uncertainty_features where coalesce(sector in ('Information Technology', 'Energy'), false) or coalesce(ticker in ('ZANNO', 'ZJJMT'), false)",
    "pr2_keys_present": "select corpus_id, year::bigint as year, quarter::bigint as quarter from corpus where ticker is not null and year is not null and quarter is not null",
    "pr6_sample": f"with {_GRO} select feature_id, ticker, total_tokens_qa from gro",
    "pr7_quarter_axis": f"with {_PANEL} select feature_id, q as qidx, year || 'Q' || quarter as key, 'Q' || quarter || ' ''' || lpad((year % 100)::varchar, 2, '0') as label from panel",
    "pr9_winsorize": f"with {_GRO} select feature_id, round(growth_w, 6) as growth_w from gro",
    "pr9_winsorize_by_sector": f"with {_PANEL}, e as (select sector, quantile_cont(eps_ttm_growth_next_q, 0.01) as lo, quantile_cont(eps_ttm_growth_next_q, 0.99) as hi from panel where sector is not null group by sector) select feature_id, case when eps_ttm_growth_next_q is not null then round(greatest(lo, least(hi, eps_ttm_growth_next_q)), 6) end as w from panel join e using (sector)",
    "pr13_strictly_newer": f"with {_PANEL}, last as (select ticker, max(q) as lq from panel where year < 2020 group by ticker) select feature_id, ticker, year::bigint as year from panel join last using (ticker) where q > lq",
    "pr14_bucket": f"with {_PANEL}, p as (select feature_id, uncertainty_density_qa / 100 as p from panel) select feature_id, case when p < 0.001 then '< 0.001' when p < 0.01 then '< 0.01' when p < 0.02 then '< 0.02' when p < 0.05 then '< 0.05' when p is not null then '= ' || printf('%.2f', p) end as bucket from p",
    "pr18_tagged": f"with {_PANEL} select feature_id, true as qa_isolated, 'panel' as source from panel",
    "pr19_innovation": f"with {_PANEL} select feature_id, round((eps_ttm_next_q - eps_ttm) / nullif(abs(eps_ttm) / 4, 0) * 100, 6) as yoy from panel",
    "a1_summary": f"with {_PANEL} select count(*) as n_rows, count(distinct ticker) as n_tickers, min(year)::bigint as first_year, max(year)::bigint as last_year from panel",
    "a2_last_quarter": f"with {_PANEL} select ticker, max(q) as last_q from panel group by ticker",
    "a3_mean_median": f"with {_GRO} select ticker, count(*) as n, round(avg(eps_ttm_growth_next_q), 6) as mean_growth, round(quantile_cont(eps_ttm_growth_next_q, 0.5), 6) as median_growth from gro group by ticker having count(*) >= 12",
    "a6_pearson": f"with {_GRO} select ticker, count(*) as n, round({_CORR.format('density', 'growth_w')}, 6) as r from gro group by ticker having count(*) >= 12",
    "a7_spearman": f"with {_GRO}, rk as (select ticker, rank() over (partition by ticker order by density) + (count(*) over (partition by ticker, density) - 1) / 2.0 as rx, rank() over (partition by ticker order by eps_ttm_growth_next_q) + (count(*) over (partition by ticker, eps_ttm_growth_next_q) - 1) / 2.0 as ry from gro where density is not null) select ticker, round({_CORR.format('rx', 'ry')}, 6) as rho from rk group by ticker having count(*) >= 12",
    "a8_deviation": f"with {_SEC} select ticker, round(stddev_pop(density), 6) as sd from sec group by ticker",
    "a10_conditional_counts": f"with {_GRO}, c as (select ticker, {_CORR.format('density', 'growth_w')} as r from gro group by ticker having count(*) >= 12) select count(*) as n, count(*) filter (where r > 0) as positive, count(*) filter (where r < -0.2) as below from c",
    "a11_histogram": f"with {_PANEL} select year || 'Q' || quarter as key, count(*) as n from panel group by 1 order by 1 desc limit 6",
    "a12_calibration": f"with {_PANEL} select regr_count(negative_density_qa, uncertainty_density_qa) as n, round(regr_slope(negative_density_qa, uncertainty_density_qa), 6) as slope, round(regr_intercept(negative_density_qa, uncertainty_density_qa), 6) as intercept, round(corr(negative_density_qa, uncertainty_density_qa), 6) as corr from panel",
    "a13_one_way": f"with {_Z}, {_FIT.format(by='', cby='', x='density_z', y='growth_w', src='zs', on='on true')} select n::bigint as n, g::bigint as entities, round(beta, 6) as beta, round(se, 6) as se, round(beta / se, 6) as t from done",
    "a13_by_sector": f"with {_SEC}, b as (select * from sec where eps_ttm_growth_next_q is not null and sector is not null), e as (select sector, quantile_cont(eps_ttm_growth_next_q, 0.01) as lo, quantile_cont(eps_ttm_growth_next_q, 0.99) as hi from b group by sector), g as (select b.*, greatest(lo, least(hi, eps_ttm_growth_next_q)) as growth_w, (density - avg(density) over (partition by ticker)) / nullif(stddev_pop(density) over (partition by ticker), 0) as density_z from b join e using (sector)), zs as (select * from g where density_z is not null), {_FIT.format(by='sector,', cby='cells.sector,', x='density_z', y='growth_w', src='zs', on='on cells.sector = fit.sector')} select sector, n::bigint as n, g::bigint as tickers, round(beta, 6) as beta_pp, round(beta / se, 6) as t from done where n >= 20 and g >= 2",
    "a14_two_way": f"with recursive {_NAT}, {Q.fit('f', 'nat', 'y', ['x'], 'ticker', 'q')} select n, entities, round(coef * 1e6, 5) as coef_e6, round(se * 1e6, 5) as se_e6 from f",
    "a16_within_r2": f"with {_Z}, c as (select ticker, covar_pop(density_z, growth_w) * count(*) as xy, var_pop(density_z) * count(*) as xx, var_pop(growth_w) * count(*) as yy from zs group by ticker) select round(sum(xy) * sum(xy) / (sum(xx) * sum(yy)), 8) as r2_within from c",
    "a17_control_correlations": f"with {_Z}, c as (select density_z, "
    + ", ".join(f"({c}_density_qa - avg({c}_density_qa) over (partition by ticker)) / nullif(stddev_pop({c}_density_qa) over (partition by ticker), 0) as {c}_z" for c in L.CONTROLS)
    + " from zs), f as (select * from c where "
    + " and ".join(f"{c}_z is not null" for c in L.CONTROLS)
    + ") select "
    + ", ".join(f"round(corr(density_z, {c}_z), 6) as {c}" for c in L.CONTROLS)
    + " from f",
    "a18_median_split": f"with {_GRO}, c as (select ticker, {_CORR.format('density', 'growth_w')} as r, round(quantile_cont(eps_ttm_growth_next_q, 0.5), 6) as m from gro group by ticker having count(*) >= 12), k as (select quantile_cont(m, 0.5) as mid from c) select round(avg(r) filter (where m >= mid), 5) as mean_high, round(avg(r) filter (where m < mid), 5) as mean_low from c, k",
    "a19_longest": "select corpus_id, ticker, length(transcript) as n_chars from (select *, row_number() over (partition by ticker, year, quarter order by coalesce(length(transcript), -1) desc, corpus_id) as rn from corpus where ticker is not null and year is not null and quarter is not null) where rn = 1",
    "a21_trend": f"with {_SEC}, t as (select ticker, round(avg(density), 6) as mean, round(min(density), 6) as low, round(max(density), 6) as high, min_by(density, q) as a, max_by(density, q) as b from sec group by ticker) select ticker, mean, low, high, case when b > a then 'up' when b < a then 'down' else 'flat' end as trend from t",
    "k8_audit": f"with {_PANEL} select count(*) as n_rows, count(distinct ticker) as n_tickers, min(year)::bigint as first_year, max(year)::bigint as last_year, count(*) filter (where qa_isolated) as n_isolated, round(avg(qa_isolated::int::double) * 100, 6) as isolated_pct, sum(negation_excluded_full)::bigint as suppressed, count(eps_ttm_next_q) as n_outcome, max(q) as newest from panel",
    "w1_forward_gap": f"with {_PANEL}, f as (select feature_id, eps_ttm, case when lead(q) over w - q = 1 then lead(eps_ttm) over w end as nx from panel window w as (partition by ticker order by q)) select feature_id, nx as eps_next_q, round((nx - eps_ttm) / nullif(abs(eps_ttm), 0) * 100, 6) as eps_growth_next_q from f",
    "w2_lag": f"with {_GRO} select feature_id, round(lag(growth_w) over w, 6) as plain, case when q - lag(q) over w = 1 then round(lag(growth_w) over w, 6) end as guarded from gro window w as (partition by ticker order by q)",
    "w2_lead_lag": f"with {_Z}, l as (select *, lag(growth_w) over (partition by ticker order by q) as g0 from zs) select round(corr(density_z, g0), 6) as r_current, count(g0) as n_current, round(corr(density_z, growth_w), 6) as r_next, count(*) as n_next from l",
    "w3_momentum": f"with {_SEC} select feature_id, case when q - lag(q) over w = 1 then round(density - lag(density) over w, 6) end as momentum from sec window w as (partition by ticker order by q)",
    "w4_zscore": f"with {_SEC} select feature_id, round((density - avg(density) over (partition by ticker)) / nullif(stddev_pop(density) over (partition by ticker), 0), 6) as z from sec",
    "w5_latest": f"with {_LATEST} select * from lat",
    "o2_sorted_signals": f"with {_LATEST} select * from lat order by density_z desc, ticker",
    "o3_top_bottom": f"with {_LATEST}, f as (select ticker, density_z, quarters_behind from lat where quarters_behind <= 8) (select *, 'top' as end from f order by density_z desc, ticker limit 10) union all (select *, 'bottom' as end from f order by density_z, ticker limit 5)",
    "w6_companies": f"with {_WEB} select * from web",
    "o4_watchlist": f"with {_WEB} select ticker, \"latestZ\", case when \"latestZ\" >= 1 then 'high' when \"latestZ\" <= -1 then 'low' else 'mid' end as colour from web where \"latestZ\" is not null order by \"latestZ\" desc, ticker limit 10",
    "x2_bars": f"with {_WEB} select ticker, greatest(0.0, least(1.0, \"latestZ\" / 4 + 0.5)) as width from web where \"latestZ\" is not null",
    "x1_search": f"with {_WEB} select ticker, name, replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as shown from web where contains(upper(ticker), 'HOLDINGS') or contains(upper(name), 'HOLDINGS') order by ticker limit 72",
    "x3_lookup": f"with {_WEB} select ticker, n_quarters from web where ticker = 'ZANNO'",
    "x4_axis": f"with {_SEC} select ticker, round(greatest(max(density), 1.0) * 1.12, 6) as top, round(greatest(max(eps_ttm_growth_next_q), 5.0), 6) as eps_high, round(least(min(eps_ttm_growth_next_q), -4.0), 6) as eps_low from sec group by ticker",
    "x5_ticks": f"with {_PANEL}, t as (select feature_id, row_number() over (partition by ticker order by q) - 1 as i, count(*) over (partition by ticker) as n from panel) select feature_id from t where i % ceil(n / 7.0)::bigint = 0",
    "w11_segments": f"with {_PANEL} select feature_id, case when eps_ttm_growth_next_q is not null then sum((eps_ttm_growth_next_q is null)::int) over (partition by ticker order by q rows unbounded preceding)::bigint end as segment from panel",
    "w12_growth_from_previous": f"with {_PANEL}, p as (select feature_id, eps_ttm, lag(eps_ttm) over (partition by ticker order by q) as b from panel) select feature_id, round(nullif((eps_ttm - b) / nullif(b, 0) * 100, 0), 6) as growth from p",
    "u1_append": f"with {_PANEL}, a as (select ticker, eps_ttm from panel union all select ticker, null from recent_corpus where ticker in (select ticker from panel)) select ticker, count(*) as n, count(eps_ttm) as n_eps from a group by ticker",
    "u2_distinct_calls": "select distinct ticker, datacqtr, year::bigint as year, quarter::bigint as quarter, earnings_date from tech_uncertainty_features",
    "j2_overlap": f"with {_PANEL} select c.corpus_id, round(uncertainty_density_qa, 6) as density from corpus c join panel p on c.ticker = p.ticker and c.datacqtr = p.datacqtr",
    "j3_last_quarter_lookup": f"with {_PANEL}, l as (select ticker, max(q) as last_q from panel group by ticker) select recent_id, last_q from recent_corpus r left join l on r.ticker = l.ticker",
    "j5_known_tickers": f"with {_PANEL} select recent_id, ticker from recent_corpus where ticker in (select ticker from panel)",
}
