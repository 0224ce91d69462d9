"""Queries of prices and forward returns, of recent calls, and of the event stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.operators import returns as R
from quarterloom.operators.timestamps import with_norm
from quarterloom.plans import fit_sql as Q
from quarterloom.plans import pipelines as L
from quarterloom.plans.date_sql import dated
from quarterloom.plans.panel_queries import panel, recent_signals
from quarterloom.sources import more, table

_r = lambda c: F.round(c, 6)


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    return R.sessions(table(spark, folder, "prices"), latest=["fetched_at", "price_id"])


def _dated(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Rows with earnings_date as yyyy-MM-dd, whatever its notation; those without a meaningful day stay out. A moment counts by its UTC date."""
    feeds = table(spark, folder, "call_feeds").select("feed", F.col("home_zone").alias("__hz"), F.col("date_order").alias("__do"))
    known = with_norm(rows.join(feeds, "feed", "left"), "earnings_date", "__hz", "__do")
    day = F.regexp_extract("norm", r"^(\d{4}-\d{2}-\d{2})(?:T|$)", 1)
    return known.withColumn("earnings_date", F.nullif(day, F.lit(""))).where("earnings_date is not null").drop("feed", "__hz", "__do", "norm")


def _dated_calls(spark: SparkSession, folder: str) -> DataFrame:
    return _dated(spark, folder, table(spark, folder, "tech_uncertainty_features").select("feature_id", "ticker", "earnings_date", "feed"))


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Both returns of every call of the panel that has a meaningful day."""
    return L.price_outcomes(_dated(spark, folder, panel(spark, folder)), table(spark, folder, "prices"), "earnings_date")


def j6_forward_return(spark, folder):
    """The return five sessions on from the first session on or after each call with a meaningful day, in any notation."""
    rows = R.with_forward_returns(_dated_calls(spark, folder), _sessions(spark, folder), "earnings_date", {"ret_5d": 5})
    return rows.select("feature_id", _r("ret_5d").alias("ret_5d"))


def j7_two_horizons(spark, folder):
    """Both horizons of every such call."""
    rows = R.with_forward_returns(_dated_calls(spark, folder), _sessions(spark, folder), "earnings_date")
    return rows.select("feature_id", _r("ret_5d").alias("ret_5d"), _r("ret_fwd_q").alias("ret_fwd_q"))


def j8_sessions(spark, folder):
    """One close per ticker and day; the market-wide series is fetched many times a day."""
    return _sessions(spark, folder).groupBy("ticker").agg(F.count("*").alias("n_days"), _r(F.avg("close")).alias("mean_close"))


def j1_outcomes_and_density(spark, folder):
    """Returns beside densities, of every call of the panel with a meaningful day."""
    density = panel(spark, folder).select("ticker", "datacqtr", "uncertainty_density_qa")
    joined = _outcomes(spark, folder).join(density, ["ticker", "datacqtr"])
    return joined.select("ticker", "datacqtr", _r("ret_5d").alias("ret_5d"), _r("uncertainty_density_qa").alias("density"))


def a14_price_drift(spark, folder):
    """Returns over both horizons on density, each with entity effects and with both, of every call with a meaningful day."""
    fit = L.price_drifts(_outcomes(spark, folder), panel(spark, folder), least_tokens=300)
    return fit.withColumns({c: F.round(c, 4) for c in ("coef", "se", "t", "p", "r2_within")})


def s4_price_json(spark, folder):
    """Price responses as JSON lists and back into rows."""
    days = _sessions(spark, folder)
    bodies = days.groupBy("ticker", F.left("date", F.lit(7)).alias("month")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("date", F.col("close").alias("price"))), asc=False)).alias("body"))
    return more.price_rows(bodies).select("ticker", "date", _r("close").alias("close"))


def s2_recent_signals(spark, folder):
    """Recent calls with their dates brought to one form, scored and calibrated on the panel's scale."""
    return recent_signals(spark, folder)


def j6_event_returns(spark, folder):
    """The same as-of search on the event table: signups against a user's events in order."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("#"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("at"))
    calls = events.where("event_type = 'signup'").select("event_id", "user_id", "at")
    out = R.with_forward_returns(calls, events.select("user_id", "at", "value"), "at", {"ret_5": 5, "ret_63": 63}, "user_id", "at", "value")
    return out.select("event_id", _r("ret_5").alias("ret_5"), _r("ret_63").alias("ret_63"))


_SES = "ses as (select ticker, date, max_by(close, struct_pack(f := fetched_at, i := price_id)) as close from prices where close is not null and ticker is not null and date is not null group by ticker, date)"
_LEAD = f"{_SES}, ser as (select *, lead(close, 5) over w as c5, lead(close, 63) over w as c63 from ses window w as (partition by ticker order by date))"
_PANEL = "panel as (select * from (select *, row_number() over (partition by ticker, year, quarter order by feature_id) as rn from tech_uncertainty_features where ticker is not null and year is not null and quarter is not null) where rn = 1)"
_ASOF = "select c.*, case when s.close > 0 then round((c5 / s.close - 1) * 100, 6) end as ret_5d, case when s.close > 0 then round((c63 / s.close - 1) * 100, 6) end as ret_fwd_q from {calls} c asof left join ser s on c.ticker = s.ticker and c.earnings_date <= s.date where c.ticker in (select ticker from ser)"
_CALLS = dated("calls", "tech_uncertainty_features", "feature_id, ticker")
_DAYS = dated("days", "panel", "ticker, datacqtr, year, quarter")
_OUT = f"{_LEAD}, {_PANEL}, {_DAYS}, o as ({_ASOF.format(calls='(select distinct * from days)')})"


def _drift_sql() -> str:
    parts, ends = [], []
    for h in R.HORIZONS:
        parts.append(
            f"d_{h} as (select o.ticker, o.datacqtr, {h} as ret, (uncertainty_density_qa - avg(uncertainty_density_qa) over w) / nullif(stddev_pop(uncertainty_density_qa) over w, 0) as density_z from o_raw o join panel p on o.ticker = p.ticker and o.datacqtr = p.datacqtr where p.qa_isolated and p.total_tokens_qa >= 300 window w as (partition by o.ticker)), "
            f"b_{h} as (select * from d_{h} where density_z is not null and ret is not null), w_{h} as (select b.*, greatest(lo, least(hi, ret)) as ret_w from b_{h} b, (select quantile_cont(ret, 0.01) as lo, quantile_cont(ret, 0.99) as hi from b_{h}))"
        )
        for spec, time in (("entity", None), ("entity+time", "datacqtr")):
            name = f"f_{h}{'_t' if time else ''}"
            parts.append(Q.fit(name, f"w_{h}", "ret_w", ["density_z"], "ticker", time))
            ends.append(f"select '{h}' as outcome, '{spec}' as spec, n, " + ", ".join(f"round({c}, 4) as {c}" for c in ("coef", "se", "t", "p", "r2_within")) + f" from {name}")
    raw = _OUT.replace("round((c5 / s.close - 1) * 100, 6)", "(c5 / s.close - 1) * 100").replace("round((c63 / s.close - 1) * 100, 6)", "(c63 / s.close - 1) * 100").replace(", o as (", ", o_raw as (")
    return f"with recursive {raw}, {', '.join(parts)} " + " union all ".join(ends)


QUERIES = {name: f for name, f in globals().items() if re.match(r"(?:[ajs])\d+_", name)}
ORACLE = {
    "j6_forward_return": f"with {_LEAD}, {_CALLS} select feature_id, ret_5d from ({_ASOF.format(calls='calls')})",
    "j7_two_horizons": f"with {_LEAD}, {_CALLS} select feature_id, ret_5d, ret_fwd_q from ({_ASOF.format(calls='calls')})",
    "j8_sessions": f"with {_SES} select ticker, count(*) as n_days, round(avg(close), 6) as mean_close from ses group by ticker",
    "j1_outcomes_and_density": f"with {_OUT} select o.ticker, o.datacqtr, ret_5d, round(uncertainty_density_qa, 6) as density from o join panel p on o.ticker = p.ticker and o.datacqtr = p.datacqtr",
    "a14_price_drift": _drift_sql(),
    "s4_price_json": f"with {_SES} select ticker, date, round(close, 6) as close from ses",
    "j6_event_returns": "with ser as (select *, lead(value, 5) over w as c5, lead(value, 63) over w as c63 from events window w as (partition by user_id order by ts, event_id)) select event_id, case when value > 0 then round((c5 / value - 1) * 100, 6) end as ret_5, case when value > 0 then round((c63 / value - 1) * 100, 6) end as ret_63 from ser where event_type = 'signup'",
}
