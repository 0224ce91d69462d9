import json

from pyspark.sql import functions as F

from quarterloom.functions.scalars import quarter_index
from quarterloom.operators import stats as S
from quarterloom.plans import market_queries as M
from quarterloom.plans import panel_queries as PQ
from quarterloom.plans.panel_queries import panel


def test_recent_signals_take_the_whole_panel(spark, small, monkeypatch):
    overlaps = []
    fit = S.calibration
    monkeypatch.setattr(S, "calibration", lambda rows, *columns: overlaps.append(rows) or fit(rows, *columns))
    known = panel(spark, small)
    rows = M.s2_recent_signals(spark, small)
    last = known.groupBy("ticker").agg(F.max(quarter_index("year", "quarter")).alias("last"))
    joined = rows.join(last, "ticker")
    assert joined.count() == rows.count() > 0
    assert joined.where(quarter_index("year", "quarter") <= F.col("last")).count() == 0
    # The overlap reaches to the panel's end.
    assert overlaps[0].where("datacqtr >= '2023'").count() > 0


def test_returns_of_days_in_any_notation(spark, tmp_path):
    written = ["2024-01-03", "Jan. 3, 2024", "20240103", " 2024-01-03 ", "03-Jan-2024", "01/03/2024", "2024-01-03T15:00:00Z", "2024Q1", "", None, "n/a"]
    rows = [(k, f"T{k}", 2024, 1, "2024Q1", d, "f") for k, d in enumerate(written)]
    calls = spark.createDataFrame(rows, "feature_id bigint, ticker string, year int, quarter int, datacqtr string, earnings_date string, feed string")
    other = [c for c in PQ._FEATURES if c not in calls.columns]
    calls.select("*", *(F.lit(1.0).alias(c) for c in other)).write.parquet(str(tmp_path / "tech_uncertainty_features.parquet"))
    spark.createDataFrame([("f", "UTC", "MDY")], "feed string, home_zone string, date_order string").write.parquet(str(tmp_path / "call_feeds.parquet"))
    days = [f"2024-01-{d:02d}" for d in range(2, 12)]
    prices = [(f"T{k}", d, 100.0 + n, "x", 1) for k in range(len(written)) for n, d in enumerate(days)]
    spark.createDataFrame(prices, "ticker string, date string, close double, fetched_at string, price_id int").write.parquet(str(tmp_path / "prices.parquet"))
    want = round((106 / 101 - 1) * 100, 6)
    folder = str(tmp_path)
    assert sorted(tuple(r) for r in M.j6_forward_return(spark, folder).collect()) == [(k, want) for k in range(7)]
    assert sorted(tuple(r) for r in M.j7_two_horizons(spark, folder).collect()) == [(k, want, None) for k in range(7)]
    assert sorted(tuple(r) for r in M.j1_outcomes_and_density(spark, folder).collect()) == [(f"T{k}", "2024Q1", want, 1.0) for k in range(7)]


def test_price_drift_has_both_horizons_and_specifications(spark, small):
    got = {(r.outcome, r.spec): r.n for r in M.a14_price_drift(spark, small).collect()}
    assert set(got) == {(o, s) for o in ("ret_5d", "ret_fwd_q") for s in ("entity", "entity+time")} and got["ret_5d", "entity"] > 0


def test_companies_have_their_recent_quarters(spark, small):
    recent = {(r.ticker, quarter) for r in PQ.recent_signals(spark, small).collect() for quarter in [f"Q{r.quarter} '{r.year % 100:02d}"]}
    document = json.loads(PQ.k5_explorer_json(spark, small).first().document)
    shown = {c["ticker"]: [q["label"] for q in c["quarters"]] for c in document["companies"]}
    kept = {(t, q) for t, q in recent if t in shown}
    assert kept and all(q in shown[t] for t, q in kept)
    assert all((c["ticker"], c["latestLabel"]) in recent for c in document["companies"] if c["ticker"] in {t for t, _ in kept})
    assert {r.ticker: r.n_quarters for r in PQ.w6_companies_recent(spark, small).collect()} == {t: len(q) for t, q in shown.items()}
