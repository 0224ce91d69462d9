import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterloom.functions import scalars as C
from quarterloom.functions import special as SP
from quarterloom.operators import panel as P
from quarterloom.operators import returns as R
from quarterloom.operators import stats as S

SCHEMA = "ticker string, year int, quarter int, eps double"


def forward(spark, rows):
    out = P.with_forward_outcome(spark.createDataFrame(rows, SCHEMA)).orderBy("ticker", "year", "quarter").collect()
    return [(r.eps_next_q, r.eps_growth_next_q) for r in out]


def test_forward_outcome(spark):
    assert forward(spark, [("AAPL", 2023, 2, 1.5), ("AAPL", 2023, 1, 1.0), ("AAPL", 2023, 3, 1.2)])[0] == (1.5, 50.0)
    assert [a for a, _ in forward(spark, [("MSFT", 2022, 4, 2.0), ("MSFT", 2023, 1, 2.2)])] == [2.2, None]
    assert forward(spark, [("NVDA", 2023, 1, 1.0), ("NVDA", 2023, 3, 4.0)]) == [(None, None)] * 2
    assert forward(spark, [("AAPL", 2023, 1, 1.0), ("MSFT", 2023, 2, 9.0)]) == [(None, None)] * 2
    assert forward(spark, [("INTC", 2023, 1, -1.0), ("INTC", 2023, 2, -0.5)])[0] == (-0.5, 50.0)
    assert forward(spark, [("AMD", 2023, 1, 0.0), ("AMD", 2023, 2, 0.3)])[0] == (0.3, None)
    assert forward(spark, [(None, 2023, 1, 1.0), ("A", 2023, 1, None), ("A", 2023, 2, 1.0)]) == [(1.0, None), (None, None)]


def test_winsorize_like_numpy(spark):
    x = np.random.default_rng(1).normal(size=300)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = [r.w for r in P.winsorize(df, "v", "w").collect()]
    lo, hi = np.quantile(x, [0.01, 0.99])
    assert None in got
    np.testing.assert_allclose(sorted(v for v in got if v is not None), np.sort(np.clip(x, lo, hi)), rtol=1e-12)


def test_universe_and_sample(spark):
    df = spark.createDataFrame([("A", "Information Technology"), ("META", None), (None, "Energy"), ("B", None)], "ticker string, sector string")
    assert [r[0] for r in df.select(P.universe()).collect()] == [True, True, False, False]


def test_keep_best_and_longest(spark):
    rows = [(1, "A", 2020, 1, "xx"), (2, "A", 2020, 1, "xxx"), (3, "A", 2020, 1, "yyy"), (4, None, 2020, 1, "z"), (5, "B", 2020, 1, None)]
    df = spark.createDataFrame(rows, "id bigint, ticker string, year int, quarter int, text string")
    assert sorted((r.id, r.n_chars) for r in P.longest_text(df, ["ticker", "year", "quarter"], "text", "id").collect()) == [(2, 3), (5, None)]
    assert sorted(r.id for r in P.keep_best(df, ["ticker", "year", "quarter"], [-F.col("id")]).collect()) == [1, 5]
    assert P.keep_best(df.limit(0), ["ticker"], [F.col("id")]).count() == 0


def test_latest_signal(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(3, 1, 14)
    rows = [("A", "Co", 2010 + k // 4, k % 4 + 1, f"{2010 + k // 4}Q{k % 4 + 1}", "d", float(v)) for k, v in enumerate(d)]
    rows += [("B", "Co", 2010, 1, "2010Q1", "d", 1.0)] + [("C", "Co", 2010 + k // 4, k % 4 + 1, "q", "d", 2.0) for k in range(15)]
    df = spark.createDataFrame(rows, "ticker string, company string, year int, quarter int, datacqtr string, earnings_date string, density double")
    got = P.latest_signals(df, "density").collect()
    assert [r.ticker for r in got] == ["A"]
    h = d[:-1]
    assert got[0].density_z == pytest.approx((d[-1] - h.mean()) / h.std())
    assert got[0].density_pctile == pytest.approx((h < d[-1]).mean() * 100)
    assert got[0].change_vs_prev_call == pytest.approx(d[-1] - d[-2]) and got[0].n_history == 13 and got[0].quarters_behind == 1


def test_returns(spark):
    days = ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11"]
    prices = spark.createDataFrame([("T", d, 100.0 + 10 * k) for k, d in enumerate(days)] + [("Z", days[0], 0.0), ("Z", days[1], 10.0)], "ticker string, date string, close double")
    calls = spark.createDataFrame([(1, "T", "2024-01-02"), (2, "T", "2024-01-06"), (3, "T", "2024-01-10"), (4, "Z", "2024-01-02"), (5, "N", "2024-01-02"), (6, "T", "2025-01-01"), (1, "T", "2024-01-02")], "id int, ticker string, d string")
    got = sorted((r.id, r.a, r.b) for r in R.with_forward_returns(calls, prices, "d", {"a": 3, "b": 1}).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 6]
    assert got[0][1] == pytest.approx(30.0) and got[2][2] == pytest.approx((150 / 140 - 1) * 100)
    assert got[3][1] is None and got[4][2] is None and got[5][1:] == (None, None)
    both = R.with_forward_returns(calls.where("id = 1"), prices, "d").first()
    assert both.ret_5d == pytest.approx(50.0) and both.ret_fwd_q is None


def test_sessions_take_latest_fetch(spark):
    p = spark.createDataFrame([("T", "2024-01-02", 1.0, 1), ("T", "2024-01-02", 2.0, 2), ("T", "2024-01-02", None, 3), (None, "2024-01-02", 1.0, 1)], "ticker string, date string, close double, at int")
    assert [tuple(r) for r in R.sessions(p, latest=["at"]).collect()] == [("T", "2024-01-02", 2.0)]


def test_p_values():
    assert SP.normal_two_sided(-3.155421644598449) == pytest.approx(0.00160266307902005, rel=1e-12)
    # Student's t with one and two degrees of freedom has closed forms.
    for r in (0.1, -0.5, 0.9):
        t = abs(r) / math.sqrt(1 - r * r)
        assert SP.correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-10)
        t *= math.sqrt(2)
        assert SP.correlation_p(r, 4) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
    assert SP.correlation_p(1.0, 10) == 0.0 and SP.correlation_p(0.5, 2) is None


def test_correlations(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, 40).astype(float), rng.normal(size=40)
    df = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(x, y)] + [("K", 1.0, float(b)) for b in y[:15]], "g string, x double, y double")
    got = {r.g: r for r in S.correlations(df, "g", "x", "y", "y").collect()}
    assert got["A"].pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1])
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got["A"].spearman_rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert got["A"].pearson_p == pytest.approx(SP.correlation_p(got["A"].pearson_r, 40)) and got["K"].pearson_r is None


def dummy_fit(y, xs, g, t=None):
    cols = [np.ones(len(y)), *xs] + [(g == v).astype(float) for v in np.unique(g)[1:]]
    if t is not None:
        cols += [(t == v).astype(float) for v in np.unique(t)[1:]]
    a = np.column_stack(cols)
    inv = np.linalg.inv(a.T @ a)
    b = inv @ a.T @ y
    u = y - a @ b
    meat = sum(np.outer(s, s) for s in (a[g == v].T @ u[g == v] for v in np.unique(g)))
    n, k, c = len(y), a.shape[1], len(np.unique(g))
    v = c / (c - 1) * (n - 1) / (n - k) * inv @ meat @ inv
    return b[1 : 1 + len(xs)], np.sqrt(np.diag(v))[1 : 1 + len(xs)]


@pytest.mark.parametrize("two_way", [False, True])
def test_fixed_effects_against_dummies(spark, two_way):
    rng = np.random.default_rng(4)
    g, t = rng.integers(0, 9, 260), rng.integers(0, 7, 260)
    x1, x2 = rng.normal(size=260) + g, rng.normal(size=260)
    y = 2 * x1 - x2 + g * 3 + t + rng.normal(size=260)
    df = spark.createDataFrame([(f"g{a}", int(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(g, t, x1, x2, y)] + [(None, 1, 1.0, 1.0, 1.0), ("g1", 1, None, 1.0, 1.0)], "g string, t int, x1 double, x2 double, y double")
    fit = S.fe_fit(df, "y", ["x1", "x2"], "g", "t" if two_way else None).collect()
    b, se = dummy_fit(y, [x1, x2], g, t if two_way else None)
    np.testing.assert_allclose([r.coef for r in fit], b, rtol=1e-9)
    np.testing.assert_allclose([r.se for r in fit], se, rtol=1e-8)
    if not two_way:
        one = S.slope_by(df, "y", "x1", "g").first()
        b1, se1 = dummy_fit(y, [x1], g)
        assert one.beta == pytest.approx(b1[0], rel=1e-6)
    assert S.fe_fit(df.limit(0), "y", ["x1"], "g").count() == 0


def test_slope_by_groups(spark):
    rng = np.random.default_rng(5)
    g, s = rng.integers(0, 8, 200), rng.integers(0, 2, 200)
    g = g * 2 + s
    x = rng.normal(size=200)
    y = x * (1 + s) + g + rng.normal(size=200)
    df = spark.createDataFrame([(f"s{c}", f"g{a}", float(b), float(d)) for c, a, b, d in zip(s, g, x, y)], "s string, g string, x double, y double")
    for r in S.slope_by(df, "y", "x", "g", ["s"]).collect():
        m = s == int(r.s[1])
        b, se = dummy_fit(y[m], [x[m]], g[m])
        assert r.beta == pytest.approx(b[0]) and r.se == pytest.approx(se[0]) and r.n == m.sum()


def test_calibration_and_split(spark):
    x = np.arange(10.0)
    df = spark.createDataFrame([(float(a), float(2 * a + 1)) for a in x] + [(None, 1.0), (1.0, None)], "x double, y double")
    r = S.calibration(df, "x", "y").first()
    assert (r.n, round(r.slope, 9), round(r.intercept, 9), round(r.corr, 9)) == (10, 2.0, 1.0, 1.0)
    k = S.median_split(df.dropna(), "y", "x").first()
    assert k.mean_high == pytest.approx(np.mean(2 * x[5:] + 1)) and k.mean_low == pytest.approx(np.mean(2 * x[:5] + 1))


def test_small_expressions(spark):
    df = spark.createDataFrame([(0.0005,), (0.015,), (0.03,), (0.07,), (None,)], "p double")
    assert [r[0] for r in df.select(C.p_bucket("p")).collect()] == ["< 0.001", "< 0.02", "< 0.05", "= 0.07", None]
    one = spark.range(1)
    assert one.select(C.quarter_label(F.lit(2024), F.lit(4))).first()[0] == "Q4 '24"
    assert one.select(C.round_exact(F.lit(2.675), F.lit(2))).first()[0] == 2.67
    assert one.select(C.escape_html(F.lit("<a & 'b'>"))).first()[0] == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one.select(C.strip(F.lit("\t a b \n"))).first()[0] == "a b"
    assert one.select(C.clip(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))).first()[0] is None
    assert one.select(C.contains_query([F.lit("Acme Corp"), F.lit(None).cast("string")], " acme ")).first()[0] is True


def test_islands_and_ticks(spark):
    rows = [("A", 2020 + k // 4, k % 4 + 1, None if k in (2, 5) else float(k)) for k in range(9)]
    df = spark.createDataFrame(rows, "ticker string, year int, quarter int, v double")
    got = [r.segment for r in P.segments(df, "v").orderBy("year", "quarter").collect()]
    assert got == [0, 0, None, 1, 1, None, 2, 2, 2]
    assert P.thinned(df).count() == 5


def test_quantiles_are_exact_at_any_size(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 400, 20_000):
        for values in (rng.normal(size=n), rng.integers(0, 5, n).astype(float), np.concatenate([np.zeros(n - n // 3), rng.normal(size=n // 3)])):
            df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
            got = P.bounds(df, "v").first()
            assert np.allclose([got.low, got.high], np.quantile(values, [0.01, 0.99]), rtol=0, atol=1e-12), n
    assert P.bounds(df.limit(0), "v").count() == 0
    assert P.winsorize(df.where("v is null"), "v", "w").first().w is None
