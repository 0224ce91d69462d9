"""The analyses as functions from DataFrames to DataFrames. Thresholds are parameters with the usual values as defaults."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterloom.functions import text as X
from quarterloom.functions.scalars import quarter_index
from quarterloom.operators import panel as P
from quarterloom.operators import returns as R
from quarterloom.operators import stats as S
from quarterloom.session import cut_lineage

PASSED = [
    "ticker", "company", "sector", "industry", "cik", "year", "quarter", "datacqtr", "datafqtr", "earnings_date", "eps12mtrailing_qavg",
    "eps12mtrailing_eoq", "eps12mfwd_qavg", "eps12mfwd_eoq", "eps_lt", "peforw_qavg", "peforw_eoq",
]
KEYS = ["ticker", "year", "quarter"]
CONTROLS = ("negative", "positive", "litigious", "constraining")


def scored(texts: DataFrame, text: str, lexicons: Mapping[str, Iterable[str]], keep: list[str]) -> DataFrame:
    """Section, tokens of the whole and of the section, and all scores; each text is tokenised once per part."""
    one = texts.select(*keep, F.col(text).alias("__full")).withColumn("__start", X.section_start("__full"))
    two = one.select(*keep, F.col("__start").isNotNull().alias("qa_isolated"), F.inline(F.array(F.struct(X.tokens("__full").alias("__wf"), X.tokens(X.section("__full", "__start")).alias("__wq")))))
    full = X.with_scores(two, "__wf", lexicons, "full", keep=[*keep, "qa_isolated", "__wq"])
    return X.with_scores(full, "__wq", lexicons, "qa")


def build_features(corpus: DataFrame, lexicons: Mapping[str, Iterable[str]], universe=None, key: str = "corpus_id") -> DataFrame:
    """Corpus to feature table: universe, keys, longest transcript per key, scores, forward outcome."""
    rows = corpus.where(P.universe() if universe is None else universe).dropna(subset=["year", "quarter", "ticker"])
    rows = rows.withColumns({"year": F.col("year").cast("int"), "quarter": F.col("quarter").cast("int"), "__length": F.coalesce(F.length("transcript"), F.lit(-1))})
    # Scored where read, so that only scores are moved: the longest text's stay.
    full = P.keep_best(scored(rows, "transcript", lexicons, [*PASSED, key, "__length"]), KEYS, [F.col("__length"), -F.col(key)]).drop(key, "__length")
    out = P.with_forward_outcome(full, value="eps12mtrailing_qavg", following="eps_ttm_next_q", growth="eps_ttm_growth_next_q")
    return out.withColumn("eps_ttm", F.col("eps12mtrailing_qavg"))


def recent_signals(recent: DataFrame, panel: DataFrame, moment: str, lexicon: Iterable[str], key: str = "recent_id", least_tokens: int = 500, source: str = "recent") -> DataFrame:
    """Newer calls on the panel's scale: longest per quarter, scored, calibrated on the overlap, strictly newer than the panel.

    moment: a column with the call's ISO date or moment, null where there is none.
    """
    rows = recent.join(panel.select("ticker").distinct(), "ticker", "left_semi").withColumn("__at", F.try_to_timestamp(F.left(moment, F.lit(10)), F.lit("yyyy-MM-dd"))).where("__at is not null")
    kept = ["ticker", "company", "year", "quarter", "datacqtr", "earnings_date", key, "__length"]
    part = P.period_columns(rows, "__at").withColumns({"earnings_date": F.date_format("__at", "yyyy-MM-dd"), "__length": F.coalesce(F.length("transcript"), F.lit(-1))}).dropna(subset=KEYS)
    part = part.select(*kept, "transcript", F.inline(F.array(F.struct(X.section_start("transcript").alias("__start")))))
    words = part.select(*kept, F.inline(F.array(F.struct(X.tokens(X.section("transcript", "__start")).alias("__w")))))
    # Scored where read; the longest call of a quarter stays, and no text is moved.
    scores = P.keep_best(X.with_scores(words, "__w", {"uncertainty": lexicon}, "qa"), KEYS, [F.col("__length"), -F.col(key)]).drop(key, "__length")
    # Used for the fit and for the result: the texts are scored once, the scores are small.
    raw = cut_lineage(scores.where(F.col("total_tokens_qa") >= least_tokens).withColumnRenamed("uncertainty_density_qa", "__raw"))
    known = panel.select("ticker", "datacqtr", F.col("uncertainty_density_qa").alias("__panel")).dropna()
    fit = S.calibration(raw.join(known, ["ticker", "datacqtr"]), "__raw", "__panel").select("slope", "intercept", F.lit(1).alias("__one"))
    scaled = raw.withColumn("__one", F.lit(1)).join(F.broadcast(fit), "__one").withColumn("uncertainty_density_qa", F.col("intercept") + F.col("slope") * F.col("__raw"))
    newer = P.strictly_newer(scaled, panel)
    return newer.select("ticker", "company", "year", "quarter", "datacqtr", "earnings_date", F.lit(True).alias("qa_isolated"), "total_tokens_qa", "uncertainty_density_qa", F.lit(source).alias("source"))


def growth_sample(panel: DataFrame, least_tokens: int = 500, tail: float = 0.01) -> DataFrame:
    """Rows with section and outcome, and the outcome pulled in to its 1 % and 99 % quantiles."""
    rows = panel.where(P.sample_filter(least_tokens, "eps_ttm_growth_next_q")).withColumn("density", F.col("uncertainty_density_qa"))
    return P.winsorize(rows, "eps_ttm_growth_next_q", "growth_w", tail=tail)


def standardized_sample(panel: DataFrame, least_tokens: int = 500) -> DataFrame:
    return P.standardize(growth_sample(panel, least_tokens), {"density": "density_z"}, "ticker").where("density_z is not null")


def with_controls(sample: DataFrame) -> DataFrame:
    """Control z-scores on the sample, then rows where any is missing go."""
    out = P.standardize(sample, {f"{c}_density_qa": f"{c}_z" for c in CONTROLS}, "ticker")
    return out.dropna(subset=[f"{c}_z" for c in CONTROLS])


def lead_lag(sample: DataFrame, guard: bool = False) -> DataFrame:
    """Correlation of density with the outcome of the quarter before and with the one that follows."""
    rows = P.with_previous(sample, "growth_w", "growth_curr_w", guard=guard)
    return rows.agg(
        S.correlation("density_z", "growth_curr_w").alias("r_current"), F.count_if(F.col("growth_curr_w").isNotNull() & F.col("density_z").isNotNull()).alias("n_current"),
        S.correlation("density_z", "growth_w").alias("r_next"), F.count_if(F.col("growth_w").isNotNull() & F.col("density_z").isNotNull()).alias("n_next"),
    )


def control_fits(sample: DataFrame, time: str | None = None) -> DataFrame:
    """Each control beside the density, then all of them jointly."""
    models = {c: ("growth_w", ["density_z", f"{c}_z"]) for c in CONTROLS} | {"joint": ("growth_w", ["density_z", *(f"{c}_z" for c in CONTROLS)])}
    return S.fe_fits(with_controls(sample), models, "ticker", {"": time}).withColumnRenamed("model", "controls").drop("effects")


def momentum_fit(sample: DataFrame, time: str | None = None) -> DataFrame:
    """Level and momentum."""
    return S.fe_fit(P.with_momentum(with_controls(sample), "density_z"), "growth_w", ["density_z", "momentum"], "ticker", time)


def sector_table(panel: DataFrame, least_rows: int = 150, least_tickers: int = 5, least_tokens: int = 500) -> DataFrame:
    """A13 per sector, with winsorizing and z-scores within the sector; small sectors are left out."""
    rows = panel.where(P.sample_filter(least_tokens, "eps_ttm_growth_next_q")).dropna(subset=["sector"]).withColumn("density", F.col("uncertainty_density_qa"))
    rows = P.standardize(P.winsorize(rows, "eps_ttm_growth_next_q", "growth_w", by=["sector"]), {"density": "density_z"}, "ticker").where("density_z is not null")
    fits = S.slope_by(rows, "growth_w", "density_z", "ticker", ["sector"])
    return fits.where((F.col("n") >= least_rows) & (F.col("entities") >= least_tickers)).select("sector", "n", F.col("entities").alias("tickers"), F.col("beta").alias("beta_pp"), "t", "p")


def price_outcomes(calls: DataFrame, prices: DataFrame, day: str) -> DataFrame:
    """Forward returns of each call from its day."""
    wanted = calls.select("ticker", "datacqtr", "year", "quarter", F.col(day).alias("earnings_date")).dropna(subset=["ticker", "earnings_date"]).dropDuplicates()
    return R.with_forward_returns(wanted, R.sessions(prices, latest=["fetched_at", "price_id"]), "earnings_date")


_FIT_COLUMNS = ["coef", "se", "t", "p", "r2_within", "n"]


def price_drift(outcomes: DataFrame, panel: DataFrame, horizon: str, times: dict[str, str | None], least_tokens: int = 500) -> DataFrame:
    """Densities joined to outcomes, winsorized return on the z-score, with each kind of effects."""
    density = panel.where(P.sample_filter(least_tokens)).select("ticker", "datacqtr", F.col("uncertainty_density_qa").alias("density"))
    rows = outcomes.select("ticker", "datacqtr", horizon).join(density, ["ticker", "datacqtr"])
    rows = P.standardize(rows, {"density": "density_z"}, "ticker").where(F.col("density_z").isNotNull() & F.col(horizon).isNotNull())
    fits = S.fe_fits(P.winsorize(rows, horizon, "ret_w"), {horizon: ("ret_w", ["density_z"])}, "ticker", times)
    return fits.select(F.col("model").alias("outcome"), F.col("effects").alias("spec"), *_FIT_COLUMNS)


def price_drifts(outcomes: DataFrame, panel: DataFrame, time: str = "datacqtr", least_tokens: int = 500) -> DataFrame:
    """Both horizons, each with entity effects and with both."""
    # Read by every fit: the small rows are worked out once.
    outcomes = cut_lineage(outcomes.select("ticker", "datacqtr", *R.HORIZONS))
    fits = [price_drift(outcomes, panel, horizon, {"entity": None, "entity+time": time}, least_tokens) for horizon in R.HORIZONS]
    return functools.reduce(DataFrame.unionByName, fits)


def robustness(panel: DataFrame, least_tokens: int = 500, time: str = "datacqtr") -> DataFrame:
    """The trailing outcome and the single-quarter one, each with entity effects and with both."""
    rows = P.standardize(panel.where(P.sample_filter(least_tokens)).withColumn("density", F.col("uncertainty_density_qa")), {"density": "density_z"}, "ticker")
    rows = rows.withColumn("yoy", P.innovation("eps_ttm", "eps_ttm_next_q")).where("density_z is not null")
    fits = []
    for outcome in ("eps_ttm_growth_next_q", "yoy"):
        wins = P.winsorize(rows.where(F.col(outcome).isNotNull()), outcome, "out_w")
        fits.append(S.fe_fits(wins, {outcome: ("out_w", ["density_z"])}, "ticker", {"entity": None, "entity+time": time}))
    return functools.reduce(DataFrame.unionByName, fits).select(F.col("model").alias("outcome"), F.col("effects").alias("spec"), *_FIT_COLUMNS)


def panel_stats(panel: DataFrame, least_tokens: int = 500) -> DataFrame:
    """One row for the page: n, the two coefficients, the p of the weaker as a bucket."""
    from quarterloom.functions.scalars import p_bucket

    fits = S.fe_fits(standardized_sample(panel, least_tokens), {"": ("growth_w", ["density_z"])}, "ticker", {"one": None, "two": "datacqtr"})
    of = lambda label, value: F.max(F.when(F.col("effects") == label, value))
    found = fits.agg(of("one", F.col("n")).alias("n"), of("one", F.round("coef", 2)).alias("coefHigh"), of("two", F.round("coef", 2)).alias("coefLow"), of("two", F.col("p")).alias("__p"))
    return found.where("n is not null").select("n", "coefHigh", "coefLow", p_bucket("__p").alias("p"))


def company_documents(panel: DataFrame, recent: DataFrame | None = None, least_tokens: int = 500, least_pairs: int = 12) -> DataFrame:
    """K5: one row per company for the explorer."""
    rows = P.winsorize(panel.where(P.sample_filter(least_tokens)), "eps_ttm_growth_next_q", "eps_w")
    base = rows.select("ticker", "company", "year", "quarter", F.col("uncertainty_density_qa").alias("density"), "eps_w", F.lit(False).alias("is_recent"))
    if recent is not None:
        newer = recent.select("ticker", "company", "year", "quarter", F.col("uncertainty_density_qa").alias("density"), F.lit(None).cast("double").alias("eps_w"), F.lit(True).alias("is_recent"))
        base = P.append_recent(base, newer)
    return P.web_quarters(base, least_pairs)


def explorer_document(stats: DataFrame, companies: DataFrame) -> DataFrame:
    """K5: the JSON of the page, one row. It holds every company once: a page's content, bounded by what a page can show."""
    listed = companies.agg(F.array_sort(F.collect_list(F.struct("ticker", "name", "quarters", "r", "latestLabel", "latestZ"))).alias("companies"), F.count("*").alias("tickers")).withColumn("__one", F.lit(1))
    head = stats.withColumn("__one", F.lit(1)).join(listed, "__one")
    panel = F.struct("coefLow", "coefHigh", "n", "tickers", "p").alias("panel")
    return head.select(F.to_json(F.struct(panel, "companies"), {"ignoreNullFields": "false"}).alias("document"))


def audit(features: DataFrame) -> DataFrame:
    """K8: counters of a build in one aggregation."""
    return features.agg(
        F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), F.min("year").cast("bigint").alias("first_year"), F.max("year").cast("bigint").alias("last_year"),
        F.count_if("qa_isolated").alias("n_isolated"), (F.avg(F.col("qa_isolated").cast("double")) * 100).alias("isolated_pct"), F.sum("negation_excluded_full").alias("suppressed"),
        F.count("eps_ttm_next_q").alias("n_outcome"), F.max(quarter_index("year", "quarter")).alias("newest"),
    )
