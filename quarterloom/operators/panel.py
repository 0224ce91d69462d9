"""Operators on entity-by-quarter panels. Missing values are nulls throughout; a null key belongs to no entity.

Windows run within one entity of a panel whose key is unique, so a window holds an entity's quarters and no more.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterloom.functions.scalars import clip, quarter_index, quarter_key

# The default universe.
SECTORS = ("Information Technology",)
EXTRA_TICKERS = ("GOOGL", "META", "AMZN")


def universe(sectors: Iterable[str] = SECTORS, tickers: Iterable[str] = EXTRA_TICKERS) -> Column:
    """In one of the sectors, or one of the tickers."""
    return F.coalesce(F.col("sector").isin(*sectors), F.lit(False)) | F.coalesce(F.col("ticker").isin(*tickers), F.lit(False))


def sample_filter(least_tokens: int = 500, outcome: str | None = None) -> Column:
    """Section found, long enough, and if named, outcome present."""
    keep = F.col("qa_isolated") & (F.col("total_tokens_qa") >= least_tokens)
    return keep & F.col(outcome).isNotNull() if outcome else keep


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the maximum of a composite: an aggregation that merges partial maxima, so neither the size of a
    group nor a hot key matters. Rows with a null key stay out. ``order`` should end in a unique column."""
    rest = [c for c in df.columns if c not in keys]
    named = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    best = F.max(F.struct(*named, F.struct(*rest).alias("__row"))).getField("__row")
    return df.dropna(subset=keys).groupBy(*keys).agg(best.alias("__best")).select(*keys, *(F.col(f"__best.`{c}`").alias(c) for c in rest))


def longest_text(df: DataFrame, keys: list[str], text: str, tiebreak: str) -> DataFrame:
    """A19 by length of text: keys, tiebreak, n_chars of the longest text of each key (null if it has none); ties end at the smallest
    tiebreak. Lengths are taken where a text is read, and no text is moved. What else is wanted of the longest text is worked out
    there too and kept by ``keep_best``, or fetched by the tiebreak."""
    ranked = df.select(*keys, tiebreak, F.length(text).alias("n_chars"))
    return keep_best(ranked, keys, [F.coalesce("n_chars", F.lit(-1)), -F.col(tiebreak)])


#: Up to so many rows a group's values are counted one by one; beyond, only those within this share of a quantile's place.
COUNTED, NEAR = 5000, 0.002


def bounds(df: DataFrame, value: str, by: list[str] | None = None, tail: float = 0.01) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Two passes whose partial results merge: approximate quantiles bracket the places wanted (their error is a twentieth of the
    bracket's width), then values inside a bracket are counted one by one and the others by the stretch between brackets. No task holds more
    than the brackets' values, whatever the number of rows.
    """
    by = by or []
    points = (tail, 1 - tail)
    edges = ", ".join(f"{min(1.0, max(0.0, p + d))}D" for p in points for d in (-NEAR, NEAR))
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    keys = [*by, "__one"]
    rows = rows.withColumn("__one", F.lit(1))
    sketch = rows.groupBy(*keys).agg(F.expr(f"approx_percentile(__v, array({edges}), 10000)").alias("__e"), F.count("*").alias("__n"))
    # Without groups the sketch is one row.
    marked = rows.join(sketch if by else F.broadcast(sketch), keys)
    inside = (F.col("__n") <= COUNTED) | F.col("__v").between(F.col("__e")[0], F.col("__e")[1]) | F.col("__v").between(F.col("__e")[2], F.col("__e")[3])
    below = F.when(F.col("__v") > F.col("__e")[3], F.col("__e")[3]).when(F.col("__v") > F.col("__e")[1], F.col("__e")[1]).otherwise(float("-inf"))
    counted = marked.groupBy(*keys, "__n", F.when(inside, F.col("__v")).otherwise(below).alias("__at"), (~inside).alias("__outside")).agg(F.count("*").alias("__c"))
    start = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__at", "__outside").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("__s", F.coalesce(start, F.lit(0)))

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("__n") - 1)
        holds = lambda rank: F.max(F.when(~F.col("__outside") & (F.col("__s") <= rank) & (rank < F.col("__s") + F.col("__c")), F.col("__at")))
        low, high, part = holds(F.floor(place)), holds(F.ceil(place)), F.max(place - F.floor(place))
        return low + part * (high - low)

    return placed.groupBy(*keys).agg(quantile(points[0]).alias("low"), quantile(points[1]).alias("high")).drop("__one")


def winsorize(df: DataFrame, value: str, out: str, by: list[str] | None = None, tail: float = 0.01) -> DataFrame:
    """Values pulled in to the quantiles of the whole or of each group; nulls stay."""
    edges = bounds(df, value, by, tail).withColumnsRenamed({"low": "__low", "high": "__high"})
    if by:
        joined = df.join(edges, by, "left")
    else:
        joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(edges.withColumn("__one", F.lit(1))), "__one", "left").drop("__one")
    return joined.withColumn(out, clip(value, "__low", "__high")).drop("__low", "__high")


def standardize(df: DataFrame, values: dict[str, str], by: str) -> DataFrame:
    """Z-scores within each entity over the rows at hand, population deviation; a constant entity gives nulls."""
    w = Window.partitionBy(by)
    return df.withColumns({out: F.try_divide(F.col(v) - F.avg(v).over(w), F.nullif(F.stddev_pop(v).over(w), F.lit(0.0))) for v, out in values.items()})


def _ordered(entity: str) -> Window:
    return Window.partitionBy(entity).orderBy("__q")


def with_forward_outcome(df: DataFrame, entity: str = "ticker", year: str = "year", quarter: str = "quarter", value: str = "eps", following: str = "eps_next_q", growth: str = "eps_growth_next_q") -> DataFrame:
    """The value one quarter on, only if the next row is the next quarter, and its growth in percent of the absolute base."""
    w = _ordered(entity)
    base = df.where(F.col(entity).isNotNull()).withColumn("__q", quarter_index(year, quarter))
    base = base.withColumn(following, F.when(F.lead("__q").over(w) - F.col("__q") == 1, F.lead(value).over(w)))
    change = F.try_divide(F.col(following) - F.col(value), F.nullif(F.abs(value), F.lit(0.0))) * 100
    return base.withColumn(growth, change).drop("__q")


def with_previous(df: DataFrame, value: str, out: str, entity: str = "ticker", year: str = "year", quarter: str = "quarter", guard: bool = False) -> DataFrame:
    """The value of the row before; guard keeps it only if that row is the quarter before."""
    w = _ordered(entity)
    base = df.withColumn("__q", quarter_index(year, quarter))
    last = F.lag(value).over(w)
    return base.withColumn(out, F.when(F.col("__q") - F.lag("__q").over(w) == 1, last) if guard else last).drop("__q")


def with_momentum(df: DataFrame, value: str, out: str = "momentum", entity: str = "ticker") -> DataFrame:
    """Change against the quarter before; null over a gap."""
    return with_previous(df, value, "__prev", entity, guard=True).withColumn(out, F.col(value) - F.col("__prev")).drop("__prev")


def innovation(now: str, following: str) -> Column:
    """The change of a trailing sum as growth of one of its four quarters."""
    return F.try_divide(F.col(following) - F.col(now), F.nullif(F.abs(F.col(now)) / 4, F.lit(0.0))) * 100


def latest_signals(df: DataFrame, value: str, least_history: int = 12, entity: str = "ticker") -> DataFrame:
    """The last row of each entity against all its rows before: z-score, share of them below, change, quarters behind the newest."""
    q = df.where(F.col(entity).isNotNull()).withColumn("__q", quarter_index("year", "quarter"))
    newest = q.agg(F.max("__q").alias("__newest")).withColumn("__one", F.lit(1))
    w = _ordered(entity)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(entity).orderBy(F.col("__q").desc())
    whole = Window.partitionBy(entity)
    q = q.withColumns({"__last": F.max_by(value, "__q").over(whole), "__lastq": F.max("__q").over(whole)})
    rows = q.withColumns(
        {
            "__back": F.row_number().over(back), "n_history": F.count(F.lit(1)).over(before), "__mean": F.avg(value).over(before), "__sd": F.stddev_pop(value).over(before),
            "__prev": F.lag(value).over(w), "__below": F.count_if((F.col(value) < F.col("__last")) & (F.col("__q") < F.col("__lastq"))).over(whole),
        }
    ).where("__back = 1")
    rows = rows.where((F.col("n_history") >= least_history) & (F.col("__sd") != 0)).withColumn("__one", F.lit(1)).join(F.broadcast(newest), "__one")
    return rows.select(
        entity, "company", F.col("datacqtr").alias("quarter"), "earnings_date", (F.col("__newest") - F.col("__q")).alias("quarters_behind"), F.col("n_history").cast("bigint").alias("n_history"),
        F.col(value).alias("density_qa"), ((F.col(value) - F.col("__mean")) / F.col("__sd")).alias("density_z"),
        (F.col("__below").cast("double") / F.col("n_history") * 100).alias("density_pctile"), (F.col(value) - F.col("__prev")).alias("change_vs_prev_call"),
    )


def fresh(signals: DataFrame, most_behind: int = 1) -> DataFrame:
    """P12."""
    return signals.where(F.col("quarters_behind") <= most_behind)


def strictly_newer(rows: DataFrame, panel: DataFrame, entity: str = "ticker") -> DataFrame:
    """Rows later than the last quarter the panel has for their entity; entities the panel lacks stay out."""
    last = panel.groupBy(entity).agg(F.max(quarter_index("year", "quarter")).alias("__last"))
    return rows.join(last, entity).where(quarter_index("year", "quarter") > F.col("__last")).drop("__last")


def append_recent(panel: DataFrame, recent: DataFrame, entity: str = "ticker") -> DataFrame:
    """Recent rows of the panel's entities after the panel's rows; columns they lack are null."""
    return panel.unionByName(recent.join(panel.select(entity).distinct(), entity, "left_semi"), allowMissingColumns=True)


def web_quarters(rows: DataFrame, least_pairs: int = 12, entity: str = "ticker") -> DataFrame:
    """Per entity its quarters, the correlation of density and outcome, and the z-score of the last rounded density.

    rows: ticker, company, year, quarter, density, eps_w (null where not yet known), is_recent.
    """
    q = rows.withColumns({"__q": quarter_index("year", "quarter"), "__d": F.round("density", 2), "__e": F.round("eps_w", 1)})
    label = F.format_string("Q%d '%02d", F.col("quarter").cast("int"), F.pmod(F.col("year").cast("int"), F.lit(100)))
    entry = F.struct("__q", F.struct(label.alias("label"), F.col("__d").alias("density"), F.col("__e").alias("eps")).alias("v"))
    pairs = (F.col("eps_w").isNotNull()) & (~F.col("is_recent"))
    x, y = F.when(pairs, F.col("density")), F.when(pairs, F.col("eps_w"))
    grouped = q.groupBy(entity).agg(
        F.max_by(F.when(~F.col("is_recent"), F.col("company")), F.when(~F.col("is_recent"), F.col("__q"))).alias("name"),
        # A panel has one row per entity and quarter: the list is an entity's quarters.
        F.array_sort(F.collect_list(entry)).alias("__list"),
        F.count_if(pairs).alias("__n"), F.covar_pop(x, y).alias("__xy"), F.var_pop(x).alias("__xx"), F.var_pop(y).alias("__yy"),
    )
    quarters = F.transform("__list", lambda e: e["v"])
    dens = F.transform("__list", lambda e: e["v"]["density"])
    one = grouped.withColumns({"quarters": quarters, "__dens": dens}).withColumn("__prior", F.slice("__dens", 1, F.greatest(F.size("__dens") - 1, F.lit(0))))
    n = F.size("__prior").cast("double")
    one = one.withColumn("__mean", F.try_divide(F.aggregate("__prior", F.lit(0.0), lambda s, v: s + v), n))
    one = one.withColumn("__sd", F.sqrt(F.try_divide(F.aggregate("__prior", F.lit(0.0), lambda s, v: s + (v - F.col("__mean")) * (v - F.col("__mean"))), n)))
    z = F.when((F.size("__dens") > least_pairs) & (F.col("__sd") > 0), F.round((F.element_at("__dens", -1) - F.col("__mean")) / F.col("__sd"), 2))
    r = F.when(F.col("__n") >= least_pairs, F.round(F.try_divide(F.col("__xy"), F.nullif(F.sqrt(F.col("__xx") * F.col("__yy")), F.lit(0.0))), 2))
    return one.select(entity, "name", "quarters", r.alias("r"), F.element_at("quarters", -1)["label"].alias("latestLabel"), z.alias("latestZ"))


def segments(df: DataFrame, value: str, out: str = "segment", entity: str = "ticker") -> DataFrame:
    """Runs of rows with a value, broken by rows without: number of the run, null on a break."""
    q = df.withColumn("__q", quarter_index("year", "quarter"))
    breaks = F.sum(F.col(value).isNull().cast("bigint")).over(_ordered(entity).rowsBetween(Window.unboundedPreceding, 0))
    return q.withColumn(out, F.when(F.col(value).isNotNull(), breaks)).drop("__q")


def thinned(df: DataFrame, most: int = 7, entity: str = "ticker") -> DataFrame:
    """Every k-th row of an entity, k the least that leaves about ``most`` ticks."""
    q = df.withColumn("__q", quarter_index("year", "quarter"))
    rows = q.withColumns({"__i": F.row_number().over(_ordered(entity)) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(entity))})
    return rows.where(F.col("__i") % F.ceil(F.col("__n") / most) == 0).drop("__q", "__i", "__n")


def period_columns(df: DataFrame, stamp: str) -> DataFrame:
    """Year, quarter and quarter key of a timestamp column."""
    out = df.withColumns({"year": F.year(stamp), "quarter": F.quarter(stamp)})
    return out.withColumn("datacqtr", quarter_key("year", "quarter"))
