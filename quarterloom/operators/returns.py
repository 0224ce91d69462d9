"""Forward returns over trading days from an anchor day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Trading days of the two horizons.
HORIZONS = {"ret_5d": 5, "ret_fwd_q": 63}


def sessions(prices: DataFrame, ticker: str = "ticker", date: str = "date", close: str = "close", latest: list[str] | None = None) -> DataFrame:
    """One close per ticker and day: of days fetched several times the latest fetch with a close. Partial maxima merge, so a
    ticker fetched many times per day is no hot spot."""
    rows = prices.where(F.col(close).isNotNull() & F.col(ticker).isNotNull() & F.col(date).isNotNull())
    order = F.struct(*(F.col(c) for c in latest)) if latest else F.col(close)
    return rows.groupBy(ticker, date).agg(F.max_by(close, order).alias(close))


def with_forward_returns(calls: DataFrame, prices: DataFrame, anchor: str, horizons: dict[str, int] | None = None, ticker: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """Percent return from the first session on or after the anchor to the session so many trading days later.

    Null if either lies past the series or the first close isn't positive. Calls of tickers without any price stay out.
    Sessions and calls go through one window per ticker, in order of day: no pairs of calls and sessions are made.
    """
    horizons = horizons or HORIZONS
    w = Window.partitionBy(ticker).orderBy(date)
    base = F.col(close)
    ahead = {name: F.when(base > 0, (F.lead(close, k).over(w) / F.nullif(base, F.lit(0.0)) - 1) * 100) for name, k in horizons.items()}
    series = prices.select(ticker, F.col(date).cast("string").alias(date), close).withColumns(ahead)
    events = series.select(ticker, F.col(date).alias("__day"), F.lit(1).alias("__late"), F.struct(*horizons).alias("__s"))
    kept = calls.columns
    marked = calls.where(F.col(ticker).isNotNull()).select(ticker, F.col(anchor).cast("string").alias("__day"), F.lit(0).alias("__late"), F.struct(*kept).alias("__c"))
    both = events.unionByName(marked, allowMissingColumns=True)
    # From the last day back, a call stands after the sessions of its own day: the last session seen is the first on or
    # after it. (A frame that looks ahead without bound would be worked out anew for every row.)
    back = Window.partitionBy(ticker).orderBy(F.col("__day").desc(), F.col("__late").desc())
    found = both.withColumns({"__hit": F.last("__s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)), "__any": F.count("__s").over(Window.partitionBy(ticker))})
    return found.where("__c is not null and __any > 0").select(*(F.col(f"__c.`{c}`").alias(c) for c in kept), *(F.col(f"__hit.{h}").alias(h) for h in horizons))
