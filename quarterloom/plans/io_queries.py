"""Queries of sinks and sources: each writes into the session's shared folder, reads back, and returns what it read; and of the page's lookups."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.functions.scalars import contains_query, quarter_index
from quarterloom.operators import stats as S
from quarterloom.plans import panel_queries as PQ
from quarterloom.plans import pipelines as L
from quarterloom.session import checkpoint_folder
from quarterloom.sources import more, table

_TEMPLATE = f"<html><body><script>const DATA = {more.PLACE};</script></body></html>"


def _place(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_folder(spark), f"io-{spark.sparkContext.applicationId}", name)


def _report(spark: SparkSession, folder: str) -> DataFrame:
    rows = PQ.panel(spark, folder).groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg("uncertainty_density_qa"), 6).alias("density"))
    return rows


def k1_parquet(spark, folder):
    more.write_parquet(_report(spark, folder), _place(spark, "report.parquet"))
    return spark.read.parquet(_place(spark, "report.parquet"))


def k2_csv(spark, folder):
    """Sorted, with a header, in one file; line numbers tell the order it was written in."""
    more.write_csv(_report(spark, folder), _place(spark, "report.csv"), [F.col("n").desc(), F.col("ticker")])
    lines = spark.read.text(_place(spark, "report.csv"), wholetext=True).select(F.posexplode(F.split("value", "\\n")).alias("line", "row"))
    return lines.where("row <> ''").select(F.col("line").cast("bigint").alias("line"), F.split_part("row", F.lit(","), F.lit(1)).alias("ticker"), F.split_part("row", F.lit(","), F.lit(2)).alias("n"))


def k3_report(spark, folder):
    """A report to the console and to a file; K6 lays out its table."""
    more.report(more.as_table(PQ.a1_summary(spark, folder)), _place(spark, "report.txt"))
    return spark.read.text(_place(spark, "report.txt")).select(F.regexp_replace("value", " +", " ").alias("line"))


def s5_json(spark, folder):
    """A one-row report as an indented document, and back."""
    more.write_json(PQ.a1_summary(spark, folder), _place(spark, "summary.json"))
    return more.json_document(spark, _place(spark, "summary.json"))


def s6_page(spark, folder):
    """The explorer's document put into a page, and the companies read out of the page."""
    document = L.explorer_document(L.panel_stats(PQ.panel(spark, folder), PQ._LEAST), L.company_documents(PQ.panel(spark, folder), least_tokens=PQ._LEAST)).first().document
    more.put_text(_place(spark, "template.html"), _TEMPLATE)
    more.write_page(document, _place(spark, "template.html"), _place(spark, "page.html"))
    page = spark.read.text(_place(spark, "page.html"), wholetext=True).select(F.regexp_extract("value", r"const DATA = (.*);</script>", 1).alias("data"))
    schema = "panel struct<n bigint, tickers bigint>, companies array<struct<ticker string, name string, quarters array<struct<label string>>, latestLabel string>>"
    rows = page.select(F.from_json("data", schema).alias("d")).select(F.col("d.panel.tickers").alias("tickers"), F.inline("d.companies"))
    return rows.select("tickers", "ticker", "name", F.size("quarters").cast("bigint").alias("n_quarters"), "latestLabel")


def s7_raw_texts(spark, folder):
    """Texts in files named ticker_quarter: the evaluation items, a table of fixed size, written one by one and read back."""
    for r in table(spark, folder, "eval_items").select("item_id", "split", "text").toLocalIterator():
        more.put_text(_place(spark, f"texts/I{r.item_id}_{r.split}.txt"), r.text or "")
    return more.raw_texts(spark, _place(spark, "texts/*.txt")).select("ticker", "quarter", F.md5("text").alias("text_md5"))


def a22_legacy_correlation(spark, folder):
    """Per company, after rows without the outcome are gone; at least two rows."""
    rows = PQ.panel(spark, folder).where("eps_ttm_growth_next_q is not null and company is not null")
    out = rows.groupBy("company").agg(F.count("*").alias("n"), F.round(S.correlation("eps_ttm_growth_next_q", "uncertainty_density_qa"), 3).alias("r")).where("n > 1")
    return out.withColumn("reading", F.when(F.col("r") < 0, "negative").when(F.col("r") > 0, "positive").otherwise("none"))


def k7_chart_series(spark, folder):
    """The data behind the charts: each company's two series in order of quarter."""
    rows = PQ._section(spark, folder)
    return rows.select("ticker", quarter_index("year", "quarter").alias("q"), F.round("density", 2).alias("left_axis"), F.round("eps_ttm_growth_next_q", 1).alias("right_axis"))


def found_or_first(companies: DataFrame, wanted: list[str], default: str | None = None) -> DataFrame:
    """For each wanted ticker its company, else the default's, else the first by ticker. Two small aggregations, whatever the number of companies."""
    asked = companies.sparkSession.createDataFrame([(t,) for t in wanted], "wanted string")
    first = companies.agg(F.coalesce(F.max(F.when(F.col("ticker") == (default or ""), F.col("ticker"))), F.min("ticker")).alias("__first")).withColumn("__one", F.lit(1))
    known = companies.select(F.col("ticker").alias("__known"))
    chosen = asked.join(known, F.col("wanted") == F.col("__known"), "left").withColumn("__one", F.lit(1)).join(F.broadcast(first), "__one")
    return chosen.select("wanted", F.coalesce("__known", "__first").alias("ticker")).join(companies, "ticker")


def first_match(companies: DataFrame, query: str) -> DataFrame:
    """The first company, by ticker, that a query finds; the first of all for an empty one, none if nothing is found."""
    return companies.where(contains_query(["ticker", "name"], query)).orderBy("ticker").limit(1)


def x3_lookup_fallback(spark, folder):
    return found_or_first(PQ.w6_companies(spark, folder).select("ticker", "n_quarters"), ["ZANNO", "NOSUCH", ""])


def x6_first_match(spark, folder):
    companies = PQ.w6_companies(spark, folder).select("ticker", "name")
    found = [first_match(companies, q).withColumn("query", F.lit(q)) for q in (" holdings", "", "z", "no such name")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


QUERIES = {name: f for name, f in globals().items() if re.match(r"(?:[aksx])\d+_", name)}
_REPORT = f"{PQ._PANEL}, rep as (select ticker, count(*) as n, round(avg(uncertainty_density_qa), 6) as density from panel group by ticker)"
_ONE = "select count(*) as n_rows, count(distinct ticker) as n_tickers, min(year)::bigint as first_year, max(year)::bigint as last_year from panel"
_MATCH = "(select ticker, name, '{0}' as query from web where contains(upper(ticker), upper(trim('{0}'))) or contains(upper(name), upper(trim('{0}'))) order by ticker limit 1)"
ORACLE = {
    "k1_parquet": f"with {_REPORT} select * from rep",
    "k2_csv": f"with {_REPORT} select 0::bigint as line, 'ticker' as ticker, 'n' as n union all select row_number() over (order by n desc, ticker) as line, ticker, n::varchar as n from rep",
    "k3_report": f"with {PQ._PANEL}, one as ({_ONE}) select 'n_rows n_tickers first_year last_year' as line union all select n_rows || ' ' || n_tickers || ' ' || first_year || ' ' || last_year from one",
    "s5_json": f"with {PQ._PANEL} {_ONE}",
    "s6_page": f'with {PQ._WEB} select (select count(*) from web) as tickers, ticker, name, n_quarters, "latestLabel" from web',
    "s7_raw_texts": "select 'I' || item_id as ticker, split as quarter, md5(text) as text_md5 from eval_items",
    "a22_legacy_correlation": f"with {PQ._PANEL}, c as (select company, count(*) as n, round({PQ._CORR.format('eps_ttm_growth_next_q', 'uncertainty_density_qa')}, 3) as r from (select * from panel where eps_ttm_growth_next_q is not null and company is not null) group by company) select company, n, r, case when r < 0 then 'negative' when r > 0 then 'positive' else 'none' end as reading from c where n > 1",
    "k7_chart_series": f"with {PQ._SEC} select ticker, q, round(density, 2) as left_axis, round(eps_ttm_growth_next_q, 1) as right_axis from sec",
    "x3_lookup_fallback": f"with {PQ._WEB}, asked as (select unnest(['ZANNO', 'NOSUCH', '']) as wanted) select wanted, web.ticker, web.n_quarters from asked left join web k on k.ticker = wanted join web on web.ticker = coalesce(k.ticker, (select min(ticker) from web))",
    "x6_first_match": f"with {PQ._WEB} " + " union all ".join(_MATCH.format(q) for q in (" holdings", "", "z", "no such name")),
}
