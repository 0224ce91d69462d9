"""Other sources and sinks: price responses, raw text files, inspection; parquet, CSV, JSON and page output."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = "__EMBEDDED_DATA__"


def price_rows(responses: DataFrame, ticker: str = "ticker", body: str = "body") -> DataFrame:
    """Rows (ticker, date, close) of JSON price lists; a body that is no list gives none."""
    parsed = F.from_json(body, "array<struct<date:string,price:double>>")
    listed = responses.where(F.ltrim(F.col(body)).startswith("[")).select(ticker, F.inline(F.array_sort(parsed)))
    return listed.where("date is not null").select(ticker, "date", F.col("price").alias("close"))


def fetched_prices(spark: SparkSession, tickers: list[str], fetch: Callable[[str], str], tasks: int = 16) -> DataFrame:
    """The pluggable reader behind S4: ``fetch`` returns a ticker's response, in the tasks and not on the driver; tickers without
    one are left out. ``tasks`` bounds how many ask at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(t, body) for t in batch.column("ticker").to_pylist() if (body := fetch(t))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in bodies], pa.string()), pa.array([b for _, b in bodies], pa.string())], names=["ticker", "body"])

    wanted = spark.createDataFrame([(t,) for t in tickers], "ticker string").repartition(min(tasks, max(1, len(tickers))))
    return price_rows(wanted.mapInArrow(run, "ticker string, body string"))


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file named TICKER_QUARTER.txt, missing files tolerated."""
    rows = spark.read.option("ignoreMissingFiles", "true").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^_]+)_(.+)\.txt$", 1)
    return rows.select(name.alias("ticker"), F.regexp_extract(F.col("_metadata.file_name"), r"^([^_]+)_(.+)\.txt$", 2).alias("quarter"), F.col("value").alias("text"))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.json(path, multiLine=True)


def inspected(df: DataFrame, most: int = 2000) -> DataFrame:
    """Column, type, filled rows, and the first value found, shortened."""
    counts = df.agg(F.count("*").alias("__rows"), *(F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(df.columns)), *(F.left(F.first(F.col(f"`{c}`").cast("string"), ignorenulls=True), F.lit(most)).alias(f"v_{i}") for i, c in enumerate(df.columns)))
    entries = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("__rows").alias("rows"), F.col(f"n_{i}").alias("filled"), F.col(f"v_{i}").alias("sample")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*entries)))


def write_parquet(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, order: list) -> None:
    """K2: a report, sorted, with a header, in one file; reports are small by their nature."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def put_text(path: str, text: str) -> None:
    """One small file on whatever file system the path names."""
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def get_text(path: str) -> str:
    return SparkSession.active().read.text(path, wholetext=True).first()[0]


def write_json(df: DataFrame, path: str) -> None:
    """K4: a one-row report as an indented document."""
    row = df.first()
    put_text(path, json.dumps(row.asDict(recursive=True) if row else {}, indent=2))


def write_page(document: str, template: str, out: str) -> None:
    """Puts a JSON document into a page; a template without the place for it is refused."""
    page = get_text(template)
    if PLACE not in page:
        raise ValueError(f"{template} lacks {PLACE}")
    put_text(out, page.replace(PLACE, document.replace("</", "<\\/")))


def report(lines: list[str], path: str | None = None) -> str:
    """K3: lines to the console and to a file."""
    text = "\n".join(lines)
    print(text)
    if path:
        put_text(path, text + "\n")
    return text


def as_table(df: DataFrame, most: int = 50) -> list[str]:
    """K6: a small report as aligned lines."""
    rows = [df.columns, *([f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.limit(most).collect())]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows]
