import json

import pytest
from pyspark.sql import functions as F

from quarterloom.plans import pipelines as L
from quarterloom.sources import more
from quarterloom.sources.lexicons import lexicons
from quarterloom.streaming.append import append_newer, windowed_counts


def test_price_json(spark):
    df = spark.createDataFrame([("A", '[{"date":"2024-01-03","price":2},{"date":"2024-01-02","price":1.5}]'), ("B", "[]"), ("C", '{"error":1}'), ("D", None)], "ticker string, body string")
    assert [tuple(r) for r in more.price_rows(df).collect()] == [("A", "2024-01-02", 1.5), ("A", "2024-01-03", 2.0)]
    got = more.fetched_prices(spark, ["A", "B"], lambda t: '[{"date":"2024-01-02","price":1}]' if t == "A" else "")
    assert got.count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "NVDA_Q1_2025.txt").write_text("one\ntwo")
    assert [tuple(r) for r in more.raw_texts(spark, str(tmp_path / "*.txt")).collect()] == [("NVDA", "Q1_2025", "one\ntwo")]
    df = spark.createDataFrame([(1, "b"), (2, "a")], "n int, s string")
    more.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    more.write_csv(df, str(tmp_path / "c"), [F.col("s")])
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_text().splitlines() == ["n,s", "2,a", "1,b"]
    more.write_json(df.orderBy("n").limit(1), str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"n": 1, "s": "b"}
    assert more.json_document(spark, str(tmp_path / "j.json")).first().n == 1
    (tmp_path / "t.html").write_text("<script>__EMBEDDED_DATA__</script>")
    more.write_page('{"a":"</script>"}', str(tmp_path / "t.html"), str(tmp_path / "o.html"))
    assert (tmp_path / "o.html").read_text() == '<script>{"a":"<\\/script>"}</script>'
    (tmp_path / "bad.html").write_text("none")
    with pytest.raises(ValueError):
        more.write_page("{}", str(tmp_path / "bad.html"), str(tmp_path / "o.html"))
    assert more.report(more.as_table(df), str(tmp_path / "r.txt")).startswith("n")
    assert {r.column: r.filled for r in more.inspected(df).collect()} == {"n": 2, "s": 2}


def test_feature_build(spark, small):
    from quarterloom.sources import table

    out = L.build_features(table(spark, small, "corpus"), lexicons(), F.lit(True))
    assert len(out.columns) == 45
    rows = out.collect()
    assert len({(r.ticker, r.year, r.quarter) for r in rows}) == len(rows) > 0
    assert all(r.total_tokens_qa is None for r in rows if not r.qa_isolated)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan


def test_streaming_append(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "A", 2024, 1), (2, "A", 2024, 2), (3, "A", 2024, 2), (4, "B", 2024, 2)], "id bigint, ticker string, year int, quarter int").write.parquet(str(source))
    panel = spark.createDataFrame([("A", 2024, 1)], "ticker string, year int, quarter int")
    stream = spark.readStream.schema("id bigint, ticker string, year int, quarter int").parquet(str(source))
    append_newer(stream, panel, str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination(60)
    assert [(r.id, r.quarter) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 2)]


def test_streaming_windows(spark, tmp_path):
    source = tmp_path / "ev"
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as kind union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 05:00:00', 'b'").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(source))
    q = windowed_counts(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.sql("select * from w").collect()) == [("a", 2), ("b", 1)]
