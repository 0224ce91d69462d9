from datetime import datetime

from quarterloom.llm import survivors as S

CALL = "Operator: Good day, and welcome to the first quarter call of Acme. " + "We grew nicely. " * 30 + "Operator: Ladies and gentlemen, this concludes the program."
SCHEMA = "corpus_id bigint, ticker string, year double, quarter double, datacqtr string, sector string, transcript string, feed string, loaded_at timestamp, extra string"
AT = datetime(2024, 1, 1)


def row(i, ticker="ACMEX", year=2024.0, quarter=1.0, label="2024Q1", sector="S", text=CALL, feed="good", at=AT, extra=None):
    return (i, ticker, year, quarter, label, sector, text, feed, at, extra)


def feeds(spark):
    return spark.createDataFrame([("good", 5), ("poor", 1)], "feed string, trust int")


def chosen(spark, rows):
    return sorted(tuple(r) for r in S.call_survivors(spark.createDataFrame(rows, SCHEMA), feeds(spark)).collect())


def test_choice(spark):
    whole = lambda *rows: chosen(spark, list(rows))
    assert whole(row(1), row(2, "$acmex ", feed="poor")) == [("ACMEX", 2024, 1, 1)]
    assert whole(row(1, sector=None), row(2, "NYX:ACMEX", None, None)) == [("ACMEX", 2024, 1, 1)]
    # Unreadable ones never survive, whatever their source.
    bad = [CALL[: len(CALL) // 2 - 3], CALL + "\n" + CALL, CALL.replace("nicely", "niÃ©ly"), None, "", "Transcript not available."]
    for text in bad:
        assert whole(row(1, text=text), row(2, "ACMEX.N", feed="poor")) == [("ACMEX", 2024, 1, 2)], text
    # Filled columns, then load time, then the smallest id.
    assert whole(row(1, sector=None), row(2)) == [("ACMEX", 2024, 1, 2)]
    assert whole(row(1), row(2, at=datetime(2024, 2, 1))) == [("ACMEX", 2024, 1, 2)]
    assert whole(row(2), row(1)) == [("ACMEX", 2024, 1, 1)]
    assert whole(row(1, feed=None), row(2, feed="nobody")) == [("ACMEX", 2024, 1, 2)]


def test_no_group(spark):
    assert chosen(spark, [row(1), row(2, None), row(3, year=None, label=None), row(4, "OTHER")]) == []
    assert chosen(spark, [row(1, text=None), row(2, text="")]) == []
    assert S.call_survivors(spark.createDataFrame([], SCHEMA), feeds(spark)).count() == 0


def test_period_from_label(spark):
    assert chosen(spark, [row(1, year=None, quarter=None), row(2)]) == [("ACMEX", 2024, 1, 2)]


def test_gaps_filled(spark):
    rows = [row(1, sector=None), row(2, sector="Energy", feed="poor", text=None), row(3, sector="Other", feed="poor", text=None, at=datetime(2023, 1, 1))]
    got = S.merged_records(spark.createDataFrame(rows, SCHEMA), feeds(spark), ["sector", "extra"]).first()
    assert (got.corpus_id, got.sector, got.extra, got.n_records) == (1, "Energy", None, 3)


def test_doubles_are_compared_whole():
    far = "x" * 700 + CALL + "y" * 700
    assert S.complete(far) and not S.repeated(far) and S.complete(CALL) and not S.repeated(CALL)
    for text in (CALL + "\n\n" + CALL, CALL + CALL[: len(CALL) // 2], f"{CALL}\n{CALL}\n{CALL}", "abcabc"):
        assert S.repeated(text), text
    # A start that happens to come again is no second copy.
    assert not S.repeated("We grew. " * 9 + CALL + "We grew. " * 9 + "and so on") and not S.repeated("") and not S.repeated("ab")
    assert not S.complete(CALL.replace("welcome to", "")) and not S.complete("this concludes the program. welcome to")


def test_the_transcript_survives_with_its_record(spark):
    rows = [row(1, text=None, feed="good"), row(2, feed="poor"), row(2, feed="poor")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.with_transcripts(S.merged_records(df, feeds(spark), ["sector"]), df).first()
    assert (got.corpus_id, got.transcript, got.n_records) == (2, CALL, 3)
