import pytest

from quarterloom.llm import truncation as X

END = "Operator: Ladies and gentlemen, this concludes the program."


@pytest.mark.parametrize(
    ("tail", "kind"),
    [
        (END, "whole"), (END[:-1], "whole"), (END + "\n***", "whole"), (END[:-1] + ". Goodbye", "whole"), (END + "\n\nDuration: 29 minutes", "whole"),
        (END + "\n(c) harborwire transcripts", "whole"), (END + "\n\n— END —", "whole"), (END + "\n\nâ€” END â€”", "whole"), (END + "\n[Call ends]", "whole"),
        (END + "\n\nCall participants:\n\nA B -- Chief Operating Officer", "whole"), ("this - um - concludes uh... the program", "whole"), ("Thank you. um...", "whole"), ("With that, we're ready for questions.", "whole"),
        ("and the feedback is", "cut"), ("the timing of la", "cut"), ("that's a good question. In [truncated]", "cut"), ("to say th...", "cut"), ("likely to last…", "cut"), ("another (more)", "cut"),
        ("C&hellip;", "cut"), ("revenue grew 6.", "doubtful"), ("as we told Acme Inc.", "doubtful"), ("thanks to Mr.", "doubtful"), ("That is it.", "whole"), ("Jane Doe:", "cut"), ("", "whole"), (None, "whole"),
    ],
)
def test_endings(tail, kind):
    assert X.ending_kind(tail) == kind


def records(n=40):
    body = "The quarter was fine. We grew 7.5% on mix. " * 20
    cut = body[:200]
    rows = [(k, cut[: 200 - 1] + "w" if k % 2 else cut[:199] + "x", "short") for k in range(n // 2)]
    rows += [(100 + k, body + END, "plain") for k in range(n // 2)]
    rows += [(900, "a" * 196 + " 7.", "short"), (901, None, "short"), (902, "", None), (903, "It stops in", None), (904, "It grew 7.", "plain")]
    return [(k, t if t is None or not t.startswith("a") else t.rjust(200, "a")[:198] + "7.", f) for k, t, f in rows]


def test_limits_and_records(spark):
    df = spark.createDataFrame(records(), "id bigint, body string, feed string")
    limits = {(r.source, r.encoding): r.size for r in X.storage_limits(X.length_piles(df, "body", "feed")).collect()}
    assert limits["short", "chars"] == 200
    found = {r.rec_id for r in X.cut_records(df, "id", "body", "feed").collect()}
    # The number at the limit is a cut, the one far from any limit isn't.
    assert found == {*range(20), 900, 903}
    shares = {r.source: (r.n_texts, r.n_cut) for r in X.cut_shares(df, "id", "body", "feed", X.cut_records(df, "id", "body", "feed")).collect()}
    assert shares["plain"] == (21, 0) and shares["short"] == (21, 21) and shares[None] == (1, 1)
    assert X.cut_records(df.limit(0), "id", "body", "feed").count() == 0


def test_lengths(spark):
    text = 'a\n"é😀<&>'
    row = {e.encoding: e.size for e in X.with_lengths(spark.createDataFrame([(text,)], "t string"), "t", []).first().sizes}
    assert row["chars"] == len(text) and row["utf8"] == len(text.encode()) and row["utf16"] == len(text.encode("utf-16-le")) // 2
    assert row["crlf"] == len(text.replace("\n", "\r\n"))
    import html
    import json

    assert row["html"] == len(html.escape(text)) and row["json"] == len(json.dumps(text, ensure_ascii=False)) - 2


def test_counts_from_cut_texts(spark):
    talk = "word " * 300
    texts = spark.createDataFrame([(1, talk + "Question-and-Answer Session " + "one two " * 20 + "thr", "f"), (2, talk, "f")], "corpus_id bigint, transcript string, feed string")
    cut = X.cut_records(texts, "corpus_id", "transcript", "feed", recount=True)
    rows = spark.createDataFrame([(10, 1, 45), (11, 1, 80), (12, 1, None), (13, 2, 45), (14, None, 45)], "id bigint, corpus_id bigint, n bigint")
    records, counted = X.with_counts(cut, rows, "id", "corpus_id", "n")
    assert sorted(r.rec_id for r in records.collect()) == [1, 2] and [r.rec_id for r in counted.collect()] == [10]


def test_a_source_with_two_limits_keeps_both(spark):
    rows = [(k, "a" * 99 + "x", "two") for k in range(9)] + [(10 + k, "b" * 249 + "y", "two") for k in range(6)] + [(100 + k, "c" * (300 + 7 * k), "two") for k in range(30)]
    limits = X.storage_limits(X.length_piles(spark.createDataFrame(rows, "id bigint, body string, feed string"), "body", "feed")).where("encoding = 'chars'")
    assert sorted((r.size, r.at) for r in limits.collect()) == [(100, 9), (250, 6)]


def test_long_lists_and_notes_are_set_aside():
    people = "\n".join(f"Person Number{k} -- Bank of Somewhere -- Analyst" for k in range(200))
    assert X.ending_kind(f"{END}\n\nCall participants:\n\n{people}") == "whole"
    assert X.ending_kind(f"We think that\n\nCall participants:\n\n{people}") == "cut"
    # A list at the top doesn't hide what follows.
    assert X.ending_kind(f"Call participants:\n{people}\n\nOperator: Good day and welcome to the first quarter call of this company, all lines are muted until we") == "cut"
    assert X.ending_kind(END + "\n***" * 2000) == "whole" and X.ending_kind("and so we" + "\n***" * 2000) == "cut"
