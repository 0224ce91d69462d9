import random
import re

import pytest
from pyspark.sql import functions as F

from quarterloom.functions import text as X
from quarterloom.sources import lexicons as L

WORDS = {"risk", "uncertainty", "volatility", "maybe", "may"}
R = "Revenue grew across all segments this quarter. " * 40


def scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("w", X.tokens("text"))
    return X.with_scores(df, "w", {"uncertainty": WORDS}, "full").orderBy("id").collect()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("We don't see risk, per se.", ["we", "don't", "see", "risk", "per", "se"]),
        ("don’t risk", ["don", "t", "risk"]),
        ("rock'n'roll", ["rock'n", "roll"]),
        ("Q3 2024 risk-free", ["q", "risk", "free"]),
        ("", []),
        (None, None),
    ],
)
def test_tokens(spark, text, expected):
    assert spark.createDataFrame([(text,)], "text string").select(X.tokens("text")).first()[0] == expected


def test_negation(spark):
    cases = [
        ("There is significant risk and uncertainty ahead.", 7, 2, 0),
        ("We see no material risk this quarter.", 7, 0, 1),
        ("We don't anticipate volatility.", 4, 0, 1),
        ("not that we would call risk", 6, 1, 0),
        ("not one two risk", 4, 0, 1),
        ("risk is not our concern", 5, 1, 0),
    ]
    for (text, n, count, aside), row in zip(cases, scores(spark, [c[0] for c in cases])):
        assert (row.total_tokens_full, row.uncertainty_count_full, row.negation_excluded_full) == (n, count, aside), text


def test_density_and_missing(spark):
    rows = scores(spark, ["maybe maybe maybe sure", "", None])
    assert rows[0].uncertainty_density_full == 75.0
    assert rows[1].total_tokens_full == 0 and rows[1].uncertainty_density_full is None
    assert rows[2].total_tokens_full is None and rows[2].uncertainty_count_full is None


def test_scores_against_plain_python(spark):
    rng = random.Random(1)
    pool = ["risk", "no", "not", "may", "don't", "x", "É", "it's", "never", "42", "—", "volatility"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(60)]
    for text, row in zip(texts, scores(spark, texts)):
        tok = re.findall(X.TOKEN_PATTERN, text.lower())
        hit = [i for i, t in enumerate(tok) if t in WORDS]
        aside = sum(any(w in X.NEGATORS for w in tok[max(0, i - 3) : i]) for i in hit)
        assert (row.total_tokens_full, row.uncertainty_count_full, row.negation_excluded_full) == (len(tok), len(hit) - aside, aside)


def starts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("s", X.section_start("text")).withColumn("p", X.section("text", "s"))
    return [(r.s, r.p) for r in df.orderBy("id").collect()]


def test_section_cases(spark):
    header = R + "Question-and-Answer Session Operator: Our first question. " + R
    intro = "We will hold a question-and-answer session. " + R + "Operator: Your first question comes from Jane Doe. Great quarter. " + R[: len(R) // 2]
    handoff = R + "Our next question comes from Jane Doe of Big Bank. " + R
    both = R + "Question-and-Answer Session " + "next question comes from Jane Doe " + R
    out = starts(spark, [header, intro, R, "", R * 5 + "thanks for the first question", handoff, both, None, "😀" * 5 + header])
    assert out[0][1].startswith("Question-and-Answer Session")
    assert out[1][1].startswith("first question comes")
    assert out[2] == (None, None) and out[3] == (None, None) and out[4] == (None, None) and out[7] == (None, None)
    assert out[5][1].startswith("next question comes from")
    assert out[6][1].startswith("Question-and-Answer")
    assert out[8][0] == out[0][0] + 5


def test_section_against_plain_python(spark):
    rng = random.Random(2)
    pool = ["Question-and-Answer session ", "first question today ", "next question, please, from ", "your line is open ", "QUEſTION and answer session ", "abc 😀 ", "x" * 30 + " ", ". "]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(80)]
    compiled = [re.compile(p, re.I) for p in X.SECTION_PATTERNS]
    for text, (start, part) in zip(texts, starts(spark, texts)):
        found = next((m.start() for p in compiled for m in p.finditer(text) if 0.15 * len(text) <= m.start() <= 0.95 * len(text)), None)
        assert start == found and part == (None if found is None else text[found:])


def test_plain_path(spark):
    df = spark.createDataFrame([("a Operator b Question-and-Answer risk",), ("nothing",), (None,)], "text string")
    assert [r[0] for r in df.select(X.plain_section("text")).collect()] == [" risk", "nothing", None]
    d = spark.createDataFrame([("May risk, it",), ("",), (None,)], "text string").select(X.plain_density("text")).collect()
    assert [r[0] for r in d] == [33.33, None, None]
    f = spark.createDataFrame([("Total revenue was $12.5 billion",), ("$3 billion in revenue",), ("none",)], "text string").select(X.figure_cascade("text")).collect()
    assert [r[0] for r in f] == [12.5, 3.0, None]


def test_lexicons(spark, tmp_path):
    path = tmp_path / "short.txt"
    path.write_text(" Risk\nuncertain\n\nmaybe\nRISK\n")
    assert L.load_terms(spark, str(path), 3) == {"risk", "uncertain", "maybe"}
    with pytest.raises(ValueError, match="expected at least"):
        L.load_terms(spark, str(path), 100)
    lists = L.lexicons()
    assert tuple(lists) == L.CATEGORIES and all(lists.values())
    assert L.lexicon_table(spark, lists).count() == sum(map(len, lists.values()))
    assert "risk" in lists["uncertainty"] and "if" not in lists["uncertainty"]


def test_empty_lexicon(spark):
    df = spark.createDataFrame([("a b",)], "text string").withColumn("w", X.tokens("text"))
    none = X.with_scores(df, "w", {"uncertainty": set()}, "full").first()
    assert (none.uncertainty_count_full, none.negation_excluded_full) == (0, 0)
    assert X.with_scores(df.where(F.lit(False)), "w", {"uncertainty": WORDS}, "full").count() == 0
