"""One surviving record for each group of records of the same call, chosen field by field.

A group is a ticker in plain form, a year and a quarter (from year and quarter, or from the calendar quarter's notation). One
aggregation takes, for every field, the maximum of a composite struct: (present, readable, source priority, filled columns, load time,
smallest id, value). The record whose transcript survives is the survivor; its other fields come first, and where it has none the best present
value of the group fills the gap. Everything that decides is worked out per record before the shuffle, and a transcript goes
through it as its record's id. A hot group is only partial maxima that merge, whatever its size.

Records without a ticker, or without year and quarter in either form, belong to no group. A group without any readable
member has no survivor. Ties end at the smallest id; repeated rows count as records but change no choice.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterloom.llm.garble import is_garbled, suspects
from quarterloom.llm.truncation import ending_kind

# What a whole call opens and closes with.
OPENING, CLOSING = "welcome to", ("you may now disconnect", "this concludes the program", "thank you for joining", "thank you for participating")
#: Characters of a text's start by which a second copy is looked for; the copies are then compared whole.
HEAD = 80
#: The fields that make up a call; the transcript stands for the record.
CALL = ("ticker", "year", "quarter", "transcript")


def plain_ticker(ticker: Column) -> Column:
    """Upper case, without blanks, currency sign, exchange prefix and exchange suffix; null if nothing is left."""
    t = F.regexp_replace(F.upper(F.trim(F.regexp_replace(ticker, r"\s+", " "))), r"^(?:\$|[A-Z]+: ?)+", "")
    t = F.regexp_replace(t, r"(?: [A-Z]{2}|\.[A-Z]{1,2})$", "")
    return F.when(t != "", t)


def call_period(year: Column, quarter: Column, label: Column) -> tuple[Column, Column]:
    """Year and quarter as whole numbers, from the two columns or else from a label like 2019Q2."""
    both = year.isNotNull() & quarter.isNotNull()
    part = lambda n: F.regexp_extract(label, r"^\s*(\d{4})\s*Q([1-4])\s*$", n).try_cast("bigint")
    return F.when(both, year.cast("bigint")).otherwise(part(1)), F.when(both, quarter.cast("bigint")).otherwise(part(2))


def repeated(text: str) -> bool:
    """Pasted twice: from where its start comes again, the text is what stands before, as far as the shorter of both goes
    (the second copy may be cut short, or be followed by a third)."""
    head = text[: min(HEAD, len(text) // 3)]
    again = text.find(head, len(head)) if len(text) >= 6 else -1
    if again < 0:
        return False
    first, second = text[:again].rstrip(), text[again:]
    size = min(len(first), len(second))
    return len(second) <= 2 * len(first) + 9 and first[:size] == second[:size]


def complete(text: str) -> bool:
    """Holds the opening of a call, and a closing after it."""
    lower = text.lower()
    start = lower.find(OPENING)
    return start >= 0 and any(lower.rfind(phrase) > start for phrase in CLOSING)


@F.arrow_udf(T.BooleanType())
def _readable(texts: pa.Array) -> pa.Array:
    doubtful = suspects(texts)
    out = []
    for row, text in enumerate(texts.to_pylist()):
        whole = bool(text) and complete(text) and not repeated(text) and ending_kind(text) != "cut"
        out.append(whole and not (doubtful[row] and is_garbled(text)))
    return pa.array(out, pa.bool_())


# A deterministic one would be worked out anew for every field that refers to it.
_readable = _readable.asNondeterministic()


def readable(text: Column) -> Column:
    """The whole call, once, uncut and without garbled characters. Null and empty texts aren't. (A whole call ends in a closing phrase,
    so its ending alone tells that it isn't cut.)"""
    return _readable(text)


def _prepared(corpus: DataFrame, feeds: DataFrame, attributes: list[str]) -> DataFrame:
    year, quarter = call_period(F.col("year").cast("double"), F.col("quarter").cast("double"), F.col("datacqtr"))
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in corpus.columns), F.lit(0))
    keys = corpus.withColumns({"__ticker": plain_ticker(F.col("ticker")), "__year": year, "__quarter": quarter}).where("__ticker is not null and __year is not null and __quarter is not null")
    rows = keys.select(
        "__ticker", "__year", "__quarter", readable(F.col("transcript")).alias("__readable"), filled.alias("__filled"), F.col("loaded_at").alias("__loaded"),
        F.col("corpus_id").alias("__id"), F.col("feed").alias("__feed"), F.col("transcript").isNotNull().alias("__has"),
        # In a struct: the planner would try every mixture of columns and their other names in the count of filled ones.
        F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(attributes))).alias("__fields"),
    )
    known = feeds.select(F.col("feed").alias("__feed"), F.col("trust").alias("__trust"))
    rows = rows.join(known, "__feed", "left").withColumn("__trust", F.coalesce("__trust", F.lit(-1)))
    return rows.withColumn("__rank", F.struct("__readable", "__trust", "__filled", "__loaded", (-F.col("__id")).alias("__back")))


def _best(present: Column, value: Column) -> Column:
    """Field-by-field survivorship: the value of the greatest (present, rank, value)."""
    return F.max(F.when(present, F.struct("__rank", value.alias("value"))))


def merged_records(corpus: DataFrame, feeds: DataFrame, attributes: list[str]) -> DataFrame:
    """Every group of two or more records with a survivor: ticker, year, quarter, corpus_id, n_records, and the attributes merged field by
    field. corpus_id is the record whose transcript survives."""
    rows = _prepared(corpus, feeds, attributes)
    fields = {
        "ticker": _best(F.lit(True), F.col("__ticker")), "year": _best(F.lit(True), F.col("__year")), "quarter": _best(F.lit(True), F.col("__quarter")),
        "transcript": _best(F.col("__has"), F.col("__id")), **{f"f{i}": _best(F.col(f"__fields.f{i}").isNotNull(), F.col(f"__fields.f{i}")) for i in range(len(attributes))},
    }
    groups = rows.groupBy("__ticker", "__year", "__quarter").agg(F.count("*").alias("n_records"), *(best.alias(f"__best_{name}") for name, best in fields.items()))
    chosen = groups.where("n_records >= 2 and __best_transcript.__rank.__readable")
    names = dict(zip(fields, ["ticker", "year", "quarter", "corpus_id", *attributes], strict=True))
    return chosen.select(*(F.col(f"__best_{field}.value").alias(name) for field, name in names.items()), "n_records")


def call_survivors(corpus: DataFrame, feeds: DataFrame) -> DataFrame:
    """ticker, year, quarter, corpus_id of the survivor of each group of two or more records: the merge of a call's own fields."""
    return merged_records(corpus, feeds, []).select("ticker", "year", "quarter", "corpus_id")


def with_transcripts(merged: DataFrame, corpus: DataFrame) -> DataFrame:
    """Merged records with the surviving transcript, fetched by id."""
    return merged.join(corpus.select("corpus_id", "transcript"), "corpus_id")
