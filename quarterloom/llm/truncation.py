"""Texts cut off by field limits or lost in transfer, and counts taken from such texts.

First the lengths of all texts under several encodings (characters, UTF-8, UTF-16, line ends as two, HTML and JSON escapes) are
counted per source, encoding and size. A size that holds far more texts than the sizes around it is a hidden limit of that source;
a source may have several. Then endings are inspected: after closing notes, lists of people, annotations and hesitation are
set aside, a text that stops without the end of a sentence, or with a mark of shortening, was cut; a known closing phrase that
merely lacks its full stop was not. A text that stops with a point that need not end a sentence ("up 6.", "Acme Inc.") was cut if it
is exactly as long as one of its source's limits allows.

Null and empty texts are not cut. Texts without a source have no limit and are judged by their ending. Limits need
``LEAST`` texts of one size; fewer can't be told from chance. Repeated rows count each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterloom.functions import text as X
from quarterloom.llm.columns import counts, text_bytes
from quarterloom.llm.garble import restore
from quarterloom.session import cut_lineage

#: A size is a limit if it holds so many texts, and more than the sizes within ``NEAR`` of it by ``LEAST`` and ``FAR`` deviations.
LEAST, NEAR, FAR = 3, 100, 6.0
ENCODINGS = ("chars", "utf8", "utf16", "crlf", "html", "json")

# Phrases that end a call. A text that stops with one of them, full stop or not, is whole.
CLOSERS = (
    "you may now disconnect", "this concludes the program", "thank you for joining", "ready for questions", "goodbye", "have a good day",
    "thank you for participating", "thank you for your participation", "speak again soon", "thats all from me",
)
_HEADING = re.compile(r"(?:^|\n)\s*(?:call |conference |corporate )*participants:?\s*\n", re.I)
#: Words in a line of a list of people at most; a line of more is speech.
_ENTRY = 14
_NOTE = re.compile(
    r"(?:^|(?<=\n)|(?<=[.?!]))\s*(?:\*{3,}|[—–�?-]{1,3} ?END ?[—–�?-]{1,3}|\[(?:call|transcript|recording)[^\]\n]{0,40}\]|(?:end|close) of (?:the )?(?:transcript|call|recording)\.?"
    r"|duration: ?\d+ ?(?:minutes|min|mins)\.?|\(c\) [^\n]{1,60}|©[^\n]{1,60}|copyright [^\n]{1,60}|goodbye\.?)\s*$",
    re.I,
)
_MARK = re.compile(r"(?:\.\.\.|…|&hellip;|\((?:more|cont\w*)\)|\[(?:truncated|cut|more|cont\w*|\.\.\.|…)\])$", re.I)
_SOUND = r"(?:um+|uh+m?|er+m?|ah+|h?mm+|you know|i mean|sort of|like)"
_TRAIL = re.compile(rf"[\s,–-]*(?:\b{_SOUND}\b[,.…]*[\s–-]*|\[[a-z ]{{2,30}}\]|\([a-z ]{{2,30}}\)|\{{[a-z ]{{2,30}}\}}|<[a-z ]{{2,30}}>|\*[a-z ]{{2,30}}\*|♪[\s♪]*)$", re.I)
_INNER = re.compile(rf"\[[^\]\n]{{1,40}}\]|\([^)\n]{{1,40}}\)|\{{[^}}\n]{{1,40}}\}}|<[^>\n]{{1,40}}>|\*[^*\n]{{1,40}}\*|♪|\b{_SOUND}\b", re.I)
_STOP = re.compile(r"[.?!][\"'”’)\]]*$")


_DOUBTFUL = re.compile(r"(?:\d|\b(?:Inc|Ltd|Co|Corp|plc|Mr|Mrs|Ms|Dr|St|No|vs|approx|U\.S|[A-Z]))\.$")


def without_list(text: str) -> str:
    """The text without a list of people at its end: a heading after which no line is long enough for speech."""
    if "articipants" not in text and "ARTICIPANTS" not in text:
        return text
    start = len(text)
    for line in reversed(text.split("\n")):
        if len(line.split(None, _ENTRY + 1)) > _ENTRY:
            break
        start -= len(line) + 1
    m = _HEADING.search(text, max(0, start))
    return text[: m.start()] if m else text


def ending_kind(text: str | None) -> str:
    """``whole``, ``cut``, or ``doubtful``: stops with a point that need not end a sentence, which only the length can judge."""
    if text is None:
        return "whole"
    body, size = without_list(text).rstrip(), 500
    while (kind := _judged(body[-size:])) is None and size < len(body):
        # Nothing but notes so far: look further back.
        size *= 4
    return kind or "whole"


def _judged(t: str) -> str | None:
    """The kind of an ending, or None if only closing notes and sounds are in it."""
    if not t.isascii():
        t = restore(t)[0].rstrip()
    while (short := _NOTE.sub("", t).rstrip()) != t:
        t = short
    if not t:
        return None
    if _MARK.search(t) and not re.search(rf"\b{_SOUND}(?:\.\.\.|…)$", t, re.I):
        return "cut"
    while (short := _TRAIL.sub("", t).rstrip()) != t:
        t = short
    if not t:
        return None
    if _STOP.search(t):
        return "doubtful" if _DOUBTFUL.search(t) else "whole"
    words = re.sub(r"[^a-z ]", "", _INNER.sub(" ", t[-200:]).lower())
    words = re.sub(r" +", " ", words).strip()
    return "whole" if words.endswith(CLOSERS) else "cut"


@F.arrow_udf(T.StringType())
def _ending(texts: pa.Array) -> pa.Array:
    return pa.array(["whole" if x is None else ending_kind(x) for x in texts.to_pylist()], pa.string())


# A deterministic one would be worked out twice, for the filter on its result and again above it.
_ending = _ending.asNondeterministic()


def ending(text: Column) -> Column:
    """The kind of a text's ending. Most texts plainly end with a sentence and are settled by their last characters."""
    last = F.right(F.rtrim(F.regexp_replace(F.right(text, F.lit(40)), r"\s", " ")), F.lit(6))
    plain = last.rlike(r"(?:[a-z][a-z][a-z][a-z]\.|[?!])$")
    return _ending(F.when(~plain, text))


def is_cut(text: Column) -> Column:
    """Cut by its ending alone."""
    return ending(text) == "cut"


def lengths(texts: pa.Array) -> dict[str, np.ndarray]:
    """Lengths of texts under the encodings a store may have counted in, from the bytes of the whole column."""
    data, starts = text_bytes(texts)
    many = lambda char: counts(data == ord(char), starts)
    octets = np.diff(starts)
    chars = octets - counts((data & 0xC0) == 0x80, starts)
    lines, quotes, ands = many("\n"), many('"'), many("&")
    return {
        "chars": chars, "utf8": octets,
        # Characters beyond the first plane are two units.
        "utf16": chars + counts(data >= 0xF0, starts),
        "crlf": chars + lines, "html": chars + 4 * ands + 3 * (many("<") + many(">")) + 5 * quotes, "json": chars + lines + quotes + many("\\") + many("\t"),
    }


_SIZES = T.StructType([T.StructField(e, T.LongType()) for e in ENCODINGS])


@F.arrow_udf(_SIZES)
def _measured(texts: pa.Array) -> pa.Array:
    found = lengths(texts)
    return pa.StructArray.from_arrays([pa.array(found[e], pa.int64()) for e in ENCODINGS], names=list(ENCODINGS))


def with_lengths(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and ``sizes``: (encoding, size) of the text."""
    one = df.select(*keep, _measured(F.col(text)).alias("__m"))
    return one.select(*keep, F.array(*(F.struct(F.lit(e).alias("encoding"), F.col(f"__m.{e}").alias("size")) for e in ENCODINGS)).alias("sizes"))


def length_piles(df: DataFrame, text: str, source: str) -> DataFrame:
    """source, encoding, size, at: how many of all texts have which size. Partial counts merge; texts aren't moved."""
    rows = df.where(F.length(f"`{text}`") > 0).select(F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("__text")).where("source is not null")
    return with_lengths(rows, "__text", ["source"]).select("source", F.inline("sizes")).groupBy("source", "encoding", "size").agg(F.count("*").alias("at"))


def storage_limits(piles: DataFrame) -> DataFrame:
    """The hidden limits: source, encoding, size, how many texts lie exactly there, and how many a size near it holds on average.

    Where a size stands out under several encodings, those with the most texts there stay (ties side by side).
    """
    # A window holds the sizes of one source under one encoding: no more than the longest text has characters.
    near = Window.partitionBy("source", "encoding").orderBy("size").rangeBetween(-NEAR, NEAR)
    around = piles.withColumn("near", (F.sum("at").over(near) - F.col("at")) / F.lit(2.0 * NEAR))
    tops = around.where(F.col("at") >= LEAST + F.col("near") + FAR * F.sqrt("near"))
    best = tops.groupBy("source", "size").agg(F.max("at").alias("__best"))
    return tops.join(best, ["source", "size"]).where("at = __best").select("source", "encoding", "size", "at", "near")


def open_endings(df: DataFrame, key: str, text: str, source: str, recount: bool = False) -> DataFrame:
    """Records whose ending is open or doubtful: rec_id, source, kind, sizes under each encoding, and if asked for the number
    of tokens of the text's section, counted where the text is read."""
    rows = df.select(F.col(f"`{key}`").alias("rec_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("__text"))
    rows = rows.withColumn("kind", ending(F.col("__text"))).where("kind <> 'whole'")
    # Generators of one row keep what follows behind the filter.
    rows = with_lengths(rows, "__text", ["rec_id", "source", "kind", "__text"])
    if not recount:
        return rows.drop("__text")
    starts = rows.select("*", F.inline(F.array(F.struct(X.section_start("__text").alias("__start")))))
    again = starts.select("rec_id", "source", "kind", "sizes", F.inline(F.array(F.struct(X.tokens(X.section("__text", "__start")).alias("__words")))))
    return again.select("rec_id", "source", "kind", "sizes", F.expr("if(__words is null, null, cast(size(__words) as bigint))").alias("again"))


def cut_records(df: DataFrame, key: str, text: str, source: str, recount: bool = False) -> DataFrame:
    """The cut records by rec_id (and ``again``, the tokens of the cut section): open endings, and doubtful ones that are exactly as long
    as a limit of their source."""
    limits = storage_limits(length_piles(df, text, source)).groupBy("source").agg(F.collect_set(F.struct("encoding", "size")).alias("limits"))
    found = open_endings(df, key, text, source, recount).join(limits, "source", "left")
    cut = found.where("kind = 'cut' or arrays_overlap(sizes, limits)")
    return cut.select("rec_id", *(["again"] if recount else []))


def with_counts(cut: DataFrame, counted: DataFrame, key: str, link: str, count: str) -> tuple[DataFrame, DataFrame]:
    """The cut records, and the rows whose count was taken from the cut text of the record they link to: counting on the cut
    text gives the same. cut: rec_id, again. Both by rec_id."""
    # Few small rows, used twice: written once.
    cut = cut_lineage(cut)
    rows = counted.where(F.col(count).isNotNull()).select(F.col(key).alias("rec_id"), F.col(link).alias("__link"), F.col(count).alias("__count"))
    told = rows.join(cut.select(F.col("rec_id").alias("__link"), "again").distinct(), "__link").where("__count = again").select("rec_id")
    return cut.select("rec_id"), told


def cut_shares(df: DataFrame, key: str, text: str, source: str, cut: DataFrame) -> DataFrame:
    """How often each source cuts: records with a text, cut ones, and their share."""
    texts = df.where(F.length(text) > 0).select(F.col(key).alias("rec_id"), F.col(source).alias("source"))
    marked = texts.join(cut.withColumn("__cut", F.lit(1)), "rec_id", "left")
    out = marked.groupBy("source").agg(F.count("*").alias("n_texts"), F.count("__cut").alias("n_cut"))
    return out.withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))
