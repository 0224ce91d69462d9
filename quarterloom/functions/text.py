"""Text scoring and sectioning as column expressions, all inside the JVM.

Nulls in give nulls out; an empty text has no tokens, no density and no section. Texts of any length are processed whole.
Long term lists go in as SQL text: as a set literal they are looked up by hash, and building thousands of literal
columns one by one from Python would take longer than the query.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The token pattern, the negators and the look-back.
TOKEN_PATTERN = "[a-z]+(?:'[a-z]+)?"
NEGATORS = ("no", "not", "never", "without", "don't", "doesn't", "didn't", "wasn't", "isn't", "aren't")
LOOK_BACK = 3

# The section markers in order of priority, and where in a text a marker may count.
SECTION_PATTERNS = (
    "question-and-answer session|question and answer session|question-and-answer period",
    "first question(?: today)?(?: comes| is| will come)?",
    "(?:next|first) question[^.?!]{0,40}from |your line is open|line is open",
)
SECTION_FROM, SECTION_TO = 0.15, 0.95
_FROM, _TO = "\ufdd0", "\ufdd1"

# Fixed values of the older, simpler path: split markers in order, plain words, figure patterns.
PLAIN_MARKERS = (
    "Question-and-Answer", "Q&A Session", "Question and Answer", "Operator", "Questions and Answers", "Q & A", "your first question comes from",
)
PLAIN_WORDS = (
    "may", "might", "could", "possibly", "uncertain", "uncertainty", "risk", "risks", "approximately", "believe", "believes", "depends",
    "fluctuate", "indefinite", "estimate", "estimates", "potential", "variable", "contingent", "anticipate", "outlook", "probable",
    "appears", "seem", "seems", "pending", "predict", "roughly",
)
FIGURE_PATTERNS = (
    r"This quarter revenue was \$?(\d+\.?\d*) billion",
    r"revenue (?:of|was) \$?(\d+\.?\d*) billion",
    r"revenue.*?\$(\d+\.?\d*) billion",
    r"\$(\d+\.?\d*) billion.*?revenue",
    r"Q\d.*?revenue.*?\$?(\d+\.?\d*)",
)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: Iterable[str]) -> str:
    return ", ".join(sql_text(v) for v in sorted(values))


def tokens(text: Column | str) -> Column:
    """Lower-case words in order; a straight apostrophe joins one suffix."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(TOKEN_PATTERN), F.lit(0))


def term_places(words: str, terms: Iterable[str]) -> Column:
    """The positions of terms in an array column of tokens, from 0; null for null."""
    chosen = sql_list(terms)
    if not chosen:
        return F.expr(f"if(`{words}` is null, null, cast(array() as array<int>))")
    return F.expr(f"filter(transform(`{words}`, (t, i) -> if(t in ({chosen}), i, -1)), i -> i >= 0)")


def negated_places(words: str, places: str) -> Column:
    """How many of the positions have a negator among the three tokens before."""
    negated = f"exists(slice(`{words}`, greatest(1, i - {LOOK_BACK - 1}), least(i, {LOOK_BACK})), w -> w in ({sql_list(NEGATORS)}))"
    return F.expr(f"if(`{words}` is null, null, cast(size(filter(`{places}`, i -> i > 0 and {negated})) as bigint))")


def with_scores(df: DataFrame, words: str, lexicons: Mapping[str, Iterable[str]], suffix: str, main: str = "uncertainty", keep: list[str] | None = None) -> DataFrame:
    """All metric columns of one tokenised text beside the columns to keep.

    Positions, then counts, each go through a generator of one row: the optimizer would otherwise repeat the
    expressions of one step in every use by the next.
    """
    keep = [c for c in df.columns if c != words] if keep is None else keep
    places = F.struct(*(term_places(words, terms).alias(f"__p_{c}") for c, terms in lexicons.items()))
    one = df.select("*", F.inline(F.array(places)))
    aside = F.struct(*(negated_places(words, f"__p_{c}").alias(f"__x_{c}") for c in lexicons))
    two = one.select("*", F.inline(F.array(aside)))
    total = F.expr(f"if(`{words}` is null, null, cast(size(`{words}`) as bigint))")
    out = [*(F.col(f"`{c}`") for c in keep), total.alias(f"total_tokens_{suffix}")]
    for category in lexicons:
        count = F.when(F.col(words).isNotNull(), F.size(f"__p_{category}").cast("bigint") - F.col(f"__x_{category}"))
        out.append(count.alias(f"{category}_count_{suffix}"))
        if category == main:
            out.append(F.col(f"__x_{category}").alias(f"negation_excluded_{suffix}"))
        out.append(density(count, total).alias(f"{category}_density_{suffix}"))
    return two.select(*out)


def density(count: Column | str, total: Column | str) -> Column:
    """T4: per 100 tokens; null without tokens."""
    count, total = (F.col(c) if isinstance(c, str) else c for c in (count, total))
    return F.try_divide(count.cast("double"), total.cast("double")) * F.lit(100.0)


def section_start(text: str, patterns: Iterable[str] = SECTION_PATTERNS, low: float = SECTION_FROM, high: float = SECTION_TO) -> Column:
    """T5: the offset, in code points from 0, of the first marker at a plausible place; patterns go by priority.

    Each pattern is run once: it marks off its matches with two characters that no text may hold. A match then begins where
    the pieces before it end.
    """
    size = f"length(`{text}`)"
    found = []
    for pattern in patterns:
        marked = f"split(regexp_replace(`{text}`, {sql_text('(?iu)' + pattern)}, '{_FROM}$0{_TO}'), '{_FROM}', -1)"
        # Of each piece but the first, what stands before the closing mark is the match; the sums leave the marks out.
        starts = (
            f"aggregate({marked}, named_struct('at', 0, 'all', cast(array() as array<int>)), "
            f"(s, x) -> named_struct('at', s.at + length(x) - if(instr(x, '{_TO}') > 0, 1, 0), 'all', concat(s.all, array(s.at))), s -> slice(s.all, 2, greatest(size(s.all) - 1, 0)))"
        )
        found.append(f"get(filter({starts}, k -> k >= {low}D * {size} and k <= {high}D * {size}), 0)")
    return F.expr(f"if({size} = 0, null, coalesce({', '.join(found)}))")


def section(text: str, start: str) -> Column:
    """The text from the marker on, marker included."""
    return F.expr(f"if(`{start}` is null, null, substring(`{text}`, `{start}` + 1, length(`{text}`)))")


def plain_section(text: str, markers: Iterable[str] = PLAIN_MARKERS) -> Column:
    """What follows the first marker of the list that occurs at all; else the whole text."""
    tests = " ".join(f"when instr(`{text}`, {sql_text(m)}) > 0 then substring(`{text}`, instr(`{text}`, {sql_text(m)}) + {len(m)}, length(`{text}`))" for m in markers)
    return F.expr(f"case {tests} else `{text}` end")


def plain_density(text: str, words: Iterable[str] = PLAIN_WORDS) -> Column:
    """Share of literal words among blank-separated ones, in percent with two decimals; null where there is no word."""
    parts = f"filter(split(lower(`{text}`), '\\\\s+'), w -> w <> '')"
    hits = f"size(filter({parts}, w -> w in ({sql_list(words)})))"
    return F.expr(f"if(`{text}` is null, null, round(try_divide(cast({hits} as double), cast(size({parts}) as double)) * 100D, 2))")


def figure_cascade(text: str, patterns: Iterable[str] = FIGURE_PATTERNS, reach: int = 5000) -> Column:
    """The number caught by the first pattern that matches the opening of the text (the opening is the feature)."""
    tests = " ".join(
        f"when left(`{text}`, {reach}) rlike {sql_text('(?iu)' + p)} then try_cast(regexp_extract(left(`{text}`, {reach}), {sql_text('(?iu)' + p)}, 1) as double)" for p in patterns
    )
    return F.expr(f"case {tests} end")
