"""Word lexicons: lists are data, read from a folder of one-term-per-line files, with a size guard each.

Without a folder, a short list of common words per category serves tests and demonstrations; the queries read lists of full size from
files, whose terms are derived from the short ones by rule.
"""

from __future__ import annotations

import itertools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterloom.session import checkpoint_folder

CATEGORIES = ("uncertainty", "negative", "positive", "litigious", "constraining")
CONTROLS = ("negative", "positive", "litigious", "constraining")
# A complete list of each category has at least so many terms.
LEAST_TERMS = {"uncertainty": 290, "negative": 2300, "positive": 350, "litigious": 890, "constraining": 180}
DEFAULT_TERMS = {
    "uncertainty": "almost anticipate anticipated approximately assume assumed assuming believe could depend depends doubt exposure fluctuate "
    "fluctuating may might perhaps possible possibly predict probably risk risks roughly seems uncertain uncertainty unclear uneven "
    "unpredictable variable volatile volatility",
    "negative": "adverse against challenging cancelled cautious closed decline declined delay difficult disappointing dispute loss losses lower "
    "mixed problem problems slower slowing softer weak weaker weakness worse",
    "positive": "achieve advance advantage best better encouraging gain gains good great healthy improve improved pleased profitable resilient "
    "solid strong stronger success",
    "litigious": "claim claims contract contracts court covenant dispute legal liability settled settlement regulators regulatory statutory",
    "constraining": "bound commit committed constraints covenant limit limited obligation obligations pledge prevent required restrict restricted",
}


# The sizes of complete lists.
FULL_SIZES = {"uncertainty": 297, "negative": 2355, "positive": 354, "litigious": 904, "constraining": 184}
_PREFIXES = ("", "un", "re", "over", "under", "non", "mis", "pre", "out", "counter", "inter", "super")
_SUFFIXES = ("", "s", "ed", "ing", "ly", "ness", "able", "ment", "er", "ers")


def full_terms(category: str) -> list[str]:
    """A list of full size by rule: our short list first, then its words with suffixes and prefixes, up to the size of a complete one."""
    words = DEFAULT_TERMS[category].split()
    made = dict.fromkeys(prefix + word + suffix for prefix, suffix in sorted(itertools.product(_PREFIXES, _SUFFIXES), key=lambda p: len(p[0] + p[1])) for word in words)
    return list(itertools.islice(made, FULL_SIZES[category]))


def written_lexicons(spark: SparkSession) -> str:
    """A folder with the lists of full size, one term per line, in the shared folder of the session; written once per application."""
    folder = os.path.join(checkpoint_folder(spark), f"lexicons-{spark.sparkContext.applicationId}")
    if _WRITTEN.get("folder") != folder:
        for category in CATEGORIES:
            terms = spark.createDataFrame([(t,) for t in full_terms(category)], "term string").coalesce(1)
            terms.write.mode("overwrite").text(os.path.join(folder, f"{category}.txt"))
        _WRITTEN.update(folder=folder, lists=lexicons(spark, folder))
    return folder


def loaded_lexicons(spark: SparkSession) -> dict[str, frozenset[str]]:
    """The lists of full size, read from their files and checked for size."""
    written_lexicons(spark)
    return _WRITTEN["lists"]


_WRITTEN: dict = {}


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """S3: trimmed, lower-case, distinct terms of a text file; blank lines don't count."""
    term = F.lower(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return spark.read.text(path).select(term.alias("term")).where("length(term) > 0").distinct()


def load_terms(spark: SparkSession, path: str, least: int) -> frozenset[str]:
    """The terms as a set of bounded size (a word list); fails loudly where the list is shorter than it should be."""
    terms = frozenset(r.term for r in read_terms(spark, path).collect())
    if len(terms) < least:
        raise ValueError(f"{path} holds {len(terms)} terms; expected at least {least}")
    return terms


def lexicons(spark: SparkSession | None = None, folder: str | None = None, categories=CATEGORIES, name: str = "{}.txt", least: dict[str, int] | None = None) -> dict[str, frozenset[str]]:
    """Category -> terms. folder: files named by ``name``; else our short lists."""
    if folder is None:
        return {c: frozenset(DEFAULT_TERMS[c].split()) for c in categories}
    return {c: load_terms(spark, os.path.join(folder, name.format(c)), (least or LEAST_TERMS)[c]) for c in categories}


def lexicon_table(spark: SparkSession, lists: dict[str, frozenset[str]]) -> DataFrame:
    """The registry as rows (category, term)."""
    return spark.createDataFrame([(c, t) for c, terms in lists.items() for t in sorted(terms)], "category string, term string")
