"""Small expressions of the panel: quarter axis, labels, buckets, rounding, escaping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quarter_index(year: Column | str, quarter: Column | str) -> Column:
    """Quarters as consecutive whole numbers."""
    return (_col(year).cast("bigint") * 4 + _col(quarter).cast("bigint") - 1).cast("bigint")


def quarter_key(year: Column | str, quarter: Column | str) -> Column:
    """2024Q4."""
    return F.concat(_col(year).cast("int").cast("string"), F.lit("Q"), _col(quarter).cast("int").cast("string"))


def quarter_label(year: Column | str, quarter: Column | str) -> Column:
    """Q4 '24."""
    return F.format_string("Q%d '%02d", _col(quarter).cast("int"), F.pmod(_col(year).cast("int"), F.lit(100)))


def strip(text: Column | str) -> Column:
    """All white space off both ends, not blanks only."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def tomorrow() -> Column:
    """The day after today, up to which prices are asked for."""
    return F.date_add(F.current_date(), 1)


def clip(value: Column | str, low: Column | str, high: Column | str) -> Column:
    """Into [low, high]; null stays null."""
    value = _col(value)
    return F.when(value.isNotNull(), F.greatest(_col(low), F.least(_col(high), value)))


def p_bucket(p: Column | str) -> Column:
    """The first of four bounds that p lies below, else p with two decimals."""
    p, out = _col(p), None
    for bound in ("0.001", "0.01", "0.02", "0.05"):
        test = p < F.lit(float(bound))
        out = F.when(test, f"< {bound}") if out is None else out.when(test, f"< {bound}")
    return out.when(p.isNotNull(), F.format_string("= %.2f", p))


def escape_html(text: Column | str) -> Column:
    out = _col(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def contains_query(columns: list[Column | str], query: str) -> Column:
    """Any column holds the trimmed query, whatever the case; an empty query is held by all."""
    wanted = F.lit(query.strip().upper())
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.upper(_col(c)), wanted), F.lit(False))
    return out | (wanted == "")


@F.pandas_udf(T.DoubleType())
def round_exact(value: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounds the exact binary value, half to even, as Python does; Spark's round goes by the shortest decimal form."""
    return pd.Series([None if x is None or x != x else round(float(x), int(k)) for x, k in zip(value, digits)], dtype="float64")
