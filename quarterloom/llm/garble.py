"""Text decoded with the wrong character encoding: finding it and restoring it.

For every pair of encodings the garbled sequences are worked out beforehand. UTF-8 read by a single-byte decoder, once, or twice by
any two decoders, gives sequences of several characters; one multi-pattern automaton over all of them finds the spans. Sequences
that are also ordinary letters side by side (UTF-8 read as Cyrillic) count only where no letter of that script stands beside them,
so correct Russian stays. One single-byte encoding read as another gives one character for one, which only its surroundings can
tell: a sign or a letter of another script inside a Latin word, words of accented letters alone, Cyrillic words in
reversed case; the pair that explains all of a text's evidence restores it. Only matched spans are replaced.

What was lost in encoding (replacement characters, question marks inside words or for dashes, control characters) is found as
well; a question mark in a contraction gets its apostrophe back, the rest cannot be had and stays. A question mark after a blank counts
only if a lower-case word follows outside French, whose typography it is, or the text has other damage.

Null and empty texts are never garbled and come back as they are. Texts of any length are handled whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterloom.llm.columns import rows_of, text_bytes

WRONG_DECODERS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")
# Characters that may have been garbled, by two decoders too: Latin letters and signs, Greek, Cyrillic, punctuation, currency, signs, music.
REPERTOIRE = ((0xA0, 0x17F), (0x391, 0x3C9), (0x401, 0x45F), (0x2010, 0x2044), (0x20A0, 0x20BF), (0x2100, 0x2122), (0x2190, 0x2193), (0x2200, 0x2265), (0x2660, 0x266F), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF))
# By one decoder: Hebrew, Arabic, kana, emoji; and by the two most common ones: ideographs and Hangul.
REPERTOIRE_ONCE = ((0x5D0, 0x5EA), (0x621, 0x64A), (0x3001, 0x30FF), (0xFF01, 0xFF9F), (0x1F300, 0x1FAFF))
REPERTOIRE_COMMON = ((0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
# (true, wrong) single-byte encodings of Latin text that are told apart by signs and foreign letters inside words.
LATIN_PAIRS = tuple((a, b) for a in ("cp1252", "mac_roman", "cp437", "cp850") for b in ("cp437", "cp850", "mac_roman", "cp1251", "cp1252", "cp1253", "koi8-r") if a != b)
_CONTROL = "\u0080-\u009f"
_CONTRACTION = re.compile(
    r"(?:\b[a-z]+n(?=\?t\b)|\bI(?=\?m\b)|\b(?:I|you|we|they|he|she|it|that|there|what|who|how|where|let|would|could|should|might|must)(?=\?(?:s|ve|re|ll|d)\b)|\b[a-z]{4,}(?=\?s\b))\?", re.I
)
_LOST = re.compile(r"(?<=[a-zß-ÿ])\?(?=[a-zß-ÿ])|(?<=[A-ZÀ-Þ])\?(?=[^\W\d_])|(?<=[^\W\d_])\?(?=[,;:])|(?<=\s)\?+(?=[^\W\d_])")
_APART = re.compile(r"(?<=\s)\?+(?=\s)")
# Words that tell French.
_FRENCH = re.compile(r"\b(?:est|les|une|vous|nous|que|qui|pas|elle|oui|avec|pour|c['’]est|qu['’]\w+|d['’]\w+|l['’]\w+)\b", re.I)
# Signs that may stand inside a Latin word by right.
_ALLOWED = set("‘’·‐‑‒–—…ªº°®™©¹²³×÷±µ−√∞≤≥≠≈/") | {"\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\xa0", "\u2028", "\u2029"}
_ACCENTED = re.compile(r"(?<![^\W\d_])[À-ÿ¨¸]{4,}(?![^\W\d_])")
_ACCENTED_ALL = re.compile(r"(?<![^\W\d_])[À-ÿ¨¸]+(?![^\W\d_])")
_REVERSED = re.compile(r"(?<![^\W\d_])[а-яё][А-ЯЁ]{2,}(?![^\W\d_])")


@functools.cache
def _letters(codec: str) -> tuple[str, ...]:
    """What each byte is read as; undefined bytes come out as the control characters of the same number."""
    return tuple(bytes([b]).decode(codec, "replace").replace("�", chr(b)) for b in range(256))


def _decode(data: bytes, codec: str) -> str:
    return "".join(map(_letters(codec).__getitem__, data))


def _points(ranges) -> Iterator[str]:
    return (chr(p) for low, high in ranges for p in range(low, high + 1))


@functools.cache
def sequences() -> dict[str, str]:
    """Garbled sequence -> the character it stands for: UTF-8 by every wrong decoder, and by every two of them."""
    table: dict[str, str] = {}

    def add(seq: str, char: str) -> None:
        if len(seq) > 1 and not seq.isspace():
            table.setdefault(seq, char)

    plans = ((REPERTOIRE, WRONG_DECODERS), (REPERTOIRE_ONCE, WRONG_DECODERS), (REPERTOIRE_COMMON, WRONG_DECODERS[:2]))
    for ranges, codecs in plans:
        for char in _points(ranges):
            for codec in codecs:
                add(_decode(char.encode(), codec), char)
    for char in _points(REPERTOIRE):
        for first in WRONG_DECODERS:
            once = _decode(char.encode(), first).encode()
            for second in sorted(WRONG_DECODERS, key=lambda c: c != first):
                add(_decode(once, second), char)
    return table


def _script(char: str) -> str:
    """Cyrillic or Greek, for letters; else nothing."""
    return "" if not char.isalpha() else "c" if "\u0400" <= char <= "\u052f" else "g" if "\u0370" <= char <= "\u03ff" else ""


@functools.cache
def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for seq, char in sequences().items():
        scripts = {_script(c) for c in seq}
        # The one script of a sequence that could be ordinary text.
        machine.add_word(seq, (len(seq), char, scripts.pop() if len(scripts) == 1 else ""))
    machine.make_automaton()
    return machine


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what it stands for) of the garbled sequences."""
    found = [(end - length + 1, end + 1, char, script) for end, (length, char, script) in automaton().iter_long(text)]
    out, k = [], 0
    while k < len(found):
        # A run of neighbours is judged as one.
        last = k
        while last + 1 < len(found) and found[last + 1][0] == found[last][1]:
            last += 1
        run = found[k : last + 1]
        scripts = {script for *_, script in run}
        script = scripts.pop() if len(scripts) == 1 else ""
        beside = text[run[0][0] - 1 : run[0][0]] + text[run[-1][1] : run[-1][1] + 1]
        if not script or not any(_script(c) == script for c in beside):
            out += [one[:3] for one in run]
        k = last + 1
    return out


@functools.cache
def _strangers() -> tuple[re.Pattern, list[dict[str, str]]]:
    """Characters that no Latin word holds, between Latin letters, and for every pair what they stand for."""
    maps = []
    for true, wrong in LATIN_PAIRS:
        one = {w: t for t, w in zip(_letters(true)[128:], _letters(wrong)[128:], strict=True) if t != w and t.isalpha() and t.isprintable() and (t < "\u0250")}
        maps.append(one)
    strange = {c for one in maps for c in one if c not in _ALLOWED and not ("\xc0" <= c < "\u0250" and c.isalpha()) and not c.isspace() and c.isprintable()}
    return re.compile("(?<=[A-Za-z])[" + re.escape("".join(sorted(strange))) + "]+(?=[a-z])"), maps


def single_byte(text: str) -> list[tuple[int, int, str]]:
    """Spans of single-byte text read by another single-byte decoder."""
    if text.isascii():
        return []
    out = []
    pattern, maps = _strangers()
    hits = list(pattern.finditer(text))
    if hits:
        signs = {c for m in hits for c in m.group()}
        fit = [one for one in maps if all(one.get(c, "").islower() for c in signs)]
        for m in hits:
            out.append((m.start(), m.end(), "".join(fit[0][c] for c in m.group()) if fit else m.group()))
    words = list(_ACCENTED.finditer(text))
    if words and all(m.group().encode("latin-1").decode("cp1251").isalpha() for m in words):
        # With such words in it, the short ones of the text are of the same kind.
        out += [(m.start(), m.end(), m.group().encode("latin-1").decode("cp1251")) for m in _ACCENTED_ALL.finditer(text)]
    if _REVERSED.search(text) and not re.search("[а-яё]{3,}", text):
        # No word is in lower case: the case of all is reversed.
        out += [(m.start(), m.end(), m.group().encode("cp1251").decode("koi8-r")) for m in re.finditer("[Ѐ-џ]+", text) if m.group().encode("cp1251", "ignore").decode("cp1251") == m.group()]
    return sorted(out)


def lost_marks(text: str, damaged: bool = False) -> list[int]:
    """Places of question marks that stand for a lost character; those of addresses and real questions don't. damaged: the text
    has other damage, so that marks after blanks count too."""
    if "?" not in text:
        return []
    out = []
    for m in _LOST.finditer(text):
        start = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
        end = re.compile(r"\s|$").search(text, m.end()).start()
        if not re.search(r"[/=@&]|\w\.\w+\?", text[start:end]):
            out.extend(range(m.start(), m.end()))
    damaged = damaged or bool(out)
    for m in _APART.finditer(text):
        if damaged or (re.match(r"\s+[a-z]", text[m.end() : m.end() + 9]) and not _FRENCH.search(text[max(0, text.rfind("\n", 0, m.start())) : m.start()][-300:])):
            out.extend(range(m.start(), m.end()))
    return sorted(out)


def _replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for start, end, char in found:
        if start >= last:
            parts += [text[last:start], char]
            last = end
    return "".join(parts) + text[last:]


def restore(text: str) -> tuple[str, int, int]:
    """The text with matched spans put right, the number of spans, and the number of characters that stay lost."""
    found = spans(text)
    fixed = _replaced(text, found) if found else text
    more = single_byte(fixed)
    unknown = sum(fixed[a:b] == char for a, b, char in more)
    fixed = _replaced(fixed, more) if more else fixed
    number = len(found) + len(more) - unknown
    gone = sum(c == "�" or "\x80" <= c <= "\x9f" for c in fixed) if not fixed.isascii() else 0
    marks = lost_marks(fixed, bool(number or gone))
    lost = gone + unknown
    if marks:
        mended = {m.end() - 1 for m in _CONTRACTION.finditer(fixed)}
        chars = list(fixed)
        for at in marks:
            if at in mended:
                chars[at] = "’"
                number += 1
            else:
                lost += 1
        fixed = "".join(chars)
    return fixed, number, lost


def is_garbled(text: str) -> bool:
    if "�" in text or re.search(f"[{_CONTROL}]", text):
        return True
    return bool(spans(text)) or bool(single_byte(text)) or bool(lost_marks(text))


def suspects(texts: pa.Array) -> np.ndarray:
    """Rows that may be garbled, from their bytes: two neighbouring characters beyond ASCII, a control or replacement
    character, a sign or foreign letter right after a Latin one, or a question mark between letters, between blanks, or before a comma or
    colon. No garbled text escapes this; it spares clean ones the rest."""
    data, starts = text_bytes(texts)
    marked = np.zeros(len(starts) - 1, bool)
    if len(data) > 1:
        here, after = data[:-1], data[1:]
        latin = lambda x: ((x | 0x20) >= 0x61) & ((x | 0x20) <= 0x7A)
        high = np.flatnonzero(here >= 0x80)
        h, a = here[high], after[high]
        pairs = ((h & 0xC0) == 0x80) & (a >= 0xC0)
        pairs |= (h == 0xC2) & (a < 0xA0) & (a >= 0x80)
        pairs |= (h == 0xEF) & (a == 0xBF)
        # After a Latin letter: anything but Latin letters and the marks that most often stand there.
        third = data[np.minimum(high + 2, len(data) - 1)]
        usual = ((h >= 0xC3) & (h <= 0xC9)) | ((h == 0xE2) & (a == 0x80) & ((third == 0x99) | (third == 0x98) | (third == 0x93) | (third == 0x94) | (third == 0xA6)))
        pairs |= (high > 0) & latin(here[np.maximum(high - 1, 0)]) & ~usual
        places = high[pairs]
        marks = np.flatnonzero(data == 0x3F)
        marks = marks[marks + 1 < len(data)]
        follow = data[marks + 1]
        before = data[np.maximum(marks - 1, 0)]
        word = lambda x: latin(x) | (x >= 0x80)
        blank = lambda x: (x == 0x20) | ((x >= 0x09) & (x <= 0x0D)) | (x == 0x3F)
        stop = (follow == 0x2C) | (follow == 0x3A) | (follow == 0x3B)
        marks = marks[(word(before) & (word(follow) | stop)) | (blank(before) & (word(follow) | blank(follow)))]
        marked[rows_of(np.concatenate([places, marks]), starts)] = True
    return marked


@F.arrow_udf(T.BooleanType())
def _garbled(texts: pa.Array) -> pa.Array:
    out = suspects(texts)
    for row in np.flatnonzero(out):
        out[row] = is_garbled(texts[int(row)].as_py() or "")
    return pa.array(out)


_RESTORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.LongType()), T.StructField("lost", T.LongType())])


@F.pandas_udf(_RESTORED)
def _restored(text: pd.Series) -> pd.DataFrame:
    rows = [(None, 0, 0) if x is None else restore(x) for x in text]
    return pd.DataFrame(rows, columns=["text", "spans", "lost"])


def garbled(text: Column) -> Column:
    """Whether a text holds a wrongly decoded or encoded character; null is not garbled."""
    return _garbled(text)


def garbled_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of records with garbled text, as rec_id."""
    return df.select(F.col(f"`{key}`").alias("rec_id"), F.col(f"`{text}`").alias("__text")).where(garbled(F.col("__text"))).select("rec_id")


def garbled_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """The same records with their restored text, the number of spans put right and of characters still lost."""
    found = df.select(F.col(f"`{key}`").alias("rec_id"), F.col(f"`{text}`").alias("__text")).where(garbled(F.col("__text")))
    return found.select("rec_id", _restored("__text").alias("r")).select("rec_id", F.col("r.text").alias("restored"), F.col("r.spans"), F.col("r.lost"))
