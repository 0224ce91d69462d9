"""Dates, moments and quarters in many notations, brought to one form.

Every notation is one branch of a single regular expression with named groups. A value is matched once; the
groups come out as one array, calendar ranges are checked on integers, and instants are put together by
integer day arithmetic. Only the wall clock of a named region needs its zone rules, for which the JVM's
own table is asked.

Forms of the result: ``yyyy-MM-ddTHH:mm:ssZ`` (a moment, UTC), ``yyyy-MM-dd`` (a date only), ``yyyyQn``.
Null, blank, meaningless and impossible values (31 April, month 13, hour 25, quarter 5) give null. A time in a
gap of its zone moves on by the gap; a time that occurs twice is its first occurrence. A value without zone
whose record has no known home zone counts as UTC; an all-number date whose record has no known order is read
only if just one order is possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of months by number: English and German, with their usual short forms.
MONTHS = {
    1: "jan january januar jänner",
    2: "feb february februar",
    3: "mar march märz mrz",
    4: "apr april",
    5: "may mai",
    6: "jun june juni",
    7: "jul july juli",
    8: "aug august",
    9: "sep sept september",
    10: "oct october okt oktober",
    11: "nov november",
    12: "dec december dez dezember",
}
# Zone letters with a fixed offset in minutes.
OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "IST": 330, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
}
# Zone letters that name a region, whose offset depends on the day.
REGIONS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4}
QUARTER_STARTS = {"jan": 1, "apr": 2, "jul": 3, "oct": 4}

_NAME = r"\p{L}{3,9}"
_DAY_OF_WEEK = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)\p{L}*,? )?"
_CLOCK = (
    r"(?:(?:T| |, | at |, at )(?<hh>\d{1,2}):(?<mi>\d\d)(?::(?<ss>\d\d)(?:[.,]\d{1,9})?)?"
    r"(?: ?(?<ap>[ap])\.?m\.?)?(?: Uhr)?"
    r" ?(?<zo>(?:UTC|GMT)?[+-]\d{1,2}(?::?\d\d)?|\p{L}{1,5})?(?:\[(?<re>[\w/+-]+)\])?)?"
)
FORMATS = (
    r"(?<ep>\d{9,10})(?:\.\d+)?",
    r"(?<em>\d{12,13})",
    r"(?<ya>\d{4})(?<ma>\d\d)(?<da>\d\d)(?:T(?<hb>\d\d)(?<mb>\d\d)(?<sb>\d\d)?(?:\.\d+)?(?<zb>Z|[+-]\d\d(?::?\d\d)?)?)?",
    r"(?<yj>\d{4})年(?<mj>\d{1,2})月(?<dj>\d{1,2})日(?: ?(?<hj>\d{1,2})時(?:(?<nj>\d{1,2})分)?(?:(?<sj>\d{1,2})秒)?)?",
    r"(?:"
    r"(?<yi>\d{4})[-/.](?<mo>\d{1,2})[-/.](?<di>\d{1,2})"
    r"|(?<aa>\d{1,2})[-/.](?<bb>\d{1,2})[-/.](?<yn>\d{4}|\d\d)"
    rf"|{_DAY_OF_WEEK}(?<dd>\d{{1,2}})(?:\. |[ .-])(?<nd>{_NAME})\.?,?[ -](?<yd>\d{{4}}|\d\d)"
    rf"|{_DAY_OF_WEEK}(?<nm>{_NAME})\.? (?<dm>\d{{1,2}})(?:st|nd|rd|th)?,? (?<ym>\d{{4}})"
    rf"){_CLOCK}",
    r"(?:FY|CY|F|C)?(?<qa>\d{4})[ /-]?[FC]?Q(?<qb>\d)(?: \(cal\.?\))?",
    r"[FC]?Q(?<qc>\d)[ /-]?(?:FY|CY)?['’]?(?<qd>\d{4}|\d\d)",
    r"[FC]?(?<qe>\d)Q[ /-]?(?:FY|CY)?['’]?(?<qf>\d{4}|\d\d)",
    r"(?:FY|CY)['’]?(?<qg>\d{4}|\d\d)[ /-]?(?:Q(?<qh>\d)|(?<qi>\d)Q)",
    r"(?<qj>\d{4})\.(?<qk>\d)",
    r"(?<ql>jan|apr|jul|oct)\p{L}* ?[-–] ?\p{L}{3,9} (?<qm>\d{4})",
    r"(?<qn>first|second|third|fourth) quarter(?:,| of)? (?:FY|CY)?(?<qo>\d{4})",
)
PATTERN = "(?iu)^(?:" + "|".join(FORMATS) + ")$"
GROUPS = (
    "ep em ya ma da hb mb sb zb yj mj dj hj nj sj yi mo di aa bb yn dd nd yd nm dm ym hh mi ss ap zo re "
    "qa qb qc qd qe qf qg qh qi qj qk ql qm qn qo"
).split()
_MARK = "\u0001"
LEVELS = (
    ("__t", "__order", "__home"),
    ("__p",),
    ("__ap", "__h0", "__zone", "__y", "__swap"),
    ("__mo", "__d", "__h", "__mi", "__s", "__region", "__offset", "__leap"),
    ("__ok", "__yy"),
    ("__days",),
    ("__local",),
    ("__utc", "__qy", "__q"),
)


def _map(pairs: dict) -> str:
    """A SQL map literal; the keys and values here are short constants."""
    shown = ", ".join(f"'{k}', {v if isinstance(v, int) else repr(v)}" for k, v in pairs.items())
    return f"map({shown})"


def with_norm(df: DataFrame, value: str, zone: str, order: str, out: str = "norm") -> DataFrame:
    """Adds ``out``, the one form of ``value``; ``zone`` and ``order`` are columns with the record's home zone and date order."""
    part = {name: f"get(__p, {i + 1})" for i, name in enumerate(GROUPS)}
    number = lambda *names: "coalesce(" + ", ".join(f"try_cast({part[n]} as bigint)" for n in names) + ")"
    months = {word: n for n, words in MONTHS.items() for word in words.split()}
    full_year = lambda y: f"case when {y} < 70 then {y} + 2000 when {y} < 100 then {y} + 1900 else {y} end"
    first, second = number("aa"), number("bb")
    # With an unknown order, the number above 12 is the day.
    swapped = f"case upper(__order) when 'MDY' then false when 'DMY' then true when 'YMD' then true else case when {first} > 12 then true when {second} > 12 then false end end"
    offset = r"regexp_extract(__zone, '^(?:UTC|GMT)?([+-])(\\d{1,2}):?(\\d\\d)?$', %d)"
    steps = {
        "__t": r"trim(regexp_replace(%s, '[\\s\\u00a0\\u202f\\u2009\\u3000]+', ' '))" % f"`{value}`",
        # The groups of the one match, marked off (a written dollar sign would be taken for a variable); a text that doesn't match stays as it is and has no marks.
        "__p": f"transform(split(regexp_replace(__t, {_literal(PATTERN)}, replace({_literal(_MARK + _MARK.join('@{' + g + '}' for g in GROUPS))}, '@', '$')), '{_MARK}', -1), x -> nullif(x, ''))",
        "__order": f"`{order}`",
        "__home": f"`{zone}`",
        "__swap": swapped,
        "__y": full_year(number("ya", "yj", "yi", "yn", "yd", "ym")),
        "__mo": f"case when {part['aa']} is not null then case when __swap then {second} when not __swap then {first} end "
        f"else coalesce({number('ma', 'mj', 'mo')}, cast(try_element_at({_map(months)}, lower(coalesce({part['nd']}, {part['nm']}))) as bigint)) end",
        "__d": f"case when {part['aa']} is not null then case when __swap then {first} when not __swap then {second} end else {number('da', 'dj', 'di', 'dd', 'dm')} end",
        "__ap": f"lower({part['ap']})",
        "__h0": number("hb", "hj", "hh"),
        "__h": "case when __ap is null then __h0 when __h0 between 1 and 12 then __h0 % 12 + case __ap when 'p' then 12 else 0 end end",
        "__mi": f"coalesce({number('mb', 'nj', 'mi')}, 0)",
        "__s": f"coalesce({number('sb', 'sj', 'ss')}, 0)",
        "__zone": f"upper(coalesce({part['zb']}, {part['zo']}))",
        "__region": f"coalesce(try_element_at({_map(REGIONS)}, __zone), case when __zone is null then coalesce({part['re']}, __home, 'UTC') end)",
        "__offset": f"case when __zone is null then null when {offset % 1} <> '' then case {offset % 1} when '-' then -1 else 1 end * (60 * cast({offset % 2} as bigint) + coalesce(try_cast({offset % 3} as bigint), 0)) "
        f"else cast(try_element_at({_map(OFFSETS)}, __zone) as bigint) end",
        "__leap": "case when (__y % 4 = 0 and __y % 100 <> 0) or __y % 400 = 0 then 1 else 0 end",
        "__ok": "__y between 1000 and 9999 and __mo between 1 and 12 and __d between 1 and case when __mo = 2 then 28 + __leap when __mo in (4, 6, 9, 11) then 30 else 31 end",
        "__yy": "__y - case when __mo <= 2 then 1 else 0 end",
        "__days": "case when __ok then (__yy div 400) * 146097 + (__yy % 400) * 365 + (__yy % 400) div 4 - (__yy % 400) div 100 "
        "+ (153 * (__mo + case when __mo > 2 then -3 else 9 end) + 2) div 5 + __d - 1 - 719468 end",
        "__local": "case when __h between 0 and 23 and __mi between 0 and 59 and __s between 0 and 59 then __days * 86400 + __h * 3600 + __mi * 60 + __s end",
        "__utc": f"coalesce({number('ep')}, {number('em')} div 1000, case when __offset is not null then __local - 60 * __offset "
        "when __region is not null then unix_seconds(to_utc_timestamp(timestamp_seconds(__local), __region)) end)",
        "__qy": full_year(number("qa", "qd", "qf", "qg", "qj", "qm", "qo")),
        "__q": f"coalesce({number('qb', 'qc', 'qe', 'qh', 'qi', 'qk')}, cast(try_element_at({_map(QUARTER_STARTS)}, lower({part['ql']})) as bigint), cast(try_element_at({_map(ORDINALS)}, lower({part['qn']})) as bigint))",
        out: "case when __q between 1 and 4 then concat(cast(__qy as string), 'Q', cast(__q as string)) "
        "when __utc is not null then concat(cast(date_add(date'1970-01-01', cast(floor(__utc / 86400) as int)) as string), 'T', "
        "lpad(cast(pmod(__utc, 86400) div 3600 as string), 2, '0'), ':', lpad(cast(pmod(__utc, 3600) div 60 as string), 2, '0'), ':', lpad(cast(pmod(__utc, 60) as string), 2, '0'), 'Z') "
        "when __h0 is null and __days is not null then cast(date_add(date'1970-01-01', cast(__days as int)) as string) end",
    }
    # Each level is put in by a generator of one row, which keeps the optimizer from copying its
    # expressions into every later use of them.
    kept = [c for c in df.columns if c != out]
    for level in LEVELS:
        df = df.select("*", F.inline(F.array(F.struct(*(F.expr(steps[name]).alias(name) for name in level)))))
    return df.select(*(F.col(f"`{c}`") for c in kept), F.expr(steps[out]).alias(out))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dirty_time_values(tables: dict[str, tuple[DataFrame, str, list[str]]], feeds: DataFrame) -> DataFrame:
    """One row for each value that denotes something and is not yet in the one form.

    tables: table name -> (rows, id column, columns to read). feeds: feed, home_zone, date_order; it is a small list of
    sources and joins by hash with whatever strategy its size gives.
    """
    long = None
    for name, (df, key, columns) in tables.items():
        values = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in columns)))
        part = df.select(F.lit(name).alias("rec_table"), F.col(key).cast("bigint").alias("rec_id"), "feed", values.alias("v"))
        part = part.select("rec_table", "rec_id", "feed", "v.field", "v.value").where("value is not null")
        long = part if long is None else long.unionByName(part)
    known = feeds.select("feed", F.col("home_zone").alias("__fz"), F.col("date_order").alias("__fo"))
    joined = long.join(known, "feed", "left")
    return with_norm(joined, "value", "__fz", "__fo").where("norm is not null and norm <> value").select("rec_table", "rec_id", "field", "norm")
