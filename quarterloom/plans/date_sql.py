"""SQL that brings a call's earnings_date to its UTC day, by other means than operators.timestamps: one pattern per order of parts."""

from __future__ import annotations

from quarterloom.operators.timestamps import OFFSETS, REGIONS

_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12}
_month = lambda word: f"case left(lower(replace({word}, 'ä', 'a')), 3) " + " ".join(f"when '{m}' then {n}" for m, n in _MONTHS.items()) + " end"
_part = lambda pattern, n: f"regexp_extract(t, '{pattern}', {n})"
_num = lambda pattern, n: f"try_cast({_part(pattern, n)} as int)"

_YMD = r"^(\d{4})(?:[-/.]|年)(\d{1,2})(?:[-/.]|月)(\d{1,2})日?([^\d].*)?$"
_PLAIN = r"^(\d{4})(\d\d)(\d\d)(T\d.*)?$"
_NUMBERS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d\d)([^\d].*)?$"
_DMY = r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})\.?[ -]([A-Za-zä]{3,9})\.?[ -](\d{4}|\d\d)([^\d].*)?$"
_MDY = r"^([A-Za-zä]{3,9})\.? (\d{1,2}),? (\d{4})([^\d].*)?$"
_ZONES = " ".join(f"when '{z}' then {m}" for z, m in OFFSETS.items())
_REGION = " ".join(f"when '{z}' then '{r}'" for z, r in REGIONS.items())


def _case(pattern: str, year: str, month: str, day: str) -> str:
    return f"when regexp_matches(t, '{pattern}') then {{{{'y': {year}, 'm': {month}, 'd': {day}, 'rest': {_part(pattern, 4)}}}}}".replace("{{", "{").replace("}}", "}")


_full = lambda n: f"case when {n} < 100 then 2000 + {n} else {n} end"
_A, _B = _num(_NUMBERS, 1), _num(_NUMBERS, 2)
_ORDER = f"case when date_order = 'mdy' then true when date_order = 'dmy' then false when {_A} > 12 then false when {_B} > 12 then true end"
_PARTS = (
    "case "
    + _case(_PLAIN, _num(_PLAIN, 1), _num(_PLAIN, 2), _num(_PLAIN, 3)) + " "
    + _case(_YMD, _num(_YMD, 1), _num(_YMD, 2), _num(_YMD, 3)) + " "
    + _case(_NUMBERS, _full(_num(_NUMBERS, 3)), f"case when {_ORDER} then {_A} when not ({_ORDER}) then {_B} end", f"case when {_ORDER} then {_B} when not ({_ORDER}) then {_A} end") + " "
    + _case(_DMY, _full(_num(_DMY, 3)), _month(_part(_DMY, 2)), _num(_DMY, 1)) + " "
    + _case(_MDY, _num(_MDY, 3), _month(_part(_MDY, 1)), _num(_MDY, 2)) + " end"
)


def dated(name: str, source: str, columns: str) -> str:
    """CTEs ending in ``name``: the columns of source, and earnings_date as its UTC day; rows without a meaningful day stay out."""
    return f"""
    {name}_t as (select s.*, home_zone, date_order, trim(regexp_replace(earnings_date, '[\\s\u00a0\u202f]+', ' ', 'g')) as t from {source} s left join call_feeds on s.feed = call_feeds.feed),
    {name}_p as (select *, {_PARTS} as p from {name}_t),
    {name}_q as (select *, p.rest as rest, try_strptime(p.y || '-' || p.m || '-' || p.d, '%Y-%m-%d') as day0,
        case when regexp_matches(p.rest, '^T\\d{{4}}') then substr(p.rest, 2, 2) else regexp_extract(p.rest, '(\\d{{1,2}})[:時]\\d\\d', 1) end as hh,
        case when regexp_matches(p.rest, '^T\\d{{4}}') then substr(p.rest, 4, 2) else regexp_extract(p.rest, '\\d{{1,2}}[:時](\\d\\d)', 1) end as mi,
        regexp_extract(p.rest, '([+-])(\\d{{1,2}}):?(\\d\\d)?(?:\\[.*\\])?$', ['sign', 'oh', 'om']) as o,
        regexp_extract(regexp_replace(p.rest, '(?i)[ap]\\.?m\\.?|Uhr|^T', '', 'g'), '([A-Z]+)$', 1) as zone from {name}_p),
    {name}_m as (select *, case when hh <> '' and try_cast(hh as int) <= 23 then day0 + to_minutes((try_cast(hh as int) % case when regexp_matches(rest, '(?i)[ap]\\.?m') then 12 else 24 end
        + case when regexp_matches(rest, '(?i)p\\.?m') then 12 else 0 end) * 60 + try_cast(mi as int)) end as wall from {name}_q),
    {name}_u as (select *, case
        when regexp_matches(t, '^\\d{{9,10}}(\\.\\d+)?$') then date '1970-01-01' + (floor(try_cast(t as double) / 86400))::int
        when regexp_matches(t, '^\\d{{12,13}}$') then date '1970-01-01' + (floor(try_cast(t as double) / 86400000))::int
        when hh = '' then day0::date
        when o.sign <> '' then (wall - to_minutes(try_cast(o.sign || '1' as int) * (try_cast(o.oh as int) * 60 + coalesce(try_cast(o.om as int), 0))))::date
        when case zone {_ZONES} end is not null then (wall - to_minutes(case zone {_ZONES} end))::date
        else timezone('UTC', timezone(coalesce(case zone {_REGION} end, home_zone, 'UTC'), wall))::date end as utc from {name}_m),
    {name} as (select {columns}, strftime(utc, '%Y-%m-%d') as earnings_date from {name}_u where utc is not null)"""
