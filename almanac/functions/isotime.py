"""ISO 8601 text: reading, completing and re-writing it while keeping the offset.

A Spark TIMESTAMP forgets the offset, so the text stays authoritative and timestamps are derived.
All functions give NULL instead of failing on text that is no date.  The session time zone must be
UTC (``almanac.session.tune`` sets it): local times pass through zone-less timestamps.

The ``sql_*`` functions write SQL over the name of a lambda variable, so that other expressions over
arrays can take them in; the functions behind them apply the same SQL to columns.
"""
from __future__ import annotations

from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column, functions as F

from almanac.functions.text import let, sql_strip

# Date with or without dashes; clock and offset with all their colons or none.
_DATE = r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2}))"
_CLOCK = r"(?:(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?|(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)"
_OFFSET = r"(Z|[+-]\d{2}(?::\d{2}(?::\d{2})?)?|[+-]\d{4}(?:\d{2})?)?"
_FULL = "^" + _DATE + "T" + _CLOCK + _OFFSET + r"\z"
_FIELDS = "$1$4-$2$5-$3$6|$7$11|$8$12|$9$13|$10$14|$15"
_USUAL_DAY = r"^\d{4}-\d{2}-\d{2}\z"
_ANY_DAY = r"^\s*\+?0*(\d{1,4})\s*-\s*\+?0*(\d{1,2})\s*-\s*\+?0*(\d{1,2})\s*\z"
_USUAL_OFFSET = r"^(?:\+(?:[01]\d|2[0-3])|-(?:0[1-9]|1\d|2[0-3])):[0-5]\d\z"
_WHOLE_NUMBER = r"^\s*[+-]?\d+\s*\z"

# Zone names that the Java time library does not list, by what it has for them; two name no zone.
_OTHER_NAMES = {"EST": "-05:00", "MST": "-07:00", "HST": "-10:00", "GMT+0": "UTC", "GMT-0": "UTC", "ROC": "Asia/Taipei"}
_NO_ZONE = {"Factory", "localtime"}


@lru_cache(maxsize=1)
def _zone_list() -> str:
    return "|" + "|".join(sorted((available_timezones() | set(_OTHER_NAMES)) - _NO_ZONE)) + "|"


def _is_day(day: str) -> str:
    return f"({day} >= '0001' AND try_cast({day} AS DATE) IS NOT NULL)"


def _clock_of(seconds: str) -> str:
    """``HH:MM`` or ``HH:MM:SS`` of a count of seconds below one day."""
    return (
        f"concat(lpad(string({seconds} div 3600), 2, '0'), ':', lpad(string({seconds} % 3600 div 60), 2, '0'),"
        f" CASE WHEN {seconds} % 60 <> 0 THEN concat(':', lpad(string({seconds} % 60), 2, '0')) ELSE '' END)"
    )


def _offset(raw: str) -> str:
    """'' for none, ``+00:00`` for Z, colons put in; NULL for a day or more."""
    def number(digits: str, at: int) -> str:
        return f"coalesce(try_cast(substr({digits}, {at}, 2) AS INT), 0)"

    total = " + ".join(f"{number('d', at)} * {size}" for at, size in ((1, 3600), (3, 60), (5, 1)))
    shown = f"CASE WHEN n < 86400 THEN concat(CASE WHEN n = 0 THEN '+' ELSE left({raw}, 1) END, {_clock_of('n')}) END"
    return (
        f"CASE WHEN {raw} = '' THEN '' WHEN {raw} = 'Z' THEN '+00:00' WHEN {raw} RLIKE r'{_USUAL_OFFSET}' THEN {raw}"
        f" ELSE transform(transform(array(replace(substr({raw}, 2), ':', '')), d -> {total}), n -> {shown})[0] END"
    )


def sql_read(v: str) -> str:
    """STRUCT<local, micros, offset> (texts) of a date-and-time text; NULL if it is none."""
    micros = "rpad(left(f[4], 6), 6, '0')"

    def part(n: int) -> str:
        return f"coalesce(nullif(f[{n}], ''), '00')"

    good = f"size(f) = 6 AND NOT contains({v}, '|') AND f[1] < '24' AND f[2] < '60' AND f[3] < '60' AND {_is_day('f[0]')}"
    fields = (
        f"named_struct('local', concat(f[0], 'T', {part(1)}, ':', {part(2)}, ':', {part(3)}),"
        f" 'micros', CASE WHEN f[4] = '' OR {micros} = '000000' THEN '' ELSE concat('.', {micros}) END, 'offset', {_offset('f[5]')})"
    )
    return (
        f"transform(transform(array(split(regexp_replace({v}, r'{_FULL}', '{_FIELDS}'), '[|]')), f -> CASE WHEN {good} THEN {fields} END),"
        " p -> CASE WHEN p.offset IS NOT NULL THEN p END)[0]"
    )


def sql_day(v: str) -> str:
    """``YYYY-MM-DD`` of a year-month-day text, which may lack leading zeros; NULL if it is none."""
    padded = "concat_ws('-', lpad(f[0], 4, '0'), lpad(f[1], 2, '0'), lpad(f[2], 2, '0'))"
    parts = f"split(regexp_replace({v}, r'{_ANY_DAY}', '$1|$2|$3'), '[|]')"
    loose = f"transform(array({parts}), f -> CASE WHEN size(f) = 3 AND NOT contains({v}, '|') THEN {padded} END)[0]"
    return f"transform(array(CASE WHEN {v} RLIKE r'{_USUAL_DAY}' THEN {v} ELSE {loose} END), d -> CASE WHEN {_is_day('d')} THEN d END)[0]"


def _zone_offset(local: str, zone: str) -> str:
    """Offset text of a local time in a zone; where a clock change makes it ambiguous, the earlier reading."""
    zone = f"CASE {zone} " + " ".join(f"WHEN '{name}' THEN '{known}'" for name, known in _OTHER_NAMES.items()) + f" ELSE {zone} END"
    gap = f"timestampdiff(SECOND, CAST(to_utc_timestamp(CAST({local} AS TIMESTAMP), {zone}) AS TIMESTAMP_NTZ), CAST({local} AS TIMESTAMP_NTZ))"
    return f"transform(array({gap}), g -> concat(CASE WHEN g < 0 THEN '-' ELSE '+' END, {_clock_of('abs(g)')}))[0]"


def sql_normalise(v: str, zone: str | None = None, end: bool = False) -> str:
    """E6 over a variable: see ``normalise``."""
    clock = "T23:59:59" if end else "T00:00:00"
    if zone is None:
        missing = "'+00:00'"
    else:
        known = f"contains('{_zone_list()}', concat('|', {zone}, '|'))"
        missing = f"CASE WHEN coalesce({zone}, '') = '' THEN '+00:00' WHEN {known} THEN {_zone_offset('p.local', zone)} END"
    day = f"transform(array({sql_day(v)}), d -> CASE WHEN d IS NOT NULL THEN named_struct('local', concat(d, '{clock}'), 'micros', '', 'offset', '') END)[0]"
    read = f"CASE WHEN contains({v}, 'T') THEN {sql_read(v)} WHEN {v} <> '' THEN {day} END"
    return f"transform(array({read}), p -> concat(p.local, p.micros, CASE WHEN p.offset <> '' THEN p.offset ELSE {missing} END))[0]"


def normalise(value: Column, zone: Column | None = None, end: bool = False) -> Column:
    """Full ISO text with offset.

    A text with a ``T`` must be a complete date and time; anything else must be year-month-day,
    where ``end`` puts the last second of the day.  A missing offset is taken from ``zone`` or is UTC.
    NULL for NULL, for the empty string and for text that cannot be read: see ``unreadable``.
    """
    if zone is None:
        return let(value, "v -> " + sql_normalise("v", end=end))
    both = F.struct(value.alias("v"), zone.alias("z"))
    return let(both, "x -> " + sql_normalise("x.v", "x.z", end))


def unreadable(value: Column, normalised: Column) -> Column:
    """TRUE when there was a text but no date could be read from it."""
    return (F.coalesce(value, F.lit("")) != "") & normalised.isNull()


def sql_duration_seconds(text: str) -> str:
    number = f"CASE WHEN d RLIKE r'{_WHOLE_NUMBER}' THEN try_cast({sql_strip('d')} AS BIGINT) END"
    return f"transform(array(replace(replace({text}, 'PT', ''), 'S', '')), d -> {number})[0]"


def duration_seconds(text: Column) -> Column:
    """Whole seconds of ``PT<n>S``; NULL for every other form."""
    return let(text, "t -> " + sql_duration_seconds("t"))


def sql_counts_seconds(text: str) -> str:
    """TRUE for a duration that claims to be in seconds."""
    return f"(startswith({text}, 'PT') AND contains({text}, 'S'))"


def sql_add_seconds(start: str, seconds: str) -> str:
    # more than ten thousand years leave the calendar from any start; the bound keeps the interval in range
    step = f"make_dt_interval(0, 0, 0, CAST(CASE WHEN abs({seconds}) < 400000000000 THEN {seconds} END AS DECIMAL(18, 6)))"
    moved = f"transform({{read}}, p -> CAST(p.local AS TIMESTAMP_NTZ) + {step})"
    shown = "m -> CASE WHEN year(m) BETWEEN 1 AND 9999 THEN date_format(m, \"yyyy-MM-dd'T'HH:mm:ss\") END"
    read = f"transform(array(replace({start}, '+00:00', '')), s -> {sql_read('s')})"
    return f"transform({moved.format(read=read)}, {shown})[0]"


def add_seconds(start: Column, seconds: Column) -> Column:
    """Wall-clock text ``seconds`` after ``start``.  ``+00:00`` is cut from the start, any other offset is lost."""
    return let(F.struct(start.alias("t"), seconds.alias("n")), "x -> " + sql_add_seconds("x.t", "x.n"))


def sql_local_time(iso: str) -> str:
    full = f"CAST({sql_read(iso)}.local AS TIMESTAMP_NTZ)"
    return f"CASE WHEN contains({iso}, 'T') THEN {full} WHEN {iso} RLIKE r'{_USUAL_DAY}' THEN try_cast({iso} AS TIMESTAMP_NTZ) END"


def local_time(iso: Column) -> Column:
    """TIMESTAMP_NTZ of the wall-clock part, offset ignored; NULL when the text is no date."""
    return let(iso, "v -> " + sql_local_time("v"))


def instant(iso: Column) -> Column:
    """TIMESTAMP of a full ISO text; NULL when the text is no date."""
    whole = "concat(p.local, p.micros, CASE WHEN p.offset = '' THEN '+00:00' ELSE p.offset END)"
    return let(iso, f"v -> transform(array({sql_read('v')}), p -> try_cast({whole} AS TIMESTAMP))[0]")
