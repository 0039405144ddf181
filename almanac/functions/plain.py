"""Pages whose structured data is plain, read in one go.

Python cuts the blocks, parses them and reads times and fields of each event; that takes a fraction of what the expressions over arrays
take, which Spark interprets.  It vouches only for what both sides read alike: a page that holds anything else is *odd*,
is NULL here, and is left to the expressions.
"""
from __future__ import annotations

import json
import re
import sys
from datetime import date, datetime, timedelta
from itertools import repeat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from almanac.functions.html import _JSONLD, ENTITY_REPAIRS, _links_of, _nodes_of
from almanac.functions.isotime import _USUAL_OFFSET
from almanac.functions.text import WHITE_SPACE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST_BLOCK = 40_000  # characters; keeps clear of the strict parser's bounds for names and numbers
MOST_BRACKETS = 500     # of a block, for the same reason: its bound for nesting is 1000
MOST_ITEMS = 200        # of a page, beyond which titles are not compared with its links one by one
LONGEST_NUMBER = 18     # characters

# ``_JSONLD`` with its lazy repetitions, which Python takes step by step, written as what they run over
_BLOCKS = re.compile(
    _JSONLD.replace("<!--.*?-->", "<!--(?:[^-]++|-(?!->))*+-->")
    .replace(r"(.*?)</script(?=[\s/>])", r"((?:[^<]++|<(?!/script[\s/>]))*+)</script(?=[\s/>])")
    .replace(r".*?</script(?=[\s/>])", r"(?:[^<]++|<(?!/script[\s/>]))*+</script(?=[\s/>])")
    .replace(r".*?</style(?=[\s/>])", r"(?:[^<]++|<(?!/style[\s/>]))*+</style(?=[\s/>])"), re.A
)
_TIME = re.compile(r"(\d{4})-(\d{2})-(\d{2})T([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?(Z|[+-]\d{2}:\d{2})?\Z", re.A)
_OFFSET = re.compile(_USUAL_OFFSET.replace(r"\z", r"\Z"), re.A)
_SECONDS = re.compile(r"PT(\d{1,9})S\Z", re.A)
# Latin letters and marks that have the same lower case everywhere
_OTHER_CASES = re.compile("[^\x00-į‐-‧‰-⁞€]")

_STRING, _STRING_OR_NULL = frozenset([str]), frozenset([str, type(None)])
_READ = ("startDate", "endDate", "startTime", "doorTime", "endTime", "duration", "@id", "url", "description")
_SHOWN = ("name", "eventStatus", "eventAttendanceMode")  # '' for a missing key only

_TEXTS = (
    "start_time", "end_time", "href", "id", "own_url", "title", "description", "organizer", "event_status", "event_attendance_mode",
    "location_text", "location_json",  # one of the two; the JSON of a location that is no text
)
PLAIN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("block_pos", "item_pos")] + [T.StructField(n, T.StringType()) for n in _TEXTS])
_ARROW_PLAIN = [pa.field(n, pa.int32()) for n in ("block_pos", "item_pos")] + [pa.field(n, pa.string()) for n in _TEXTS]


class Odd(Exception):
    """Not to be decided here."""


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Odd
    return found


def _whole(digits: str) -> int:
    if len(digits) > LONGEST_NUMBER:
        raise Odd
    return int(digits)


def _fraction(digits: str) -> Odd:
    """Stands for a number that must not be shown: its text would change."""
    if len(digits) > LONGEST_NUMBER or "e" in digits or "E" in digits:
        raise Odd
    return Odd()


def _constant(name: str) -> None:
    raise Odd


def _json_scanner():
    return json.JSONDecoder(object_pairs_hook=_object, parse_int=_whole, parse_float=_fraction, parse_constant=_constant).scan_once


def _document(block: str, scan):
    """The parsed block; NULL if no parser can read it."""
    if "&" in block:
        for worn, char in ENTITY_REPAIRS:
            block = block.replace(worn, char)
    if len(block) > LONGEST_BLOCK or block.count("{") + block.count("[") > MOST_BRACKETS:
        raise Odd
    if "\\u" in block and "\\ud" in block.lower():  # perhaps half a character
        raise Odd
    block = block.strip(" \t\n\r")
    try:
        document, end = scan(block, 0)
    except (json.JSONDecodeError, StopIteration):
        return None
    if end < len(block):
        raise Odd
    return document


def _events_of(document) -> list[dict]:
    if type(document) is dict:
        if document.get("@type") == "Event":
            return [document]
        document = document.get("@graph")
    return [o for o in document if type(o) is dict and o.get("@type") == "Event"] if type(document) is list else []


def _only(types: frozenset, values: list) -> list:
    if not types.issuperset(map(type, values)):
        raise Odd
    return values


def _read_time(value: str) -> tuple:
    found = _TIME.match(value)
    if found is None:
        raise Odd
    year, month, day, hour, minute, second, offset = parts = found.groups()
    if offset is not None and offset != "Z" and not _OFFSET.match(offset):
        raise Odd
    date(int(year), int(month), int(day))
    return parts


def _normal(value: str, clock: str) -> str:
    if "T" in value:
        year, month, day, hour, minute, second, offset = _read_time(value)
        return f"{year}-{month}-{day}T{hour}:{minute}:{second or '00'}{'+00:00' if offset is None or offset == 'Z' else offset}"
    if len(value) != 10 or not value[4] == value[7] == "-":
        raise Odd
    date.fromisoformat(value)
    return f"{value}{clock}+00:00"


def _later(start: str, seconds: int) -> str:
    year, month, day, hour, minute, second, _ = _read_time(start.replace("+00:00", ""))
    return (datetime(int(year), int(month), int(day), int(hour), int(minute), int(second or 0)) + timedelta(seconds=seconds)).isoformat()


def _merged(day: str | None, clock: str | None) -> str | None:
    return day if day is None or clock is None or "T" in day else f"{day}T{clock}"


def _times(start: str | None, end: str | None, clock: str | None, end_clock: str | None, duration: str | None) -> tuple[str | None, str | None]:
    """Start and end by the rule for pages themselves; an unreadable time makes the page odd."""
    start = _merged(start, clock)
    if duration is not None and duration.startswith("PT") and "S" in duration:
        counted = _SECONDS.match(duration)
        if counted is None:
            raise Odd
        if end_clock is None and start is not None and "T" in start:
            end = _later(start, int(counted[1]))
    if end_clock is not None:
        end = _merged(end, end_clock) if end is not None else None if start is None else f"{start.split('T')[0]}T{end_clock}"
    return start and _normal(start, "T00:00:00"), end and _normal(end, "T23:59:59")


def _organizer(value) -> str:
    return _only(_STRING, [value.get("name", "")])[0] if type(value) is dict else value if type(value) is str else ""


def _event(block_pos: int, item_pos: int, item: dict) -> list:
    read = _only(_STRING_OR_NULL, [*map(item.get, _READ)])
    title, status, mode = _only(_STRING, [*map(item.get, _SHOWN, repeat(""))])
    start, end, clock, door, end_clock, duration, own_id, url, description = [value or None for value in read]
    start, end = _times(start, end, clock or door, end_clock, duration)
    place, organizer = item.get("location"), item.get("organizer")
    is_text = type(place) is not dict and type(place) is not list
    return [
        block_pos, item_pos, start, end, None, own_id, url, title, description or "", _organizer(organizer), status, mode,
        (place if type(place) is str else "") if is_text else None, None if is_text else json.dumps(place),
    ]


def _put_links(events: list[list], page: str) -> None:
    """Give each event that has a title and no address that of the first link whose text holds the title."""
    if "href" not in page.lower():
        return
    wanted = [(e, e[7].strip(WHITE_SPACE).lower()) for e in events if e[6] is None and e[7]]
    if not wanted:
        return
    links = [(href, text.lower()) for href, text in _links_of(_nodes_of(page, False) or [])]
    for _, text in [*wanted, *links]:
        if _OTHER_CASES.search(text):
            raise Odd
    for event, title in wanted:
        event[4] = next((href for href, text in links if title in text), None)


def _plain(page: str, scan) -> list[list]:
    """The events of a page; raises ``Odd`` or ``ValueError`` (a day that is none, half a character) if they are not to be read here."""
    bodies = [m[1] for m in _BLOCKS.finditer(page) if m[1]]
    events = [_event(i, j, item) for i, body in enumerate(bodies) for j, item in enumerate(_events_of(_document(body, scan)))]
    if len(events) > MOST_ITEMS:
        raise Odd
    _put_links(events, page)
    return events


def _plain_or_none(page: bytes | None, scan) -> list[list] | None:
    try:
        return None if page is None else _plain(page.decode(), scan)
    except (Odd, ValueError, TypeError, OverflowError, RecursionError):
        return None


def _to_arrow(pages: list[list[list] | None]) -> pa.Array:
    offsets, at = [], 0
    for events in pages:
        offsets.append(None if events is None else at)
        at += len(events or ())
    offsets.append(at)
    columns = list(zip(*(e for events in pages if events for e in events))) or [[] for _ in _ARROW_PLAIN]
    values = pa.StructArray.from_arrays([pa.array(col, type=f.type) for col, f in zip(columns, _ARROW_PLAIN)], fields=_ARROW_PLAIN)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def plain_events(html: Column) -> Column:
    """ARRAY<PLAIN> of the events of a plain page, in order; NULL for an odd one.  Declared non-deterministic as ``page_nodes`` is."""

    @F.arrow_udf(T.ArrayType(PLAIN))
    def build(pages: pa.Array) -> pa.Array:
        raw = pages.cast(pa.large_binary() if pa.types.is_large_string(pages.type) else pa.binary())
        scan = _json_scanner()  # cannot be sent along with the job
        return _to_arrow([_plain_or_none(p, scan) for p in raw.to_pylist()])

    return build.asNondeterministic()(html)
