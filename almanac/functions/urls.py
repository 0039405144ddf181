"""URL columns: resolution against a base, host, URLs inside text, calendar tests."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from almanac.functions.text import MONTHS, let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"

# Schemes whose references are resolved against a base.
RESOLVABLE_SCHEMES = [
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
# What marks an address as a calendar, and a frame source as one.
CALENDAR_MARKS = ["/calendar/", "/events/", "assabetinteractive.com"]
FRAME_MARKS = ["calendar", "event", "schedule", "booking"]
# Fixed value: one class, so the matcher repeats a single set of characters and never recurses.
TEXT_URL = r"https?://[a-z!$-_]+"


def host(url: Column) -> Column:
    """H7: the authority part, user name and port included; '' when there is none."""
    return let(url, f"u -> regexp_extract({_TIDY.format(u='u')}, r'{_AFTER_SCHEME}//([^/?#]*)', 1)")


_TIDY = "regexp_replace(translate({u}, '\\t\\r\\n', ''), r'^[\\x00-\\x20]+', '')"
_FRAGMENT = r"(?s)^[^#]*#(.*)\z"


def _parts(u: str) -> str:
    """STRUCT<scheme, authority, path, query, fragment> of a URL, as SQL."""
    pieces = [
        ("authority", r"^//([^/?#]*)"),
        ("path", r"^(?://[^/?#]*)?([^?#]*)"),
        ("query", r"^[^?#]*\?([^#]*)"),
        ("fragment", _FRAGMENT),
    ]
    fields = ", ".join(f"'{name}', regexp_extract(c.rest, r'{pattern}', 1)" for name, pattern in pieces)
    cut = f"t -> named_struct('scheme', lower(regexp_extract(t, r'{_SCHEME}', 1)), 'rest', regexp_replace(t, r'{_SCHEME}', ''))"
    return f"transform(transform(array({_TIDY.format(u=u)}), {cut}), c -> named_struct('scheme', c.scheme, {fields}))[0]"


def _assemble(authority: str, path: str, query: str) -> str:
    slash = f"CASE WHEN {path} <> '' AND NOT startswith({path}, '/') THEN '/' ELSE '' END"
    return (
        "concat(CASE WHEN p.b.scheme <> '' THEN concat(p.b.scheme, ':') ELSE '' END,"
        f" CASE WHEN {authority} <> '' THEN concat('//', {authority}, {slash}) ELSE '' END, {path},"
        f" CASE WHEN {query} <> '' THEN concat('?', {query}) ELSE '' END,"
        " CASE WHEN p.r.fragment <> '' THEN concat('#', p.r.fragment) ELSE '' END)"
    )


def _resolution() -> str:
    schemes = ", ".join(f"'{s}'" for s in RESOLVABLE_SCHEMES)
    # one walk over the path segments: '.' vanishes, '..' takes back the segment before it
    walk = (
        "aggregate(s, CAST(array() AS ARRAY<STRING>), (done, x) -> CASE x WHEN '..' THEN"
        " CASE WHEN size(done) > 0 THEN slice(done, 1, size(done) - 1) ELSE done END"
        " WHEN '.' THEN done ELSE array_append(done, x) END)"
    )
    path_of = (
        f"s -> coalesce(nullif(array_join(CASE WHEN s[size(s) - 1] IN ('.', '..') THEN array_append({walk}, '') ELSE {walk} END, '/'), ''), '/')"
    )
    # the base without its last segment, then the reference; empty segments in between vanish
    folder = "transform(array(split(p.b.path, '/')), f -> CASE WHEN f[size(f) - 1] <> '' THEN slice(f, 1, size(f) - 1) ELSE f END)[0]"
    joined = (
        f"transform(array(concat({folder}, split(p.r.path, '/'))), j -> CASE WHEN size(j) < 2 THEN j ELSE"
        " concat(slice(j, 1, 1), filter(slice(j, 2, size(j) - 2), e -> e <> ''), slice(j, -1, 1)) END)[0]"
    )
    path = f"transform(array(CASE WHEN startswith(p.r.path, '/') THEN split(p.r.path, '/') ELSE {joined} END), {path_of})[0]"
    foreign = (
        f"(p.r.scheme <> '' AND (p.r.scheme <> p.b.scheme OR p.r.scheme NOT IN ({schemes}))) OR (p.b.scheme <> '' AND p.b.scheme NOT IN ({schemes}))"
    )
    return (
        f"x -> CASE WHEN x.r = '' THEN x.b WHEN x.b = '' THEN x.r WHEN x.b IS NOT NULL AND x.r IS NOT NULL THEN"
        f" transform(array(named_struct('b', {_parts('x.b')}, 'r', {_parts('x.r')})), p -> CASE WHEN {foreign} THEN x.r"
        f" WHEN p.r.authority <> '' THEN {_assemble('p.r.authority', 'p.r.path', 'p.r.query')}"
        f" WHEN p.r.path = '' THEN {_assemble('p.b.authority', 'p.b.path', 'coalesce(nullif(p.r.query, {e}), p.b.query)'.format(e=chr(39) * 2))}"
        f" ELSE transform(array({path}), q -> {_assemble('p.b.authority', 'q', 'p.r.query')})[0] END)[0] END"
    )


def resolve(base: Column, ref: Column) -> Column:
    """H6: absolute form of ``ref`` as seen from the page ``base`` (RFC 3986 reference resolution)."""
    return let(F.struct(base.alias("b"), ref.alias("r")), _resolution())


def address(url: Column) -> Column:
    """What is fetched for a URL: all before its fragment."""
    return F.substring_index(url, "#", 1)


def is_calendar(url: Column) -> Column:
    """Does the address look like a calendar that has month pages?"""
    low = F.lower(url)
    return low.contains(CALENDAR_MARKS[0]) | low.contains(CALENDAR_MARKS[1]) | low.contains(CALENDAR_MARKS[2])


def is_calendar_frame(src: Column) -> Column:
    """H4: does the raw frame source name a calendar?"""
    return F.lower(src).rlike("|".join(FRAME_MARKS))


def in_text(text: Column) -> Column:
    """Distinct URLs written out in a text, sorted (the order in the text carries no meaning)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TEXT_URL), F.lit(0))))


def month_labels(as_of: Column, months: int = 2) -> Column:
    """``2025-october`` style names of the month of ``as_of`` and the ones after it."""
    first = F.trunc(as_of, "MM")
    return F.transform(
        F.sequence(F.lit(0), F.lit(months - 1)),
        lambda i: F.lower(F.date_format(F.add_months(first, i), "yyyy-MMMM")),
    )


def month_urls(base: Column, as_of: Column, months: int = 2) -> Column:
    """Month pages of a calendar.  A base that names a month as a path part is cut before its year."""
    names_month = base.rlike("/(?:" + "|".join(MONTHS) + ")/")
    root = F.when(names_month, F.element_at(F.split(base, "/202"), 1)).otherwise(base)
    root = F.rtrim(root, F.lit("/"))
    return F.transform(month_labels(as_of, months), lambda m: F.concat(root, F.lit("/"), m, F.lit("/")))
