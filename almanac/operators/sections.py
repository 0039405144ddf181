"""Date-bearing sections of pages without structured data.

One row per page goes in, one row per section comes out; all steps between are expressions over the
page's node array, so nothing is shuffled and no two nodes are paired up.
"""
from __future__ import annotations

import sys
from bisect import bisect_right, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import urls
from almanac.functions.html import elements, inside, outermost, page_nodes, stripped, texts
from almanac.functions.selectors import class_words
from almanac.functions.arrays import each
from almanac.functions.text import bind, names_a_date, strip

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Which elements may hold one event, most specific first.  The number is the rank.
RANKED_SELECTORS = [
    (1, "article[class*=calendar]"),
    (2, "div[class*=calendar-item]"),
    (3, "div[class*=event-item]"),
    (4, ".views-row"),
    (5, ".node-event"),
    (6, "[class*=event]:not(body):not(html)"),
    (7, "[class*=calendar]:not(body):not(html)"),
    (8, "[class*=schedule]:not(body):not(html)"),
    (9, "[class*=program]:not(body):not(html)"),
    (10, "[class*=activity]:not(body):not(html)"),
    (11, "[id*=event]"),
    (12, "[id*=calendar]"),
    (13, "[id*=schedule]"),
    (14, "article"),
    (15, "section"),
    (16, "li"),
]
# Length of a container's text, both ends included.
SHORTEST, LONGEST = 50, 5000
# Fixed value: the sizes at which a cleaned section counts; the two readers of sections differ by one.
SECTION_MIN_CRAWL, SECTION_MIN_TEXT = 50, 51
SIBLINGS_BACK = 3  # fixed value: how many nodes before a section are looked at for a date


def _rank(tag: Column, cls: Column, ident: Column) -> Column:
    """Rank of the first selector an element with this class and id ('' for none) matches, NULL for none."""
    inner = ~tag.isin("body", "html")

    def has_class(name: str) -> Column:
        return cls.contains(name) & F.array_contains(class_words(cls), name)

    tests = {
        1: (tag == "article") & cls.contains("calendar"),
        2: (tag == "div") & cls.contains("calendar-item"),
        3: (tag == "div") & cls.contains("event-item"),
        4: has_class("views-row"),
        5: has_class("node-event"),
        6: cls.contains("event") & inner,
        7: cls.contains("calendar") & inner,
        8: cls.contains("schedule") & inner,
        9: cls.contains("program") & inner,
        10: cls.contains("activity") & inner,
        11: ident.contains("event"),
        12: ident.contains("calendar"),
        13: ident.contains("schedule"),
        14: tag == "article",
        15: tag == "section",
        16: tag == "li",
    }

    def first(numbers: range) -> Column:
        return F.coalesce(*[F.when(tests[number], number) for number, _ in RANKED_SELECTORS if number in numbers])

    # an element without a class or an id is not held against the selectors that ask for one
    return F.coalesce(F.when(cls != "", first(range(1, 11))), F.when(ident != "", first(range(11, 14))), first(range(14, 17)))


def _dated(nodes: Column) -> Column:
    """``STRUCT<rank, pre, last, sig, length>`` of elements that match a selector and name a date, with the length of their text."""

    def describe(c: Column) -> Column:
        return bind(F.lower(F.array_join(texts(nodes, c), "")), lambda text: F.struct(
            c["rank"].alias("rank"), c["pre"].alias("pre"), c["last"].alias("last"), c["sig"].alias("sig"),
            F.when(names_a_date(text), F.length(strip(text))).alias("length")))

    # every selector asks for one of these, so most nodes are passed over after one look
    likely = F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"].isin("article", "section", "li") | (F.size(n["attrs"]) > 0)))
    known = F.transform(likely, lambda n: F.struct(
        n["pre"].alias("pre"), n["last"].alias("last"), n["sig"].alias("sig"), n["tag"].alias("tag"),
        F.coalesce(n["attrs"]["class"], F.lit("")).alias("cls"), F.coalesce(n["attrs"]["id"], F.lit("")).alias("ident")))
    ranked = F.transform(known, lambda n: F.struct(
        _rank(n["tag"], n["cls"], n["ident"]).alias("rank"), n["pre"].alias("pre"), n["last"].alias("last"), n["sig"].alias("sig"), n["tag"].alias("tag")))
    return F.filter(F.transform(F.filter(ranked, lambda c: c["rank"].isNotNull()), describe), lambda c: c["length"].isNotNull())


def candidates(nodes: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """H10 before nesting: ``STRUCT<rank, pre, last, sig>`` of elements with a fitting text, best first.

    ``shortest`` and ``longest`` bound the length of the text; ``passed_over`` has what falls outside.
    """
    fitting = F.filter(_dated(nodes), lambda c: c["length"].between(shortest, longest))
    return F.sort_array(F.transform(
        fitting, lambda c: F.struct(c["rank"].alias("rank"), c["pre"].alias("pre"), c["last"].alias("last"), c["sig"].alias("sig"))
    ))


def passed_over(nodes: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """H10, the trace: ``STRUCT<rank, pre, length, reason>`` of elements that name a date but whose text does not fit."""
    outside = F.filter(_dated(nodes), lambda c: ~c["length"].between(shortest, longest))
    return F.transform(outside, lambda c: F.struct(
        c["rank"].alias("rank"), c["pre"].alias("pre"), c["length"].alias("length"),
        F.when(c["length"] < shortest, "too_short").otherwise("too_long").alias("reason"),
    ))


def passed_over_sections(pages: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """One row per element that could have held a section, but for the length of its text, with the reason."""
    trees = pages.withColumn("nodes", page_nodes(F.col("html")))
    return each(trees.withColumn("_over", passed_over(F.col("nodes"), shortest, longest)), ["page_id", "url"], "_over")


def without_nested(nodes: Column, ranked: Column) -> Column:
    """Walk the candidates from the best on; one that overlaps a kept one, or has the same markup as
    a kept one or as a part of it (or the other way round), is left out.

    The walk needs sorted lookups to stay linear on pages with thousands of candidates, so this one step
    is done in Python, on positions and signatures only.
    """

    @F.arrow_udf("array<int>")
    def choose(candidates: pa.Array, signatures: pa.Array) -> pa.Array:
        fields = candidates.flatten()
        spans = list(zip(*(fields.field(name).to_pylist() for name in ("pre", "last", "sig"))))
        out, at = [], 0
        for many, page in zip(pc.list_value_length(candidates).to_pylist(), signatures):
            if many is None:
                out.append(None)
            elif many < 2:
                out.append([0] * many)  # a candidate alone stays, whatever its markup
                at += many
            else:
                out.append(_cover(spans[at:at + many], page.values.to_pylist()))
                at += many
        return pa.array(out, pa.list_(pa.int32()))

    kept = choose.asNondeterministic()(ranked, F.transform(nodes, lambda n: n["sig"]))
    return F.transform(kept, lambda at: ranked[at])


def _cover(candidates: list[tuple[int, int, int]], signatures: list[int]) -> list[int]:
    """Numbers of the candidates (``pre, last, sig``) to keep.  Kept spans are disjoint, so two neighbours tell an overlap."""
    starts, ends, own, covered, kept = [], {}, set(), set(), []
    for number, (pre, last, sig) in enumerate(candidates):
        at = bisect_right(starts, pre)
        if (at and ends[starts[at - 1]] >= pre) or (at < len(starts) and starts[at] <= last):
            continue
        inner = signatures[pre + 1:last + 1]
        if sig in covered or not own.isdisjoint(inner):
            continue
        insort(starts, pre)
        ends[pre] = last
        own.add(sig)
        covered.add(sig)
        covered.update(inner)
        kept.append(number)
    return kept


def outermost_candidates(ranked: Column) -> Column:
    """H11, second form: the candidates that lie in no other one, in document order."""
    by_position = F.sort_array(F.transform(ranked, lambda c: F.struct(
        c["pre"].alias("pre"), c["last"].alias("last"), c["rank"].alias("rank"), c["sig"].alias("sig")
    )))
    return bind(by_position, outermost)


def clean_text(nodes: Column, node: Column) -> Column:
    """Text pieces one per line, scripts, styles and no-script parts inside the section left out."""
    return F.array_join(stripped(texts(nodes, node, lambda t: t["noise"] <= node["pre"])), "\n")


def section_link(nodes: Column, node: Column, page_url: Column) -> Column:
    """Address of a link to the event's own page, else of the first ordinary link, else NULL."""
    def present(n: Column) -> Column:
        return n["noise"] <= node["pre"]  # what stands in a no-script part of the section is gone by now

    links = F.transform(
        F.filter(inside(nodes, node), lambda n: (n["tag"] == "a") & present(n)),
        lambda a: F.struct(
            a["attrs"]["href"].alias("href"), F.array_join(stripped(texts(nodes, a, present)), "").alias("text")
        ),
    )
    links = F.filter(links, lambda a: (F.coalesce(a["href"], F.lit("")) != "") & ~a["href"].rlike("^(?:mailto:|tel:)"))

    def is_detail(a: Column) -> Column:
        words = F.lower(a["text"])
        return (
            (words.contains("event") & words.contains("detail"))
            | words.contains("event website")
            | a["href"].contains("/node/")
        )

    def choose(found: Column) -> Column:
        return F.coalesce(
            F.try_element_at(F.filter(found, is_detail), F.lit(1))["href"],
            F.try_element_at(F.filter(found, lambda a: ~a["href"].startswith("#")), F.lit(1))["href"],
        )

    return urls.resolve(page_url, bind(links, choose))


def date_context(nodes: Column, node: Column) -> Column:
    """Texts with a date among the three nodes before a section, oldest first; NULL if none."""
    def step(seen: Column, _: Column) -> Column:
        last = F.when(F.size(seen) == 0, node["prev"]).otherwise(seen[0]["prev"])
        return F.when(last >= 0, F.concat(F.array(nodes[last]), seen)).otherwise(seen)

    near = F.aggregate(F.array(*[F.lit(n) for n in range(SIBLINGS_BACK)]), F.slice(nodes, 1, 0), step)

    def text(m: Column) -> Column:
        return F.when(m["kind"] == "element", F.array_join(stripped(texts(nodes, m)), "")).when(
            m["kind"] == "text", strip(m["text"])
        ).otherwise("")

    dated = F.filter(F.transform(near, text), lambda t: (t != "") & names_a_date(F.lower(t)))
    return bind(dated, lambda found: F.when(F.size(found) > 0, F.array_join(found, "\n")))


def page_sections(pages: DataFrame, min_length: int = SECTION_MIN_CRAWL, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """One row per section with its text, date context, link and written-out URLs."""
    keep = [c for c in pages.columns if c not in ("html", "nodes")]
    trees = pages if "nodes" in pages.columns else pages.withColumn("nodes", page_nodes(F.col("html"), signatures=True))
    nodes = F.col("nodes")

    def describe(span: Column, pos: Column) -> Column:
        return bind(nodes[span["pre"]], lambda n: F.struct(
            pos.alias("section_pos"), span["rank"].alias("rank"), n["pre"].alias("pre"), n["tag"].alias("tag"),
            clean_text(nodes, n).alias("section"),
            date_context(nodes, n).alias("context"),
            section_link(nodes, n, F.col("url")).alias("link_url"),
        ))

    found = (
        trees.select(*keep, nodes, candidates(nodes, shortest, longest).alias("_ranked"))
        .withColumn("_kept", without_nested(nodes, F.col("_ranked")))
        .withColumn("_sections", F.transform("_kept", describe))
    )
    rows = each(found, keep, "_sections")
    return rows.filter(F.length("section") >= min_length).withColumn("text_urls", urls.in_text(F.col("section")))


def noise_free(nodes: Column) -> Column:
    """STRUCT<pre, last> of the first header, the first footer and the first navigation bar, each
    looked for after the one before it is gone."""

    def first(tag: str, gone: list[Column]) -> Column:
        left = elements(nodes, tag)
        if gone:
            left = F.filter(left, lambda n: ~within_any(n, F.array_compact(F.array(*gone))))
        span = F.try_element_at(left, F.lit(1))
        return F.when(span.isNotNull(), F.struct(span["pre"].alias("pre"), span["last"].alias("last")))

    header = first("header", [])
    return bind(header, lambda h: bind(first("footer", [h]), lambda f: F.array_compact(F.array(h, f, first("nav", [h, f])))))


def within_any(node: Column, spans: Column) -> Column:
    """Is the node one of the spans or inside one?"""
    return F.exists(spans, lambda s: (s["pre"] <= node["pre"]) & (node["pre"] <= s["last"]))


def body_text(nodes: Column, removed: Column) -> Column:
    """Text of the page body, pieces one per line, without removed parts, scripts and styles."""
    body = F.try_element_at(elements(nodes, "body"), F.lit(1))
    head = F.transform(elements(nodes, "head"), lambda n: F.struct(n["pre"].alias("pre"), n["last"].alias("last")))
    everything = F.when(body.isNotNull(), F.struct(body["pre"].alias("pre"), body["last"].alias("last"))).otherwise(
        F.struct(F.lit(-1).alias("pre"), F.lit(2147483647).alias("last"))
    )

    def text_of(scope: Column) -> Column:
        visible = F.filter(nodes, lambda n: (
            (n["kind"] == "text") & (n["noise"] < 0)
            & (scope["pre"] < n["pre"]) & (n["pre"] <= scope["last"])
            & ~within_any(n, removed) & ~within_any(n, head)
        ))
        return F.array_join(stripped(F.transform(visible, lambda n: n["text"])), "\n")

    return bind(everything, text_of)


def element_text(nodes: Column, node: Column) -> Column:
    """Text of one element the way ``body_text`` shows it."""
    return F.array_join(stripped(texts(nodes, node, lambda t: t["noise"] <= node["pre"])), "\n")
