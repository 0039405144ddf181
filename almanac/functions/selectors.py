"""A small selector language as columns, so that every row may bring its own selectors.

Understood: tag, ``*``, ``.class`` (also chained), ``#id``, ``[attr]``, ``[attr=v]``, ``[attr*=v]``,
``[attr^=v]``, ``[attr$=v]``, ``:not(tag)`` and the descendant space.  ``is_supported`` tells the rest
apart, which ``operators.hints`` reports.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from almanac.functions.html import inside, outermost
from almanac.functions.text import bind, strip

_NAME = r"[A-Za-z_][\w-]*"
_PIECE = (
    r"(?:\." + _NAME + r"|#" + _NAME
    + r"|\[" + _NAME + r"(?:[*^$]?=(?:\"[^\"\]]*\"|'[^'\]]*'|[\w-]+))?\]"
    + r"|:not\(" + _NAME + r"\))"
)
_COMPOUND = r"(?:(?:" + _NAME + r"|\*)" + _PIECE + r"{0,12}|" + _PIECE + r"{1,12})"
_SELECTOR = r"^" + _COMPOUND + r"(?:\s+" + _COMPOUND + r"){0,8}$"
_ATTRIBUTE = r"\[(" + _NAME + r")(?:([*^$]?=)(?:\"([^\"\]]*)\"|'([^'\]]*)'|([\w-]+)))?\]"


def is_supported(selector: Column) -> Column:
    return strip(selector).rlike(_SELECTOR)


def parse(selector: Column) -> Column:
    """ARRAY of compounds, outermost first; NULL for a selector that is not supported."""

    def compound(c: Column) -> Column:
        bare = F.regexp_replace(c, r"\[[^\]]*\]|:not\([^)]*\)", "")
        return F.struct(
            F.regexp_extract(bare, "^" + _NAME, 0).alias("tag"),
            F.regexp_extract_all(bare, F.lit(r"#(" + _NAME + ")"), F.lit(1)).alias("ids"),
            F.regexp_extract_all(bare, F.lit(r"\.(" + _NAME + ")"), F.lit(1)).alias("classes"),
            F.regexp_extract_all(c, F.lit(r":not\((" + _NAME + r")\)"), F.lit(1)).alias("not_tags"),
            F.transform(
                F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]"), F.lit(0)),
                lambda a: F.struct(
                    F.regexp_extract(a, _ATTRIBUTE, 1).alias("name"),
                    F.regexp_extract(a, _ATTRIBUTE, 2).alias("op"),
                    F.concat(*[F.regexp_extract(a, _ATTRIBUTE, n) for n in (3, 4, 5)]).alias("value"),
                ),
            ).alias("attributes"),
        )

    tidy = strip(selector)
    # a space inside brackets belongs to a value, so compounds are found rather than split off
    return F.when(
        is_supported(selector),
        F.transform(F.regexp_extract_all(tidy, F.lit(_COMPOUND), F.lit(0)), compound),
    )


def link_inside() -> Column:
    """The compound that stands for a link, to be put behind a container's selector."""
    none = F.expr("cast(array() as array<string>)")
    return F.struct(
        F.lit("a").alias("tag"), none.alias("ids"), none.alias("classes"), none.alias("not_tags"),
        F.expr("cast(array() as array<struct<name:string,op:string,value:string>>)").alias("attributes"),
    )


def class_words(cls: Column) -> Column:
    return F.split(cls, r"\s+")


def class_names(node: Column) -> Column:
    return class_words(F.coalesce(node["attrs"]["class"], F.lit("")))


def _matches(node: Column, c: Column) -> Column:
    def attribute(a: Column) -> Column:
        raw = node["attrs"][a["name"]]
        have = F.when(a["name"] == "class", F.regexp_replace(strip(raw), r"\s+", " ")).otherwise(raw)
        return bind(have, lambda h: F.coalesce(
            F.when(a["op"] == "", h.isNotNull())
            .when(a["op"] == "=", h == a["value"])
            .when(a["value"] == "", F.lit(False))
            .when(a["op"] == "*=", h.contains(a["value"]))
            .when(a["op"] == "^=", h.startswith(a["value"]))
            .when(a["op"] == "$=", h.endswith(a["value"])),
            F.lit(False),
        ))

    return (
        (node["kind"] == "element")
        & ((c["tag"] == "") | (F.lower(c["tag"]) == node["tag"]))
        & F.forall(c["ids"], lambda i: F.coalesce(node["attrs"]["id"] == i, F.lit(False)))
        & F.forall(c["classes"], lambda k: F.array_contains(class_names(node), k))
        & F.forall(c["not_tags"], lambda t: F.lower(t) != node["tag"])
        & F.forall(c["attributes"], attribute)
    )


def select(nodes: Column, compounds: Column) -> Column:
    """Nodes that match a parsed selector, in document order.

    One pass over the nodes per compound: matches are looked for inside the outermost matches so far.
    """
    everything = F.array(F.struct(F.lit(-1).alias("pre"), (F.size(nodes) - 1).alias("last")))

    def narrow(outer: Column, c: Column) -> Column:
        hits = F.flatten(F.transform(outermost(outer), lambda o: F.filter(inside(nodes, o), lambda n: _matches(n, c))))
        return F.transform(hits, lambda n: F.struct(n["pre"].alias("pre"), n["last"].alias("last")))

    spans = F.aggregate(compounds, everything, narrow)
    return F.transform(spans, lambda s: nodes[s["pre"]])
