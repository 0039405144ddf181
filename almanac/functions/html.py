"""HTML as columns.

Structured-data scripts are cut out by one regular expression inside the JVM.  Everything that needs
the nesting of elements reads the page as an *array of nodes in document order*: a node's position is
its index, and ``last`` is the index of its last descendant, so a subtree is one ``slice`` and no join
or shuffle is needed to look inside a page.  Only building that array runs in Python, on Arrow batches.
"""
from __future__ import annotations

import html.parser
import re
import sys
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from almanac.functions.text import WHITE_SPACE, bind, replace_all, strip
from almanac.functions.tolerant import first_holding, reread_texts

# Workers get the parser along with the job, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the one media type that marks structured data, compared exactly.
JSONLD_TYPE = "application/ld+json"
# Some servers write the plus sign of an attribute as an entity.
_PLUS = r"(?:\+|&#43;|&#x2[Bb];|&plus;)"
JSONLD_MARK = "application/ld"  # a page without this text has no block
# What is put right in a block before it is parsed, in this order.
ENTITY_REPAIRS = [("&#039;", "'"), ("&quot;", '"'), ("&amp;", "&")]

_ANY_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_OTHER_ATTRIBUTES = r"""(?:\s++(?!type[\s=>])[^\s=>/"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?+)*+"""
_TYPE = r"""\s++type\s*+=\s*+(?:"(?-i:TYPE)"|'(?-i:TYPE)'|(?-i:TYPE)(?=[\s>]))""".replace("TYPE", JSONLD_TYPE.replace("+", _PLUS))
_JSONLD = (
    r"(?is)<!--.*?-->"                                                                 # a comment hides what it holds
    r"|<style(?=[\s/>])" + _ANY_ATTRIBUTES + r">.*?</style(?=[\s/>])"
    r"|<script" + _OTHER_ATTRIBUTES + _TYPE + _ANY_ATTRIBUTES + r">(.*?)</script(?=[\s/>])"  # group 1: the wanted body
    r"|<script(?=[\s/>])" + _ANY_ATTRIBUTES + r">.*?</script(?=[\s/>])"
)


def jsonld_blocks(html: Column) -> Column:
    """H1: bodies of the structured-data scripts of a page, in document order."""
    bodies = F.regexp_extract_all(html, F.lit(_JSONLD), F.lit(1))
    return F.filter(bodies, lambda b: b != "")


def repair_entities(block: Column) -> Column:
    """H2: undo the entities that sites wrongly put into scripts."""
    return replace_all(block, ENTITY_REPAIRS)


# Elements that never hold content.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
}
# Elements whose text is a kind of its own and no text of the elements around them.
OWN_TEXT = {"script", "style", "template", "rt", "rp"}
# Elements whose text is removed when a section is cleaned.
NOISE = ["script", "style", "noscript"]
_KEEP_SPACE = {"pre", "textarea"}

# Plain markup: text, end tags, start tags with well-formed attributes, comments without two hyphens.  Every parser reads it alike,
# so it is cut by one expression; a page that holds anything else is left to the standard library's parser.
_VALUE = r'''(?:"([^"<>]*+)"|'([^'<>]*+)'|([\w.:#-]++)(?=[ \n\t>]))'''
_ATTRIBUTE = r"[ \n\t]++([a-zA-Z][a-zA-Z0-9_:-]*+)(?:=" + _VALUE + r"|(?=[ \n\t/>]))"
_PLAIN = re.compile(
    r"([^<]++)"
    r"|</([a-zA-Z][a-zA-Z0-9:]*+)>"
    r"|<([a-zA-Z][a-zA-Z0-9:]*+)((?:" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + r")*+)[ \n\t]*+(/?)>"
    r"|<!--(?!-?>)((?:[^-]++|-(?!-))*+)-->"
    r"|<!((?i:doctype)[^>]*+)>", re.A
)
_PLAIN_ATTRIBUTE = re.compile(_ATTRIBUTE, re.A)
_unescape_value = getattr(html.parser, "_unescape_attrvalue", unescape)
# What stands in these elements is text up to their end tag, for all or only for newer versions of that parser.
_RAW = re.compile(r"([^<]*+(?:<(?!!|/\s*(?i:script|style))[^<]*+)*+)</([a-zA-Z]++)>")
_PLAIN_TEXT = re.compile(r"([^<&]*+)</([a-zA-Z]++)>")
_TEXT_ONLY = {"script": _RAW, "style": _RAW} | dict.fromkeys(["title", "textarea", "iframe", "xmp", "noembed", "noframes", "plaintext"], _PLAIN_TEXT)
_ASCII_SPACE = " \n\t\f\r"

NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),      # position in the array
    T.StructField("last", T.IntegerType()),     # position of the last descendant
    T.StructField("parent", T.IntegerType()),   # position of the parent, -1 at the top
    T.StructField("prev", T.IntegerType()),     # position of the sibling before, -1 if none
    T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()),      # element, text, comment, or an OWN_TEXT name
    T.StructField("tag", T.StringType()),       # elements only
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),      # text only
    T.StructField("noise", T.IntegerType()),    # nearest NOISE element around it, -1 if none
    T.StructField("sig", T.LongType()),         # equal for elements of the page with the same markup; 0 if not asked for
])
_ARROW_NODE = pa.struct([
    ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("prev", pa.int32()), ("depth", pa.int32()),
    ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("noise", pa.int32()), ("sig", pa.int64()),
])


class _Nodes(HTMLParser):
    """Writes the nodes of one page.  ``open`` holds the elements not closed yet, outermost first, each with what held around it."""

    def __init__(self, signatures: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.signatures = signatures
        self.nodes: list[list] = []
        self.open: list[tuple] = []
        self.names: list[str] = []
        self.known: dict[tuple, int] = {}    # signature of each markup met so far
        self.pending: list[str] = []
        # of the innermost open element:
        self.up = self.newest = self.noise = -1   # its position, its youngest child so far, the NOISE element that its children lie in
        self.kind = "text"                   # kind of text in it
        self.keep_space = False              # does white space stay as it is?
        self.parts: list | None = None       # its children for the signature

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    def _leaf(self, kind: str, text: str) -> None:
        nodes = self.nodes
        pre = len(nodes)
        nodes.append([pre, pre, self.up, self.newest, len(self.open), kind, None, None, text, self.noise, 0])
        self.newest = pre
        if self.parts is not None:
            self.parts.append(text)

    def _text(self, text: str) -> None:
        if not self.keep_space and not text.strip(_ASCII_SPACE):
            text = "\n" if "\n" in text else " "
        self._leaf(self.kind, text)

    def _start(self, tag: str, attrs: list) -> None:
        nodes = self.nodes
        pre = len(nodes)
        node = [pre, pre, self.up, self.newest, len(self.open), "element", tag, attrs, None, self.noise, 0]
        nodes.append(node)
        if tag in VOID:
            self.newest = pre
            if self.signatures:
                self._sign(node, ())
            return
        self.open.append((node, self.kind, self.noise, self.keep_space, self.parts))
        self.names.append(tag)
        self.up, self.newest = pre, -1
        if tag in OWN_TEXT:
            self.kind = tag
        if tag in NOISE:
            self.noise = pre
        elif tag in _KEEP_SPACE:
            self.keep_space = True
        if self.signatures:
            self.parts = []

    def _end(self, tag: str) -> None:
        if tag in self.names:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        inner = self.parts
        node, self.kind, self.noise, self.keep_space, self.parts = self.open.pop()
        node[1] = len(self.nodes) - 1
        self.newest, self.up = node[0], node[2]
        if self.signatures:
            self._sign(node, inner)
        return self.names.pop()

    def _sign(self, node: list, parts) -> None:
        words = node[7]
        if words:
            words = [(k, " ".join(v.split()) if k == "class" else v) for k, v in words]
            words.sort()
        node[10] = sig = self.known.setdefault((node[6], *words, None, *parts), len(self.known) + 1)
        if self.parts is not None:
            self.parts.append(sig)

    def _flush(self) -> None:
        if self.pending:
            text = self.pending[0] if len(self.pending) == 1 else "".join(self.pending)
            self.pending.clear()
            self._text(text)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()
        self._leaf("comment", data)

    handle_decl = unknown_decl = handle_pi = handle_comment

    def parse_marked_section(self, i, report=1):
        """Marked sections that the standard parser does not know count as a comment up to the next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag, attrs):
        self._flush()
        self._start(tag, [(k, v or "") for k, v in dict(attrs).items()])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        self._flush()
        self._end(tag)

    def plain(self, page: str) -> bool:
        """Read a page of plain markup only; false, with some of it read, for another."""
        at, end, cut = 0, len(page), _PLAIN.scanner(page).match
        start, stop, text_of = self._start, self._end, self._text
        while at < end:
            token = cut()
            if token is None:
                return False
            at, kind = token.end(), token.lastindex
            if kind == 1:
                text = token[1]
                text_of(unescape(text) if "&" in text else text)
            elif kind == 2:
                stop(token[2].lower())
            elif kind > 5:
                self._leaf("comment", token[kind])
            else:
                tag, attrs, closed = token.group(3, 4, 5)
                tag = tag.lower()
                if attrs:
                    attrs = [(k.lower(), _unescape_value(v) if "&" in v else v) for k, a, b, c in _PLAIN_ATTRIBUTE.findall(page, token.start(4), at) for v in (a or b or c,)]
                    start(tag, attrs if len(attrs) == 1 else list(dict(attrs).items()))
                else:
                    start(tag, [])
                if closed:
                    if tag in _TEXT_ONLY:
                        return False
                    if tag not in VOID:
                        self._close()
                elif tag in _TEXT_ONLY:
                    body = _TEXT_ONLY[tag].match(page, at)
                    if body is None or body[2].lower() != tag:
                        return False
                    if body[1]:
                        text_of(body[1])
                    stop(tag)
                    at = body.end()
                    cut = _PLAIN.scanner(page, at).match
        return True

    def standard(self, page: str) -> None:
        self.feed(page)
        self.close()

    def finished(self) -> list[list]:
        self._flush()
        while self.open:
            self._close()
        return self.nodes


def _to_arrow(pages: list[list[list] | None]) -> pa.Array:
    """Nested Arrow array out of flat columns, without a Python object per field."""
    flat = [n for nodes in pages if nodes for n in nodes]
    offsets, at = [], 0
    for nodes in pages:
        offsets.append(None if nodes is None else at)
        at += len(nodes or ())
    offsets.append(at)
    columns = list(zip(*flat)) if flat else [[] for _ in _ARROW_NODE]
    arrays = [
        pa.array(col, type=f.type) for col, f in zip(columns, _ARROW_NODE)
    ]
    values = pa.StructArray.from_arrays(arrays, fields=list(_ARROW_NODE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _nodes_of(page: str | None, signatures: bool) -> list[list] | None:
    """A page that cannot be read has no nodes, like one that is NULL: it must not cost the others theirs."""
    try:
        if page is None:
            return None
        reader = _Nodes(signatures)
        if not reader.plain(page):
            reader = _Nodes(signatures)
            reader.standard(page)
        return reader.finished()
    except (AssertionError, ValueError, RecursionError):
        return None


def page_nodes(html: Column, signatures: bool = False) -> Column:
    """ARRAY<NODE> of a page in document order; NULL for NULL and for a page that cannot be read.  ``sig`` is filled on request only.

    Make it a column of its own and use that.  It is declared non-deterministic, although it is not, so
    that the optimizer evaluates it where it stands: filters made out of later expressions must not copy
    it into their conditions.
    """

    @F.arrow_udf(T.ArrayType(NODE))
    def build(pages: pa.Array) -> pa.Array:
        return _to_arrow([_nodes_of(p, signatures) for p in pages.to_pylist()])

    return build.asNondeterministic()(html)


READ = T.StructType([
    T.StructField("nodes", T.ArrayType(NODE)), T.StructField("again", T.ArrayType(T.StringType())), T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))),
])
_ARROW_LINKS = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))


def read_page(html: Column, refused: Column, titles: Column, whole: Column) -> Column:
    """All that is read of a page in Python, in one trip: ``STRUCT<nodes, again, hrefs, links>``.

    ``links``: address and text of the links that have an address, in document order; ``nodes`` as by ``page_nodes`` where ``whole``
    is true, else NULL: most pages are read for their links only, which are a small part of them;
    ``again`` as by ``reread`` of the ``refused`` JSON texts; ``hrefs``, for an array of ``titles``, the
    address of the first link that holds each.  What is asked of NULL is NULL.
    """

    @F.arrow_udf(READ)
    def build(pages: pa.Array, blocks: pa.Array, wanted: pa.Array, whole: pa.Array) -> pa.Array:
        asked = whole.to_pylist()
        # a page without the name of the attribute has no address to give, and need not be cut up for it
        nodes = [[] if p is not None and not w and "href" not in p.lower() else _nodes_of(p, False) for p, w in zip(pages.to_pylist(), asked)]
        links = [None if n is None else _links_of(n) for n in nodes]
        hrefs = [first_holding(t, k) if t and k is not None else None for t, k in zip(wanted.to_pylist(), links)]
        return pa.StructArray.from_arrays([
            _to_arrow([n if w else None for n, w in zip(nodes, asked)]), reread_texts(pa.array([b or None for b in blocks.to_pylist()], blocks.type)), pa.array(hrefs, pa.list_(pa.string())),
            pa.array([None if k is None else [{"href": h, "text": t} for h, t in k] for k in links], _ARROW_LINKS),
        ], names=READ.names)

    # empty instead of NULL: Spark measures a batch after each row, and passes all its NULL arrays again each time
    refused, titles = (F.coalesce(a, F.array().cast("array<string>")) for a in (refused, titles))
    return build.asNondeterministic()(html, refused, titles, whole)


def _links_of(nodes: list[list]) -> list[tuple[str, str]]:
    """Address and text of the links of a page that have an address, in document order."""
    pre, last, kind, tag, attrs, text = (NODE.names.index(n) for n in ("pre", "last", "kind", "tag", "attrs", "text"))
    out = []
    for node in nodes:
        href = node[tag] == "a" and dict(node[attrs] or ()).get("href")
        if href:
            inside = nodes[node[pre] + 1:node[last] + 1]
            out.append((href, "".join(n[text].strip(WHITE_SPACE) for n in inside if n[kind] == "text")))
    return out


# ---- reading the node array -------------------------------------------------------------------


def inside(nodes: Column, node: Column) -> Column:
    """Descendants of ``node`` in document order."""
    return F.slice(nodes, node["pre"] + 2, node["last"] - node["pre"])


def text_kind(node: Column) -> Column:
    """The kind of text that counts as the text of an element."""
    return F.when(node["tag"].isin(*sorted(OWN_TEXT)), node["tag"]).otherwise("text")


def texts(nodes: Column, node: Column, condition=None) -> Column:
    """Text pieces inside ``node``, as they stand."""
    kind = text_kind(node)
    keep = (lambda t: t["kind"] == kind) if condition is None else (lambda t: (t["kind"] == kind) & condition(t))
    return F.transform(F.filter(inside(nodes, node), keep), lambda t: t["text"])


def stripped(pieces: Column) -> Column:
    """The pieces without white space around them, empty ones left out."""
    return F.filter(F.transform(pieces, strip), lambda t: t != "")


def outermost(spans: Column) -> Column:
    """Of spans in document order, those that lie in no other one.  Spans never overlap in part, so it is
    enough to look at the last one kept."""
    empty = F.struct(F.slice(spans, 1, 0).alias("kept"), F.lit(-2).alias("last"))
    return F.aggregate(
        spans, empty,
        lambda acc, s: F.when(acc["last"] >= s["pre"], acc).otherwise(
            F.struct(F.array_append(acc["kept"], s).alias("kept"), s["last"].alias("last"))
        ),
        lambda acc: acc["kept"],
    )


def elements(nodes: Column, tag: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"] == tag)


def anchors(nodes: Column, within: Column | None = None) -> Column:
    """H5: ``STRUCT<pre, href, text>`` of every link, in document order; the text has its pieces run together."""
    scope = nodes if within is None else inside(nodes, within)
    return F.transform(
        elements(scope, "a"),
        lambda a: F.struct(
            a["pre"].alias("pre"),
            a["attrs"]["href"].alias("href"),
            F.array_join(stripped(texts(nodes, a)), "").alias("text"),
        ),
    )


# The entities that matter in titles; the ampersand comes last.
_TITLE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def title(html: Column) -> Column:
    """H8: text of the first title element with white space run together, 'Unknown' when there is none."""
    pattern = r"(?is)<title(?=[\s>])[^>]*+>(.*?)</title"

    def show(first: Column) -> Column:
        text = strip(F.regexp_replace(replace_all(first, _TITLE_ENTITIES), r"\s+", " "))
        # the page is searched to its end only when its first title is empty or missing
        return F.when(first != "", text).when(html.rlike(pattern), "").otherwise("Unknown")

    return bind(F.regexp_extract(html, pattern, 1), show)
