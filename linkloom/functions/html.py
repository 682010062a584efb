"""Visible text and links of HTML pages, as native column expressions.

A page is cut by one regular expression that knows comments, raw-text elements,
tags with quoted attributes, and declarations. All repeats are possessive or
lazy over single characters, so long pages neither backtrack nor recurse.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import strip

_ATTRS = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
_COMMENT = r"<!--.*?(?:--\s*>|\z)"
_RAW = rf"<(script|style)(?=[\s/>]){_ATTRS}>.*?(?:</\1\s*>|\z)"
# A hidden element with text only; others are found by following the open elements.
_HIDDEN = rf"<(template|rt|rp)(?=[\s/>]){_ATTRS}(?<!/)>[^<]*+</\2\s*>"
_TAG = rf"<[a-z]{_ATTRS}>"
_OTHER = r"<[/!?][^>]*+>"

_MARKUP = f"(?is){_COMMENT}|{_RAW}|{_HIDDEN}|{_TAG}|{_OTHER}"
_MAY_HIDE = r"(?i)<(?:template|rt|rp)[\s/>]"
_ANCHOR = rf"(?is){_COMMENT}|{_RAW}|<a(?=[\s/>])({_ATTRS})>|{_TAG}|{_OTHER}"
_BASE = rf"(?is){_COMMENT}|{_RAW}|<base(?=[\s/>])({_ATTRS})>|{_TAG}|{_OTHER}"
_INVISIBLE = f"(?is){_COMMENT}|{_RAW}"
_ATTRIBUTE = r"""([^\s/=>"']+)(?:\s*=+\s*("[^"]*"|'[^']*'|[^\s>]*))?"""

_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
# Names that HTML also accepts without the closing semicolon, longest first.
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE = f"^({'|'.join(_BARE_NAMES)})"


def _entity_table() -> Column:
    """Map of first letter to the named references that start with it."""
    table: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        table.setdefault(name[0], {})[name] = value
    return F.from_json(F.lit(json.dumps(table)), "map<string,map<string,string>>")


def _windows_table() -> Column:
    """Numeric references 128-159, which HTML reads as Windows-1252."""
    pairs = {str(code): bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(128, 160)}
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _character(code: Column) -> Column:
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "�")
        .when(code.between(128, 159), F.element_at(_windows_table(), code.cast("string")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _decode_piece(piece: Column) -> Column:
    """Text after an ampersand, with the reference it starts with decoded."""
    ref = F.regexp_extract(piece, _REFERENCE, 1)
    rest = F.substring(piece, F.length(ref) + 1, F.length(piece))
    digits = F.regexp_replace(ref, "[#xX;]", "")
    is_hex = F.lower(F.substring(ref, 1, 2)) == "#x"
    code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")

    def named(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(_entity_table(), F.substring(name, 1, 1)), name)

    bare = F.regexp_extract(piece, _BARE, 1)
    after_bare = F.substring(piece, F.length(bare) + 1, F.length(piece))
    return (
        F.when(ref == "", F.concat(F.lit("&"), piece))
        .when(F.startswith(ref, F.lit("#")), F.concat(_character(code), rest))
        .otherwise(
            F.coalesce(
                F.concat(named(ref), rest),
                F.when(bare != "", F.concat(named(bare), after_bare)),
                F.concat(F.lit("&"), piece),
            )
        )
    )


def unescape(text: Column) -> Column:
    """Decode numeric and named character references, each exactly once."""
    pieces = F.split(text, "&")
    decoded = F.concat(
        F.slice(pieces, 1, 1),
        F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _decode_piece),
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


#: Elements that hide their text, and elements that hold nothing.
HIDING = ("template", "rt", "rp")
VOID = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex",
    "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
)
_STATE = "struct<stack: array<struct<name: string, n: int>>, depth: int, base: int, since: int, hidden: array<struct<a: int, b: int>>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def _tags(markup: Column) -> Column:
    """``(i, name, opens)`` of the pieces of markup that open or close an element for others to stand in."""
    pieces = F.regexp_extract_all(markup, F.lit(_MARKUP), F.lit(0))

    def tag(piece: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"(?i)^</?([a-z][^\s/>]*)", 1))
        whole = piece.rlike(rf"(?is)^(?:{_RAW}|{_HIDDEN})$") | (piece.rlike("/>$") & ~piece.rlike(r"""=[^\s"'>]*/>$"""))
        return F.struct(i.alias("i"), name.alias("name"), (~F.startswith(piece, F.lit("</"))).alias("opens"), whole.alias("whole"))

    found = F.filter(F.transform(pieces, tag), lambda t: (t["name"] != "") & ~t["whole"] & ~t["name"].isin(*VOID))
    # An element that nothing closes is only followed if it hides.
    def followed(found: Column) -> Column:
        closed = F.array_distinct(F.transform(F.filter(found, lambda t: ~t["opens"]), lambda t: t["name"]))
        return _let(closed, lambda names: F.filter(found, lambda t: ~t["opens"] | t["name"].isin(*HIDING) | F.array_contains(names, t["name"])))

    return _let(found, followed)


def _follow(state: Column, tag: Column) -> Column:
    """The open elements after one more tag.

    An end tag closes the last open element of its name and all that were opened
    since; without one it is ignored. Neighbours of one name are kept as one entry, so a
    page of elements that are never closed costs no more than its length.
    """
    stack, depth, base = state["stack"], state["depth"], state["base"]
    name, hiding = tag["name"], tag["name"].isin(*HIDING)
    entry = lambda name, n: F.array(F.struct(name.alias("name"), n.cast("int").alias("n")))
    top = F.try_element_at(stack, F.lit(-1))
    pushed = F.when(top["name"] == name, F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), entry(name, top["n"] + 1))).otherwise(
        F.concat(stack, entry(name, F.lit(1)))
    )
    opened = F.struct(
        pushed.alias("stack"), (depth + 1).alias("depth"), F.when((base < 0) & hiding, depth).otherwise(base).alias("base"),
        F.when((base < 0) & hiding, tag["i"]).otherwise(state["since"]).alias("since"), state["hidden"].alias("hidden"),
    )
    back = F.array_position(F.reverse(F.transform(stack, lambda s: s["name"])), name).cast("int")
    at = F.size(stack) - back + 1  # the entry that is closed
    left = F.element_at(stack, at)["n"] - 1
    cut = F.slice(stack, F.lit(1), at - 1)
    cut = F.when(left > 0, F.concat(cut, entry(name, left))).otherwise(cut)
    gone = F.aggregate(F.slice(stack, at + 1, F.size(stack)), F.lit(1), lambda total, s: total + s["n"])
    shown = (base >= 0) & (depth - gone <= base)
    span = F.array(F.struct(state["since"].alias("a"), tag["i"].alias("b")))
    closed = F.struct(
        cut.alias("stack"), (depth - gone).alias("depth"), F.when(shown, -1).otherwise(base).alias("base"),
        state["since"].alias("since"), F.when(shown, F.concat(state["hidden"], span)).otherwise(state["hidden"]).alias("hidden"),
    )
    return F.when(~tag["opens"] & (back == 0), state).when(tag["opens"], opened).otherwise(closed).cast(_STATE)


def _shown_nodes(markup: Column, nodes: Column) -> Column:
    """The text nodes that no open hiding element holds."""
    empty = F.struct(
        F.array().cast("array<struct<name: string, n: int>>").alias("stack"), F.lit(0).alias("depth"), F.lit(-1).alias("base"),
        F.lit(0).alias("since"), F.array().cast("array<struct<a: int, b: int>>").alias("hidden"),
    ).cast(_STATE)
    last = F.size(nodes) - 1

    def indices(state: Column) -> Column:
        open_ = F.when(state["base"] >= 0, F.array(F.struct(state["since"].alias("a"), last.alias("b")))).otherwise(
            F.array().cast("array<struct<a: int, b: int>>")
        )
        spans = F.concat(state["hidden"], open_)
        # The node behind piece i is node i + 1.
        return F.flatten(F.transform(spans, lambda s: F.sequence(s["a"] + 1, F.greatest(s["a"] + 1, s["b"]))))

    hidden = F.aggregate(_tags(markup), empty, _follow, indices)
    return F.transform(F.array_except(F.sequence(F.lit(0), last), hidden), lambda i: F.get(nodes, i))


def _visible(markup: Column) -> Column:
    nodes = F.split(markup, _MARKUP)
    shown = F.when(markup.rlike(_MAY_HIDE), _let(nodes, lambda nodes: _shown_nodes(markup, nodes))).otherwise(nodes)
    stripped = F.transform(shown, lambda node: strip(unescape(node)))
    return F.array_join(F.filter(stripped, lambda node: node != ""), " ")


def page_text(html: Column) -> Column:
    """Visible text nodes, title included, trimmed and joined by one space."""
    return _visible(html)


def page_body_text(html: Column) -> Column:
    """Like ``page_text`` for what lies inside ``<body>``."""
    shown = F.regexp_replace(html, _INVISIBLE, "<br>")
    body = F.regexp_extract(shown, rf"(?is)<body(?=[\s/>]){_ATTRS}>(.*)", 1)
    headless = F.regexp_replace(shown, r"(?is)<head(?=[\s/>])[^>]*+>.*?(?:</head\s*>|\z)|<title(?=[\s/>])[^>]*+>.*?</title\s*>", "<br>")
    return _visible(F.when(shown.rlike(r"(?i)<body[\s/>]"), body).otherwise(headless))


def _href(attributes: Column) -> Column:
    """The ``href`` among the attributes of one anchor, or null."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), 1).alias("name"),
        F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), 2).alias("value"),
    )
    hrefs = F.filter(pairs, lambda pair: F.lower(pair["name"]) == "href")
    value = F.try_element_at(hrefs, F.lit(-1))["value"]
    return unescape(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))


def page_hrefs(html: Column) -> Column:
    """``href`` of every anchor that has one, in document order, as an array."""
    anchors = F.filter(
        F.regexp_extract_all(html, F.lit(_ANCHOR), 2),
        lambda attributes: attributes.rlike("(?i)href"),
    )
    return F.filter(F.transform(anchors, _href), lambda href: href.isNotNull())


def page_base(html: Column) -> Column:
    """``href`` of the first ``<base>`` that has one, or null: what a browser resolves the page's links on."""

    def first(html: Column) -> Column:
        bases = F.filter(F.regexp_extract_all(html, F.lit(_BASE), 2), lambda attributes: attributes.rlike("(?i)href"))
        return F.get(F.filter(F.transform(bases, _href), lambda href: href.isNotNull()), F.lit(0))

    return F.when(html.rlike(r"(?i)<base[\s/]"), first(html))
