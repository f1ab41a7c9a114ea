"""Reading feed bodies that are not well-formed XML, as expressions.

A strict parser reads all of a body or nothing. Here a body is cut at the bounds of its items, an item at the bounds of the
elements that a feed has, and what is found is written anew as XML that a strict parser takes: the texts escaped, the known
attributes quoted. Markup inside a text is kept as text, as feeds mean it. Every pattern is linear in the length of the body: repetitions are of
single characters, or possessive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow.functions.text import decode_entities, let, non_empty

#: Elements of an entry and of a feed's head that the engine reads (fixed by the feed formats).
ENTRY_ELEMENTS = (
    "guid", "id", "title", "author", "dc:creator", "pubDate", "published", "updated", "created", "dc:date", "summary",
    "description", "content:encoded", "content", "value", "link", "enclosure",
)
HEAD_ELEMENTS = ("title", "description", "subtitle", "author", "link")
ATTRIBUTES = ("href", "rel", "type", "url", "isPermaLink")

# Quoted values may hold a `>`; a quote that is never closed is a character like others.
_REST_OF_TAG = r"""((?:\s(?:[^<>"'/]++|"[^"<]*+"|'[^'<]*+'|/(?!>)|["'])*+)?)"""
# An item ends at its end tag, where the next one begins, or with the body; the text is read in runs without a `<`.
_ITEM = rf"(?s)<(item|entry){_REST_OF_TAG}>((?:[^<]++|<(?!/\1\s*+>|\1[\s>]))*+)(?:</\1\s*>)?"
_FIRST_ITEM = r"(?s)<(?:item|entry)[\s>].*"
_ROOT = r"<(?:rss|feed|rdf:RDF|channel)[\s>]"
_CDATA = r"(?=<!\[CDATA\[)|(?<=\]\]>)"
# Written by what is allowed: most characters are told by the first range.
_NO_XML = r"[^\x20-�\x{10000}-\x{10FFFF}\t\n\r]"
# A reference that XML knows itself.
_KNOWN = r"(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});"


def _escaped(text: Column) -> Column:
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def _repaired(markup: Column) -> Column:
    """Markup without comments, with references that XML knows, and with every `<` that opens no tag escaped."""

    def named(hidden: Column) -> Column:
        # Names that only HTML knows become their characters; what XML knows is hidden meanwhile.
        return F.replace(F.replace(decode_entities(hidden), F.lit("&"), F.lit("&amp;")), F.lit("\x00"), F.lit("&"))

    def shown(told: Column) -> Column:
        return F.when(F.contains(told, F.lit("&")), let(F.regexp_replace(told, f"&({_KNOWN})", "\x00$1"), named)).otherwise(told)

    told = F.when(F.contains(markup, F.lit("<!--")), F.regexp_replace(markup, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(markup)
    return F.regexp_replace(let(told, shown), "<(?![A-Za-z_/!?])", "&lt;")


def normalised(body: Column) -> Column:
    """The body without CDATA sections, comments and characters that XML cannot hold; its `&` and stray `<` escaped."""

    def part(text: Column) -> Column:
        inside = F.regexp_replace(F.substr(text, F.lit(10)), r"\]\]>\z", "")
        return F.when(F.startswith(text, F.lit("<![CDATA[")), _escaped(inside)).otherwise(_repaired(text))

    def parts(text: Column) -> Column:
        cut = F.contains(text, F.lit("<![CDATA[")) | F.contains(text, F.lit("]]>"))
        return F.when(cut, F.array_join(F.transform(F.split(text, _CDATA, -1), part), "")).otherwise(_repaired(text))

    # A tag that the end of the body cuts off is left out.
    clean = F.regexp_replace(F.regexp_replace(body, _NO_XML, ""), r"<(?!!)[^<>]*+\z", "")
    return let(clean, parts)


def _attributes(tag: Column) -> Column:
    """The known attributes of a tag's text, quoted."""

    def written(found: Column, name: str) -> Column:
        value = F.regexp_replace(found, r"""(?s)^[^=]*=\s*["']?|["']$""", "")
        return F.concat(F.lit(f' {name}="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))

    return F.concat(
        *(
            let(
                F.regexp_extract(tag, rf"""\s{name}\s*+=\s*+(?:"[^"<]*+"?|'[^'<]*+'?|[^\s"'<>]++)""", 0),
                (lambda name: lambda found: F.when(found == "", "").otherwise(written(found, name)))(name),
            )
            for name in ATTRIBUTES
        )
    )


def _text(inner: Column) -> Column:
    """The text of an element: markup in it is text too."""
    return F.when(F.contains(inner, F.lit("<")), _escaped(inner)).otherwise(inner)


def _rewritten(markup: Column, names: tuple[str, ...]) -> Column:
    """The named elements of the markup, in their order, as well-formed XML.

    An element ends at its end tag; without one, where the next named element begins.
    """
    listed = "|".join(names)
    pattern = rf"(?s)<({listed}){_REST_OF_TAG}(?:/>|>(?:(.*?)</\1\s*>|(.*?)(?=<(?:{listed})[\s/>]|\z)))"

    def written(name: Column, tag: Column, inner: Column) -> Column:
        def author(person: Column) -> Column:
            return F.coalesce(F.concat(F.lit("<name>"), _text(person), F.lit("</name>")), _text(inner))

        body = (
            F.when(name == "author", let(non_empty(F.regexp_extract(inner, r"(?s)<name[^<>]*>(.*?)(?:</name\s*>|\z)", 1)), author))
            # The content of an XHTML element is the markup in its div.
            .when(name == "content", let(F.regexp_replace(inner, r"(?s)\A\s*<div[^<>]*>(.*)</div\s*>\s*\z", "$1"), _text))
            .otherwise(_text(inner))
        )
        return F.concat(F.lit("<"), name, F.when(tag == "", "").otherwise(_attributes(tag)), F.lit(">"), body, F.lit("</"), name, F.lit(">"))

    # Each part is bound: an expression that is named several times would be evaluated as often.
    def element(found: Column) -> Column:
        name = F.regexp_extract(found, r"^<([\w:]+)", 1)
        tag = F.regexp_extract(found, rf"^<[\w:]+{_REST_OF_TAG}", 1)
        # What stands between the tags.
        after = F.regexp_replace(found, rf"^<[\w:]+{_REST_OF_TAG}/?>", "")
        inner = F.regexp_replace(after, r"</[\w:]+\s*>\z", "")
        return let(name, lambda n: let(tag, lambda t: let(inner, lambda i: written(n, t, i))))

    return F.array_join(F.transform(F.regexp_extract_all(markup, F.lit(pattern), F.lit(0)), element), "")


def items(clean: Column) -> Column:
    """The items and entries of a normalised body, each as the inside of its element; an item that is cut off ends with the body."""
    return F.regexp_extract_all(clean, F.lit(_ITEM), F.lit(3))


def entry_xml(item: Column) -> Column:
    return F.concat(F.lit("<entry>"), _rewritten(item, ENTRY_ELEMENTS), F.lit("</entry>"))


def head_xml(clean: Column) -> Column:
    """The own elements of a feed: what stands before the first item of its normalised body."""
    before = F.regexp_replace(clean, _FIRST_ITEM, "")
    return F.concat(F.lit("<head>"), _rewritten(before, HEAD_ELEMENTS), F.lit("</head>"))


def complaint(body: Column) -> Column:
    """Why a body is no feed at all; NULL for one that can be read."""
    return F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty body").when(~body.rlike(_ROOT), "no feed in the body")

