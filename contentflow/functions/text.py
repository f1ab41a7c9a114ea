"""Text expressions: sniffing, cleaning, counting, content and URL choice, page text."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow import values as V


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (`trim` only knows U+0020)."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def non_empty(c: Column) -> Column:
    """NULL for the empty string, else the value."""
    return F.nullif(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def sub_closed(c: Column, pattern: str, end: str, replacement: str) -> Column:
    """Like `sub`, for a pattern whose matches end with `end`.

    Behind the last `end` nothing can match. Not searching there keeps a text with many openings that are
    never closed from being read to its end for each of them.
    """

    def replace(text: Column) -> Column:
        rest = F.substring_index(text, end, -1)
        closed = F.substring(text, F.lit(1), F.length(text) - F.length(rest))
        return F.concat(sub(closed, pattern, replacement), rest)

    return let(c, replace)


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def is_markdown(c: Column) -> Column:
    """A leading `#`, any markdown mark (a `>` of an HTML tag counts too), or a link."""
    link = F.contains(c, F.lit("[")) & F.contains(c, F.lit("]("))
    return F.startswith(c, F.lit("#")) | contains_any(c, V.MARKDOWN_MARKS) | link


def text_format(c: Column) -> Column:
    return F.when(is_markdown(c), "markdown").otherwise("html")


def clean_markdown(c: Column) -> Column:
    c = sub_closed(c, V.TAG, ">", " ")
    c = sub(c, V.EMPTY_LINK, "")
    c = sub_closed(c, V.EMPTY_HTTP_LINK, ")", "")
    c = sub(c, V.MANY_NEWLINES, "\n\n")
    return strip(sub(c, V.WS + "{2,}", " "))


def clean_html(c: Column) -> Column:
    for block, end in ((V.SCRIPT_BLOCK, "</script>"), (V.STYLE_BLOCK, "</style>"), (V.COMMENT, "-->")):
        c = sub_closed(c, block, end, "")
    for entity, char in V.FEED_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = sub_closed(c, V.TAG, ">", " ")
    return strip(sub(c, V.WS_RUN, " "))


def clean(c: Column, mode: str = "compat") -> Column:
    """Cleaned text; `''` for NULL. `compat` sniffs the format first, `html` forces the HTML rules."""
    if mode == "html":
        cleaned = clean_html(c)
    elif mode == "compat":
        cleaned = F.when(is_markdown(c), clean_markdown(c)).otherwise(clean_html(c))
    else:
        raise ValueError(f"unknown cleaning mode {mode!r}")
    return F.coalesce(cleaned, F.lit(""))


def word_count(c: Column) -> Column:
    """Number of white-space separated words, 0 for NULL."""
    words = F.regexp_count(c, F.lit(V.NON_WS + "+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def pick_content(values: Column, *fallbacks: Column) -> Column:
    """First long value, else the last value, else the first non-empty fallback, else `''`."""
    present = F.filter(values, lambda v: v.isNotNull())
    long_value = F.get(F.filter(present, lambda v: F.length(v) > V.SUBSTANTIAL_CONTENT), F.lit(0))
    last_value = F.get(present, F.size(present) - 1)
    return F.coalesce(long_value, non_empty(last_value), *[non_empty(f) for f in fallbacks], F.lit(""))


def origin_url(description: Column) -> Column:
    """First absolute link of an anchor, else the first bare URL, else NULL."""
    href = F.regexp_extract(description, V.ORIGIN_HREF, 2)
    bare = F.regexp_extract(description, V.BARE_URL, 0)
    return F.coalesce(non_empty(href), non_empty(bare))


def entry_guid(entry_id: Column, link: Column) -> Column:
    """The id when present, even if blank; else the link; else `''`."""
    return F.coalesce(entry_id, link, F.lit(""))


def entry_url(link: Column, guid: Column) -> Column:
    return F.coalesce(non_empty(link), guid)


def needs_enrichment(content: Column, url: Column, enabled: bool = True) -> Column:
    """Content is missing, short or cut off, and there is a web address to look it up by."""
    body = F.coalesce(content, F.lit(""))
    incomplete = (F.length(body) < V.SHORT_CONTENT) | contains_any(F.lower(body), V.ENRICHMENT_HINTS)
    return F.lit(enabled) & incomplete & F.coalesce(F.startswith(url, F.lit("http")), F.lit(False))


# --- pages -------------------------------------------------------------------------------------

_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# References that pages also write without the semicolon: numbers, and the old names.
_OLD_NAMES = sorted((name for name in html.entities.html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
_LOOSE_ENTITY = rf"&(?:#[0-9]{{1,7}};?|#[xX][0-9a-fA-F]{{1,6}};?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{'|'.join(_OLD_NAMES)}))"

# A tag: a name, then anything up to `>`, but a quoted value (behind a `=`) is taken whole. A quote that is
# never closed is a character like others. All repetitions are possessive, so no text is read twice.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+')?+"""
_TAG_REST = rf"(?:[^>=]++|{_VALUE})*+>"
# What separates two text nodes of a page: whole script and style elements, comments, declarations, tags.
_MARKUP = (
    rf"(?is)<script(?![^\s/>]){_TAG_REST}.*?(?:</script(?![^\s/>])[^>]*+>|\z)"
    rf"|<style(?![^\s/>]){_TAG_REST}.*?(?:</style(?![^\s/>])[^>]*+>|\z)"
    r"|<!--.*?(?:-->|\z)"
    r"|<[!?][a-z][^>]*+>"
    rf"|</?[a-z]{_TAG_REST}"
)
# Elements whose content is text, whatever it looks like; only references count in it.
_TEXT_ONLY = r"(?is)(?=<(?:textarea|title)(?![^\s/>]))|(?<=</textarea>|</title>)"
_TITLE = rf"(?is)<title(?![^\s/>]){_TAG_REST}(.*?)</title\s*>"


def _entity_names() -> Column:
    """Map of `&name;`, and of the old names without `;`, to their characters, as one folded literal."""
    names = {f"&{name}": text for name, text in html.entities.html5.items()}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


# Numbers from 128 to 159 mean the characters of Windows-1252.
_CONTROLS = "".join(map(chr, range(128, 160)))
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def _code_point(number: Column) -> Column:
    return F.translate(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"), _CONTROLS, _WINDOWS)


def _decode_one(entity: Column, names: Column) -> Column:
    digits = F.regexp_replace(entity, "^&#[xX]?|;$", "")
    number = F.when(F.lower(F.substring(entity, 1, 3)) == "&#x", F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
    usable = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    # An old name may be the beginning of a longer word.
    old = F.regexp_extract(entity, rf"^&(?:{'|'.join(_OLD_NAMES)})", 0)
    older = F.concat(F.element_at(names, non_empty(old)), F.substring(entity, F.length(old) + 1, F.length(entity)))
    return (
        F.when(~F.startswith(entity, F.lit("&#")), F.coalesce(F.element_at(names, entity), older))
        .when(usable, _code_point(number))
        .otherwise(F.lit("�"))
    )


def decode_entities(c: Column, loose: bool = False) -> Column:
    """Decode every character reference once, in one pass, so `&amp;lt;` becomes `&lt;`.

    `loose` also reads those that do not end with `;`, as browsers do in texts.
    """
    names, pattern = _entity_names(), _LOOSE_ENTITY if loose else _ENTITY
    between = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        between,
        found,
        lambda text, entity: F.concat(
            text, F.when(entity.isNull(), "").otherwise(F.coalesce(_decode_one(entity, names), entity))
        ),
    )
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def _without_inner_tags(page: Column) -> Column:
    """The page with every `<` inside text-only elements written as a reference."""

    def part(text: Column) -> Column:
        inside = F.regexp_replace(text, r"(?is)(?<!^)<(?!/(?:textarea|title)\s*>)", "&lt;")
        return F.when(text.rlike(r"(?is)^<(?:textarea|title)(?![^\s/>])"), inside).otherwise(text)

    return F.when(page.rlike(r"(?i)<(?:textarea|title)(?![^\s/>])"), F.array_join(F.transform(F.split(page, _TEXT_ONLY, -1), part), "")).otherwise(page)


def page_title(page: Column) -> Column:
    title = non_empty(F.regexp_extract(page, _TITLE, 1))
    return F.coalesce(decode_entities(title, loose=True), F.lit("No title"))


def page_text(page: Column) -> Column:
    """Stripped text nodes, one per line, without script, style, comments and declarations.

    Tags end where a browser ends them: a `>` in a quoted value is part of the tag. What stands in a `textarea` or a `title` is
    text, even if it looks like tags.
    """

    def readable(whole: Column) -> Column:
        # Behind the last `>` no tag ends: not looking for one there keeps many openings from being read to the end each.
        tail = F.substring_index(whole, ">", -1)
        closed = F.substring(whole, F.lit(1), F.length(whole) - F.length(tail))
        return F.concat(closed, F.regexp_replace(tail, "<(?!!--)", "&lt;"))

    markup = let(_without_inner_tags(page), readable)
    nodes = F.transform(F.split(markup, _MARKUP, -1), lambda node: strip(decode_entities(node, loose=True)))
    lines = F.array_join(F.filter(nodes, lambda node: node != ""), "\n")
    return F.coalesce(lines, F.lit(""))


def page_document(title: Column, body: Column, url: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n\nSource: "), url)
