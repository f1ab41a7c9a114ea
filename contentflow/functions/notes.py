"""Note rendering: file names, templates, front matter, footer."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow.functions.dates import stamp


def format_template(template: str, columns: Mapping[str, Column], metadata: Column | None = None) -> Column:
    """`str.format`-like filling in one pass: named columns first, then metadata keys.

    A field that is in neither gives NULL, which the note sink reports as a failed row.
    """
    parts: list[Column] = []
    for literal, field, _spec, _conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if field in columns:
            parts.append(F.coalesce(columns[field], F.lit("None")))
        elif metadata is not None:
            known = F.map_contains_key(metadata, F.lit(field))
            value = F.coalesce(F.try_element_at(metadata, F.lit(field)), F.lit("None"))
            parts.append(F.when(known, value))
        else:
            raise ValueError(f"template field {field!r} has no column")
    return F.concat(*parts) if parts else F.lit("")


def note_title(metadata: Column) -> Column:
    known = F.map_contains_key(metadata, F.lit("title"))
    return F.when(known, F.coalesce(F.try_element_at(metadata, F.lit("title")), F.lit("None"))).otherwise("Untitled")


def safe_title(title: Column) -> Column:
    """Letters, digits, space, `-` and `_` stay; outer blanks go; inner blanks become `_`."""
    allowed = F.regexp_replace(title, r"[^\p{L}\p{N} \-_]", "_")
    return F.replace(F.trim(allowed), F.lit(" "), F.lit("_"))


def _clock(as_of: Column) -> dict[str, Column]:
    return {"date": stamp(as_of, "yyyy-MM-dd"), "time": stamp(as_of, "HH-mm-ss")}


def file_name(template: str, metadata: Column, item_id: Column, source: Column, as_of: Column) -> Column:
    fields = {"title": safe_title(note_title(metadata)), "id": item_id, "source": source, **_clock(as_of)}
    name = format_template(template, fields)
    return F.when(F.endswith(name, F.lit(".md")), name).otherwise(F.concat(name, F.lit(".md")))


def apply_template(
    template: str, content: Column, metadata: Column, item_id: Column, source: Column, as_of: Column
) -> Column:
    """Content template over the fixed fields and the metadata; the fixed fields win."""
    fields = {"content": content, "title": note_title(metadata), "id": item_id, "source": source, **_clock(as_of)}
    return format_template(template, fields, metadata)


def front_matter(
    metadata: Column, tags: Column, source: Column, as_of: Column,
    key_order: Sequence[str] = (), config_tags: Sequence[str] = (),
) -> Column:
    """YAML head: title, date, source, tags, then the other non-NULL metadata.

    Keys come in `key_order`, further keys alphabetically, since the order inside a map is no contract.
    """
    leading = F.array(*[F.lit(k) for k in key_order]) if key_order else F.array().cast("array<string>")
    extra = F.array_sort(F.array_except(F.map_keys(metadata), leading))
    shown = F.filter(
        F.concat(leading, extra),
        lambda k: ~k.isin("title", "tags") & F.try_element_at(metadata, k).isNotNull(),
    )
    lines = F.transform(shown, lambda k: F.concat(k, F.lit(": "), F.try_element_at(metadata, k), F.lit("\n")))
    own = F.array(*[F.lit(t) for t in config_tags]) if config_tags else F.array().cast("array<string>")
    all_tags = F.concat(own, F.coalesce(tags, F.array().cast("array<string>")))
    tag_lines = F.array_join(F.transform(all_tags, lambda t: F.concat(F.lit("  - "), t, F.lit("\n"))), "")
    return F.concat(
        F.lit('---\ntitle: "'), note_title(metadata), F.lit('"\ndate: '), stamp(as_of, "yyyy-MM-dd HH:mm:ss"),
        F.lit("\nsource: "), source, F.lit("\n"),
        F.when(F.size(all_tags) > 0, F.concat(F.lit("tags:\n"), tag_lines)).otherwise(""),
        F.array_join(lines, ""), F.lit("---\n\n"),
    )


def with_front_matter(content: Column, head: Column) -> Column:
    return F.when(F.startswith(content, F.lit("---")), content).otherwise(F.concat(head, content))


def with_footer(content: Column, as_of: Column) -> Column:
    footer = F.concat(F.lit("\n\n> Generated on "), stamp(as_of, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    return F.when(F.contains(content, F.lit("Generated on ")), content).otherwise(F.concat(content, footer))
