"""Message threads, wrapping, truncation and splitting into parts."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.text import non_empty


def thread_id(chat_id: Column, handle: Column) -> Column:
    """The chat, else the sender; messages with neither share one thread of a fixed name."""
    return F.coalesce(chat_id.cast("string"), handle, F.lit(V.NO_THREAD))


def thread_name(chat_name: Column, contact_name: Column, handle: Column) -> Column:
    return F.coalesce(non_empty(chat_name), non_empty(contact_name), handle)


def sender(from_me: Column, handle: Column) -> Column:
    return F.when(from_me, F.lit("me")).otherwise(handle)


def is_group(style: Column) -> Column:
    return F.coalesce(style == V.GROUP_CHAT_STYLE, F.lit(False))


def wrap(content: Column, prefix: str | None = None, suffix: str | None = None) -> Column:
    parts = [F.lit(f"{prefix}\n\n")] if prefix else []
    parts.append(content)
    if suffix:
        parts.append(F.lit(f"\n\n{suffix}"))
    return F.concat(*parts) if len(parts) > 1 else content


def truncate(content: Column, max_chars: int = V.MESSAGE_MAX_CHARS) -> Column:
    """Cut long messages and say so (the result is three characters over the limit)."""
    head = F.substring(content, 1, max(max_chars - V.TRUNCATION_RESERVE, 0))
    return F.when(F.length(content) > max_chars, F.concat(head, F.lit(V.TRUNCATION_NOTE))).otherwise(content)


#: Characters of parts that are Python strings at a time.
_HELD_CHARS = 1_000_000


def _splitter(max_chars: int) -> Callable[[pa.Array], pa.Array]:
    # A closure, so that it travels to the executors whole.
    blanks = re.compile(r"\s*")

    def cuts(text: str) -> list[str]:
        parts, start, end = [], 0, len(text)
        while end - start > max_chars:
            limit = start + max_chars
            places = (text.rfind(mark, start, limit) for mark in ("\n\n", "\n", ". "))
            cut = next((place for place in places if place > start), limit)
            parts.append(text[start:cut])
            start = blanks.match(text, cut).end()
        if start < end:
            parts.append(text[start:])
        return parts

    def split(texts: pa.Array) -> pa.Array:
        # A batch may hold thousands of long texts: few of them are Python strings at a time.
        kind, done, few, size = pa.list_(pa.string()), [], [], 0
        for text in texts:
            few.append(None if not text.is_valid else cuts(text.as_py()))
            size += 0 if few[-1] is None else sum(map(len, few[-1]))
            if size > _HELD_CHARS or len(few) > 1000:
                done.append(pa.array(few, kind))
                few, size = [], 0
        return pa.concat_arrays([*done, pa.array(few, kind)])

    return split


def split_message(content: Column, max_chars: int = V.MESSAGE_MAX_CHARS) -> Column:
    """Greedy parts of at most `max_chars`, cut at the last blank line, else newline, else sentence end.

    Each cut depends on the one before, so the loop runs in an Arrow-batched function, linear in the
    text length; the same loop as a native `aggregate` took seven times as long. Only texts over the
    limit leave the JVM.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be positive")
    split = F.arrow_udf(_splitter(max_chars), "array<string>")
    too_long = F.length(content) > max_chars
    return F.coalesce(split(F.when(too_long, content)), F.array(content))


def numbered_part(part_no: Column, part_count: Column, part: Column) -> Column:
    label = F.concat(
        F.lit("[Part "), part_no.cast("string"), F.lit("/"), part_count.cast("string"), F.lit("]\n\n"), part
    )
    return F.when(part_count > 1, label).otherwise(part)
