"""Podcast media links, external transcripts and speech segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.text import non_empty, strip

_LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def _type(link: Column) -> Column:
    return F.lower(F.coalesce(link["type"], F.lit("")))


def _is_audio(link: Column) -> Column:
    return F.startswith(_type(link), F.lit("audio/"))


def _is_transcript(link: Column) -> Column:
    rel = F.coalesce(link["rel"], F.lit("")) == "transcript"
    in_href = F.contains(F.lower(F.coalesce(link["href"], F.lit(""))), F.lit("transcript"))
    return ~_is_audio(link) & (_type(link).isin(*V.TRANSCRIPT_TYPES) | rel | in_href)


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def media_links(links: Column, enclosures: Column) -> Column:
    """Last audio link, else first audio enclosure; last transcript link."""
    audio = _last(F.filter(links, _is_audio))["href"]
    enclosure = F.get(F.filter(enclosures, _is_audio), F.lit(0))["href"]
    return F.struct(
        F.coalesce(non_empty(audio), enclosure).alias("audio_url"),
        _last(F.filter(links, _is_transcript))["href"].alias("transcript_url"),
    )


def _json_text(body: Column) -> Column:
    """Text of the three known JSON transcript layouts; other JSON and broken JSON as it is."""
    parsed = F.try_parse_json(body)
    segments = F.try_variant_get(parsed, "$", "array<variant>")
    texts = F.transform(segments, lambda s: F.try_variant_get(s, "$.text", "string"))
    return F.coalesce(
        F.when(F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, " ")),
        F.try_variant_get(parsed, "$.transcript", "string"),
        F.try_variant_get(parsed, "$.results.transcripts[0].transcript", "string"),
        body,
    )


def _cue_text(body: Column, *, header: bool) -> Column:
    """Subtitle lines without blanks, timings, cue numbers and lines that start with a digit."""

    def keep(line: Column) -> Column:
        spoken = (strip(line) != "") & ~F.contains(line, F.lit("-->")) & ~line.rlike(r"^\p{Nd}")
        return spoken & ~F.startswith(line, F.lit("WEBVTT")) if header else spoken

    return F.array_join(F.filter(F.split(body, _LINE_BREAK, -1), keep), " ")


def transcript_text(body: Column, content_type: Column, url: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    address = F.coalesce(url, F.lit(""))

    def is_kind(mark: str, suffix: str) -> Column:
        return F.contains(kind, F.lit(mark)) | F.endswith(address, F.lit(suffix))

    return (
        F.when(is_kind("json", ".json"), _json_text(body))
        .when(is_kind("text/vtt", ".vtt"), _cue_text(body, header=True))
        .when(is_kind("text/srt", ".srt"), _cue_text(body, header=False))
        .otherwise(body)
    )


def _minutes_seconds(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("int")
    return F.format_string("%02d:%02d", minutes, F.floor(seconds - minutes * 60).cast("int"))


def format_transcription(text: Column, segments: Column, style: str = "markdown", timestamps: bool = True) -> Column:
    """Markdown with a time range per segment; without segments (NULL) the text under a heading."""
    if style == "text":
        return text
    if style == "json":
        return F.to_json(F.struct(text.alias("text"), segments.alias("segments")), {"ignoreNullFields": "false"})
    if style != "markdown":
        raise ValueError(f"unknown transcription style {style!r}")
    plain = F.concat(F.lit("# Transcription\n\n"), text)
    if not timestamps:
        return plain
    lines = F.transform(
        segments,
        lambda s: F.concat(
            F.lit("**["), _minutes_seconds(s["start"]), F.lit(" - "), _minutes_seconds(s["end"]), F.lit("]** "),
            strip(s["text"]), F.lit("\n\n"),
        ),
    )
    timed = F.concat(F.lit("# Transcription\n\n"), F.array_join(lines, ""))
    return F.when(segments.isNotNull(), timed).otherwise(plain)
