"""Recognised speech to transcripts, with optional correction by a model in two steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import schema
from contentflow import values as V
from contentflow.functions.prompts import (
    correction_prompt,
    domain_prompt,
    parse_correction,
    parse_response,
    prompt_messages,
)
from contentflow.functions.text import strip
from contentflow.functions.transcripts import format_transcription
from contentflow.operators.models import Completer, call_key, complete

# Keeps the answers of a step so that they are used twice but asked for once: (name, answers) -> answers.
Keep = Callable[[str, DataFrame], DataFrame]
# Asks and keeps in one: (name, requests, make_completer, options) -> answers, see `complete_in_waves`.
Ask = Callable[..., DataFrame]


def _ask(
    rows: DataFrame, prompt: Column, step: str, model_id: str, make_completer, keep: Keep, ask: Ask | None, **options
) -> DataFrame:
    """Rows with the `answer` of the model, NULL when the call failed, and the `problem`."""
    requests = rows.withColumns(
        {"messages": prompt_messages(prompt), "model_id": F.lit(model_id), "params": F.lit("{}")}
    ).withColumn("call_key", call_key())
    if ask is None:
        answers = keep(step, complete(requests, make_completer, **options))
    else:
        answers = ask(step, requests, make_completer, **options)
    parsed = parse_response(F.col("response"))
    told = answers.select("call_key", parsed.alias("parsed"), "call_error")
    # The answers of a partition are hashed: the rows, which hold whole transcripts, are not sorted.
    joined = requests.drop("messages", "model_id", "params").join(told.hint("shuffle_hash"), "call_key", "left")
    return joined.withColumns(
        {"answer": strip(F.col("parsed.content")), "problem": F.coalesce("call_error", "parsed.error_message")}
    ).drop("call_key", "parsed", "call_error")


def correct_transcripts(
    transcripts: DataFrame,
    make_completer: Callable[[], Completer] | None,
    keep: Keep,
    *,
    model_id: str = V.CORRECTION_MODEL,
    sample_chars: int = V.TOPIC_SAMPLE_CHARS,
    ask: Ask | None = None,
    **options,
) -> DataFrame:
    """(…, transcript) plus (domain, corrected_text, corrections).

    Without a completer, and for rows without text, nothing is asked. A failed domain call falls back to
    the general domain; a failed correction keeps the text.
    """
    untouched = {
        "domain": F.lit(None).cast("string"),
        "corrected_text": F.col("transcript"),
        "corrections": F.lit(V.NO_CORRECTION),
    }
    if make_completer is None:
        return transcripts.withColumns(untouched)
    has_text = F.coalesce(F.col("transcript") != "", F.lit(False))
    asked = transcripts.filter(has_text)
    detect = domain_prompt(F.coalesce("title", F.lit("Untitled Content")), F.col("transcript"), sample_chars)
    named = _ask(asked, detect, "domains", model_id, make_completer, keep, ask, **options)
    named = named.withColumn("domain", F.coalesce("answer", F.lit(V.FALLBACK_DOMAIN))).drop("answer", "problem")
    fixed = _ask(
        named, correction_prompt(F.col("domain"), F.col("transcript")), "corrections", model_id, make_completer, keep, ask,
        **options,
    )
    parsed = parse_correction(F.col("answer"), F.col("transcript"))
    failed = F.col("answer").isNull()
    corrected = fixed.withColumn("parsed", parsed).withColumns(
        {
            "corrected_text": F.when(failed, F.col("transcript")).otherwise(F.col("parsed.corrected")),
            "corrections": F.when(failed, F.concat(F.lit("Error: "), F.coalesce("problem", F.lit("no answer"))))
            .otherwise(F.col("parsed.corrections")),
        }
    ).drop("answer", "problem", "parsed")
    return corrected.unionByName(transcripts.filter(~has_text).withColumns(untouched))


def transcribe_items(
    items: DataFrame,
    speech: DataFrame,
    keep: Keep,
    make_completer: Callable[[], Completer] | None = None,
    *,
    style: str = "markdown",
    timestamps: bool = True,
    **options,
) -> DataFrame:
    """Audio items as transcript results, from landed speech (guid, text, segments, language, duration).

    Segments keep the recognised words; the corrected text is in the metadata. Items without landed speech
    become failed rows.
    """
    guid = F.try_element_at("metadata", F.lit("guid"))
    told = speech.select(F.col("guid").alias("speech_guid"), F.col("text").alias("transcript"), "segments", "language", "duration")
    joined = items.withColumn("speech_guid", guid).join(told, "speech_guid", "left").drop("speech_guid")
    titled = joined.withColumn("title", F.try_element_at("metadata", F.lit("title")))
    corrected = correct_transcripts(titled, make_completer, keep, **options)
    found = F.col("transcript").isNotNull()
    extra = F.create_map(
        F.lit("language"), F.col("language"),
        F.lit("duration"), F.col("duration").cast("string"),
        F.lit("segments"), F.greatest(F.coalesce(F.size("segments"), F.lit(0)), F.lit(0)).cast("string"),
        F.lit("domain"), F.col("domain"),
        F.lit("corrections"), F.col("corrections"),
        F.lit("corrected_text"), F.col("corrected_text"),
    )
    shown = F.map_filter(extra, lambda k, v: ~k.isin("domain", "corrected_text") | v.isNotNull())
    kept = F.map_filter("metadata", lambda k, _: ~F.array_contains(F.map_keys(shown), k))
    text = format_transcription(F.col("corrected_text"), F.col("segments"), style, timestamps)
    return corrected.withColumns(
        {
            "success": found,
            "error_message": F.when(~found, F.lit("Transcription error: no speech result for this item")),
            "content": F.when(found, text).otherwise(F.col("content")),
            "metadata": F.when(found, F.map_concat(kept, shown)).otherwise(F.col("metadata")),
            "content_type": F.lit("text"),
            "result_metrics": F.lit(None).cast(schema.METRICS),
        }
    ).select(*schema.RESULT_COLUMNS)
