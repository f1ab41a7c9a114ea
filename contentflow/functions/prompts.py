"""Prompt building and model response parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentflow import schema
from contentflow import values as V
from contentflow.functions.notes import format_template
from contentflow.functions.text import strip, word_count


def _variable(name: str, content: Column, metadata: Column | None) -> tuple[Column, Column]:
    """(is the variable known, its text). Metadata wins over the content; NULL reads `None`."""
    known = F.lit(name == "content")
    text = content if name == "content" else F.lit(None).cast("string")
    if metadata is not None:
        in_metadata = F.coalesce(F.map_contains_key(metadata, F.lit(name)), F.lit(False))
        known = known | in_metadata
        text = F.when(in_metadata, F.try_element_at(metadata, F.lit(name))).otherwise(text)
    return known, F.coalesce(text, F.lit("None"))


def fill_prompt(
    template: Column | str, content: Column, metadata: Column | None = None, variables: tuple[str, ...] = ("content",)
) -> Column:
    """Replace `{name}` of every declared variable, one after the other."""
    prompt = F.lit(template) if isinstance(template, str) else template
    for name in variables:
        known, text = _variable(name, content, metadata)
        # An unknown variable is replaced by itself, so the prompt appears once in the expression.
        placeholder = F.lit("{" + name + "}")
        prompt = F.replace(prompt, placeholder, F.when(known, text).otherwise(placeholder))
    return prompt


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(prompt: Column, system_message: Column | str | None = None) -> Column:
    """array<struct<role, content>>: the system message when there is one, then the prompt."""
    user = F.array(message("user", prompt))
    if system_message is None:
        return user
    system = F.lit(system_message) if isinstance(system_message, str) else system_message
    both = F.array(message("system", system), message("user", prompt))
    return F.when(F.coalesce(system, F.lit("")) != "", both).otherwise(user)


def joined_messages(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def approx_tokens(messages: Column, completion: Column) -> Column:
    """Token counts by white-space words, for models that report none."""
    prompt_words = word_count(joined_messages(messages))
    return F.struct(prompt_words.alias("tokens_in"), word_count(completion).alias("tokens_out"))


def parse_response(response: Column) -> Column:
    """Fields of a chat completion: success, content, token counts, provider, error message."""
    parsed = F.from_json(response, schema.MODEL_RESPONSE)
    usable = F.coalesce(F.size(parsed["choices"]) > 0, F.lit(False))
    usage = parsed["usage"]
    return F.struct(
        usable.alias("success"),
        F.when(usable, F.get(parsed["choices"], F.lit(0))["message"]["content"]).alias("content"),
        F.when(usable, F.coalesce(usage["prompt_tokens"], F.lit(0))).alias("tokens_in"),
        F.when(usable, F.coalesce(usage["completion_tokens"], F.lit(0))).alias("tokens_out"),
        F.when(usable, F.split_part(F.coalesce(parsed["model"], F.lit("")), F.lit("/"), F.lit(1))).alias("provider"),
        F.when(~usable, F.lit(V.BAD_RESPONSE)).alias("error_message"),
    )


def domain_prompt(title: Column, transcript: Column, sample_chars: int = V.TOPIC_SAMPLE_CHARS) -> Column:
    sample = F.substring(transcript, 1, sample_chars)
    # Filled in one pass, so that text of one field is never read as another field.
    return format_template(V.DOMAIN_PROMPT, {"title": title, "sample": sample})


def correction_prompt(domain: Column, transcript: Column) -> Column:
    return format_template(V.CORRECTION_PROMPT, {"domain": domain, "transcript": transcript})


def parse_correction(answer: Column, transcript: Column) -> Column:
    """Corrected text and list of changes; the original text when the answer has another form."""
    parts = F.split(strip(answer), V.CHANGES_SEPARATOR, -1)
    well_formed = F.coalesce(F.size(parts) == 2, F.lit(False))
    corrected = strip(F.replace(F.get(parts, F.lit(0)), F.lit(V.CORRECTION_HEADER), F.lit("")))
    return F.struct(
        F.when(well_formed, corrected).otherwise(transcript).alias("corrected"),
        F.when(well_formed, strip(F.get(parts, F.lit(1))))
        .otherwise(F.lit(V.CORRECTION_FORMAT_ERROR))
        .alias("corrections"),
    )
