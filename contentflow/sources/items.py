"""Items: the common row shape that sources produce and stages consume."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentflow import schema
from contentflow import values as V
from contentflow.functions.text import non_empty


def item_id(source: Column, *natural_key: Column) -> Column:
    """A reproducible id, the same on every rerun and in every partition."""
    return F.sha2(F.concat_ws("\x1f", source, *[k.cast("string") for k in natural_key]), 256)


def metadata_map(df: DataFrame, entries: Mapping[str, Column]) -> Column:
    """Text map of the entries in the given order; booleans read `True` / `False`, NULL stays NULL."""
    types = df.select(*[c.alias(k) for k, c in entries.items()]).schema
    texts = []
    for field, column in zip(types, entries.values()):
        text = column.cast("string")
        texts += [F.lit(field.name), F.initcap(text) if isinstance(field.dataType, T.BooleanType) else text]
    return F.create_map(*texts)


def no_metrics() -> Column:
    return F.struct(
        F.lit(0.0).alias("execution_time_ms"),
        F.lit(None).cast("bigint").alias("tokens_in"),
        F.lit(None).cast("bigint").alias("tokens_out"),
        F.lit(1).alias("call_count"),
        F.lit(0).alias("errors"),
    )


def make_items(
    df: DataFrame,
    *,
    content: Column,
    source: Column | str,
    natural_key: Column,
    metadata: Mapping[str, Column],
    timestamp: Column,
    content_type: Column | str = "text",
    tags: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    if isinstance(content_type, str) and content_type not in V.CONTENT_TYPES:
        raise ValueError(f"unknown content type {content_type!r}")
    source = F.lit(source) if isinstance(source, str) else source
    content_type = F.lit(content_type) if isinstance(content_type, str) else content_type
    return df.select(
        item_id(source, natural_key).alias("id"),
        content.alias("content"),
        content_type.alias("content_type"),
        source.alias("source"),
        timestamp.cast("timestamp_ntz").alias("timestamp"),
        metadata_map(df, metadata).alias("metadata"),
        (F.array().cast("array<string>") if tags is None else tags).alias("tags"),
        no_metrics().cast(schema.METRICS).alias("metrics"),
        *keep,
    )


def item_json(columns: list[str] | None = None) -> Column:
    """Full JSON of an item, NULL fields included."""
    columns = columns or schema.ITEM_COLUMNS
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return F.to_json(F.struct(*columns), options)


def _article_metadata() -> dict[str, Column]:
    renamed = {"feed_id": "feed", "original_id": "guid"}
    return {key: F.col(renamed.get(key, key)) for key in V.ARTICLE_KEYS}


def article_items(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Stored articles as items; the parent gives the title. Undated articles use the fetch time."""
    parents = feeds.select(F.col("url").alias("feed"), F.col("title").alias("feed_title"))
    joined = articles.join(parents, "feed")
    return make_items(
        joined,
        content=F.col("content"),
        source=F.concat(F.lit("rss:"), F.col("feed_title")),
        natural_key=F.col("guid"),
        metadata=_article_metadata(),
        timestamp=F.coalesce("published_at", "fetched_at"),
        keep=("guid",),
    )


def episode_items(episodes: DataFrame, podcasts: DataFrame) -> DataFrame:
    """Stored episodes as items: the transcript as text, or the description of a still silent episode."""
    parents = podcasts.select(
        "feed_url", F.col("title").alias("podcast_title"), F.col("author").alias("podcast_author")
    )
    joined = episodes.join(parents, "feed_url")
    renamed = {"podcast_id": "feed_url", "original_id": "guid"}
    transcript = non_empty(F.col("transcript"))
    return make_items(
        joined,
        content=F.coalesce(transcript, F.col("description")),
        content_type=F.when(transcript.isNotNull(), "text").otherwise("audio"),
        source=F.concat(F.lit("podcast:"), F.col("podcast_title")),
        natural_key=F.col("guid"),
        metadata={key: F.col(renamed.get(key, key)) for key in V.EPISODE_KEYS},
        timestamp=F.coalesce("published_at", "created_at"),
        keep=("guid",),
    )


def message_items(messages: DataFrame, threads: DataFrame) -> DataFrame:
    parents = threads.select("thread_id", F.col("name").alias("thread_name"), "is_group")
    joined = messages.join(parents, "thread_id")
    renamed = {"original_id": "message_id"}
    return make_items(
        joined,
        content=F.col("text"),
        source=F.concat(F.lit("imessage:"), F.coalesce(non_empty(F.col("thread_name")), F.col("thread_id"))),
        natural_key=F.col("message_id"),
        metadata={key: F.col(renamed.get(key, key)) for key in V.MESSAGE_KEYS},
        timestamp=F.col("date"),
        keep=("message_id",),
    )
