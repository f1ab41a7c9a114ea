"""Podcast entries to stored episodes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.dates import utc
from contentflow.functions.text import non_empty
from contentflow.functions.transcripts import media_links, transcript_text
from contentflow.operators.filters import active, with_required, within_lookback
from contentflow.operators.known import unseen
from contentflow.operators.ranking import first_per_key


def select_episodes(
    entries: DataFrame,
    podcasts: DataFrame,
    seen: DataFrame,
    *,
    as_of: datetime | str,
    lookback_days: float = V.LOOKBACK_DAYS,
) -> DataFrame:
    """Recent entries of active podcasts with guid, title and audio, first of each new guid.

    Newest first decides between copies; there is no cap per podcast.
    """
    recent = within_lookback(entries, "published_at", as_of, lookback_days)
    recent = recent.join(active(podcasts).select("feed"), "feed")
    linked = recent.withColumn("media", media_links(F.col("links"), F.col("enclosures")))
    complete = with_required(linked.select("*", "media.*").drop("media", "links", "enclosures"), "guid", "title", "audio_url")
    order = [F.col("feed"), F.col("published_at").desc_nulls_last(), F.col("pos")]
    return unseen(first_per_key(complete, ["guid"], order), seen, "guid")


def with_transcripts(
    episodes: DataFrame, landed: DataFrame, speech: DataFrame | None = None, *, required: bool = False
) -> DataFrame:
    """Text of the landed transcript file, else the recognised speech.

    `landed` is (url, content_type, body), `speech` is (guid, text). With `required`, episodes that have
    neither are left out, so that a later run meets them again.
    """
    # Only the files that some episode names are brought together.
    wanted = episodes.select(F.col("transcript_url").alias("url")).filter("url is not null").distinct()
    files = landed.join(wanted, "url", "left_semi").groupBy("url").agg(F.min(F.struct("content_type", "body")).alias("file"))
    files = files.select(F.col("url").alias("lookup"), F.col("file.content_type").alias("kind"), "file.body")
    # Episodes without a transcript address get a key of their own, which matches nothing.
    keyed = episodes.withColumn("lookup", F.coalesce("transcript_url", F.concat(F.lit("\0"), F.col("guid"))))
    joined = keyed.join(files, "lookup", "left")
    external = transcript_text(F.col("body"), F.col("kind"), F.col("transcript_url"))
    joined = joined.withColumn("external", external).drop("lookup", "kind", "body")
    if speech is not None:
        joined = joined.join(speech.select("guid", F.col("text").alias("spoken")), "guid", "left")
    else:
        joined = joined.withColumn("spoken", F.lit(None).cast("string"))
    done = joined.withColumns(
        {
            "transcript": F.coalesce("external", "spoken"),
            "transcript_source": F.when(F.col("external").isNotNull(), "external").when(
                F.col("spoken").isNotNull(), "whisper"
            ),
            "transcript_url": F.when(F.col("external").isNotNull(), F.col("transcript_url")),
        }
    ).drop("external", "spoken")
    return done.filter(non_empty(F.col("transcript")).isNotNull()) if required else done


def to_episodes(selected: DataFrame, *, as_of: datetime | str) -> DataFrame:
    return selected.withColumnRenamed("feed", "feed_url").withColumns(
        {"created_at": utc(as_of), "processed": F.lit(False)}
    )
