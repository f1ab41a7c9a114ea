"""Feed entries to stored articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.dates import utc
from contentflow.functions.text import clean, needs_enrichment, origin_url, word_count
from contentflow.operators.filters import active, with_required, within_lookback
from contentflow.operators.known import enrich, unseen
from contentflow.operators.ranking import first_per_key, newest_per_feed


def select_entries(
    entries: DataFrame,
    feeds: DataFrame,
    seen: DataFrame,
    *,
    as_of: datetime | str,
    lookback_days: float = V.LOOKBACK_DAYS,
    max_articles: int | None = V.MAX_ARTICLES_PER_FEED,
) -> DataFrame:
    """The entries a run stores: of active feeds, recent, newest few per feed, new guids, first of each.

    Old and already stored entries count towards the newest few, because the cut comes first. Without a
    cut (None) the copies of a guid are ordered by date and place in the feed, as the ranks would be.
    """
    parents = active(feeds).select("feed", *[c for c in ("peer_through",) if c in feeds.columns])
    # All choices are made on places, dates and guids; texts are fetched for what is left.
    narrow = entries.select("feed", "pos", "guid", "published_at")
    recent = within_lookback(narrow, "published_at", as_of, lookback_days)
    newest = recent if max_articles is None else newest_per_feed(recent, max_articles)
    order = [F.col("feed"), F.col("published_at").desc_nulls_last(), F.col("pos")]
    first = first_per_key(with_required(newest.join(parents, "feed"), "guid"), ["guid"], order)
    chosen = unseen(first, seen, "guid").drop("guid", "published_at")
    return entries.join(chosen, ["feed", "pos"])


def to_articles(
    selected: DataFrame, *, as_of: datetime | str, external: DataFrame | None = None, enrich_content: bool = True
) -> DataFrame:
    """Selected entries with peered-through address, enriched and cleaned content, and word count."""
    if "peer_through" in selected.columns:
        origin = F.when(F.col("peer_through"), origin_url(F.col("description")))
        selected = selected.withColumn("url", F.coalesce(origin, F.col("url"))).drop("peer_through")
    if external is not None:
        needed = needs_enrichment(F.col("content"), F.col("url"), enrich_content)
        selected = enrich(selected, external, needed)
    else:
        selected = selected.withColumn("enriched", F.lit(False))
    cleaned = selected.withColumn("content", clean(F.col("content")))
    return cleaned.withColumns(
        {
            "word_count": word_count(F.col("content")),
            "description": F.col("summary"),
            "fetched_at": utc(as_of),
            "processed": F.lit(False),
            "embedding_generated": F.lit(False),
        }
    )


def ingest_articles(
    entries: DataFrame, feeds: DataFrame, seen: DataFrame, *, as_of: datetime | str,
    external: DataFrame | None = None, enrich_content: bool = True, **limits,
) -> DataFrame:
    selected = select_entries(entries, feeds, seen, as_of=as_of, **limits)
    return to_articles(selected, as_of=as_of, external=external, enrich_content=enrich_content)
