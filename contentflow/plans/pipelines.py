"""The whole ways from a source to notes. Each run has an id, and repeating a run changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from datetime import datetime
from functools import partial
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow import schema
from contentflow import values as V
from contentflow.functions.dates import utc
from contentflow.operators.filters import within_lookback
from contentflow.operators.health import (
    ingest_stats,
    update_counters,
    with_health,
)
from contentflow.operators.buckets import parents as parent_table
from contentflow.operators.key_store import remember, seen
from contentflow.operators.known import new_parents, open_rows
from contentflow.operators.metrics import store_measured
from contentflow.operators.models import (
    Completer, Model, catalogue, combine, complete_in_waves, fan_out, prompt_key, with_item_answers, with_prompts,
)
from contentflow.operators.note_files import NoteOptions, render_notes, write_notes
from contentflow.operators.stages import as_results, conform, deliver, pass_failed
from contentflow.operators.state import State
from contentflow.plans.articles import ingest_articles
from contentflow.plans.episodes import select_episodes, to_episodes, with_transcripts
from contentflow.plans.transcription import transcribe_items
from contentflow.sources import feeds as feed_source
from contentflow.sources.items import article_items, episode_items

MakeCompleter = Callable[[], Completer]
# Retries, pauses and concurrency of model calls, as `complete` takes them.
_DEFAULT_CALLS: Mapping[str, Any] = {}

_ANSWERS = "call_key string, response string, call_error string, calls int, elapsed_ms double"
_ATTEMPTS = "feed string, ts timestamp_ntz, attempt_id string, outcome string, error string"


def apply_models(state: State, items: DataFrame, models: Sequence[Model], make_completer: MakeCompleter,
                 step: str = "answers", **options) -> DataFrame:
    """Results per (item, model). Answers are stored in waves; good ones that are stored are used again."""
    keyed = items.withColumn("prompt_key", prompt_key())
    requests = with_prompts(fan_out(keyed, models), models)
    return with_item_answers(keyed, models, requests, complete_in_waves(state, step, requests, make_completer, **options))


def one_model(state: State, model: Model, make_completer: MakeCompleter, step: str = "answers", **options):
    """A processor that applies a single model."""

    def processor(items: DataFrame) -> DataFrame:
        return conform(apply_models(state, items, [model], make_completer, step, **options), schema.RESULT)

    return processor


def compare_models(state: State, items: DataFrame, models: Sequence[Model], make_completer: MakeCompleter, **options):
    """Results with the answers of all models combined in one text."""
    answered = apply_models(state, items, models, make_completer, **options)
    rows = answered.withColumns(
        {
            "model_name": F.try_element_at("metadata", F.lit("model")),
            "execution_time_ms": F.col("result_metrics.execution_time_ms"),
        }
    )
    combined = combine(rows).withColumnRenamed("content", "combined")
    joined = items.join(combined, "id").withColumn("content", F.col("combined"))
    return conform(joined.withColumn("error_message", F.lit(None).cast("string")), schema.RESULT)


def to_notes(
    state: State, results: DataFrame, vault: str, options: NoteOptions, as_of: datetime | str, failed: str = "deliver"
) -> DataFrame:
    """(id, ok, error) per result."""

    def output(good: DataFrame) -> DataFrame:
        notes = render_notes(good, options, as_of)
        return write_notes(state.spark, notes, vault, options, run_id=state.run_id, as_of=as_of)

    return deliver(results, output, failed=failed)


def text_to_notes(
    state: State, items: DataFrame, make_completer: MakeCompleter, vault: str, *, as_of: datetime | str,
    model: Model | None = None, notes: NoteOptions = NoteOptions(), calls: Mapping[str, Any] = _DEFAULT_CALLS,
) -> DataFrame:
    """Texts through one model into notes."""
    results = one_model(state, model or catalogue("gpt4o")[0], make_completer, **calls)(items)
    results = store_measured(state, "results", "results", results, schema.RESULT)
    return to_notes(state, results, vault, replace(notes, key_order=notes.key_order or V.TEXT_KEYS), as_of)


def poll_feeds(
    state: State, entries: DataFrame, heads: DataFrame, *, as_of: datetime | str, external: DataFrame | None = None,
    problems: DataFrame | None = None, emit: str = "backlog", **limits,
) -> DataFrame:
    """One poll of the feeds: stores new articles and feed health, returns the items to work on.

    `heads` lists the configured feeds that were landed; `problems` (feed, error) those whose processing
    failed. `emit` is `backlog` (all unprocessed articles of feeds with news) or `new`. Entries and heads are stored
    first, so that their XML is parsed once.
    """
    entries, heads = state.keep("entries", entries), state.keep("heads", heads)
    stored = parent_table(state, "feeds")
    # Only the feeds of this poll are read and rewritten.
    known = stored.matching(heads.select(F.col("feed").alias("url")).union(entries.select("feed")))
    candidates = heads.select(F.col("feed").alias("url"), "title", "description", "website_url")
    found = new_parents(candidates, known, "url", [F.col("title")])
    fresh = found.withColumns(
        {
            "last_updated": utc(as_of), "last_checked": utc(as_of), "muted": F.lit(False),
            "peer_through": F.lit(False), "error_count": F.lit(0), "no_entries_count": F.lit(0),
            "article_count": F.lit(0),
        }
    )
    feeds = known.unionByName(fresh, allowMissingColumns=True)
    parents = feeds.withColumn("feed", F.col("url"))

    earlier = state.earlier("articles")
    selected = ingest_articles(
        entries, parents, seen(state, "articles", entries, earlier, "guid"), as_of=as_of, external=external, **limits
    )
    articles = store_measured(state, "articles", "articles", selected)
    remember(state, "articles", articles, earlier, "guid")

    open_feeds = parents.filter(~F.coalesce("muted", F.lit(False))).select("feed")
    checked = heads.select("feed").join(open_feeds, "feed", "left_semi")
    recent = _feeds_with_recent(entries, as_of, limits.get("lookback_days", V.LOOKBACK_DAYS))
    failed = problems if problems is not None else state.spark.createDataFrame([], "feed string, error string")
    log = (
        checked.join(recent, "feed", "left")
        .join(failed.groupBy("feed").agg(F.max("error").alias("error")), "feed", "left")
        .select(
            "feed", utc(as_of).alias("ts"), F.lit(state.run_id).alias("attempt_id"),
            F.when(F.col("error").isNotNull(), "error")
            .when(F.col("has_recent"), "ok")
            .otherwise("empty")
            .alias("outcome"),
            "error",
        )
    )
    attempts = state.append("attempts", log, _ATTEMPTS)
    stats = ingest_stats(articles, "enriched")
    counted = update_counters(feeds, stats, checked, as_of)
    feeds = stored.upsert(state.keep("feeds_now", with_health(counted, attempts, lambda runs: state.keep("health_runs", runs))))

    if emit == "new":
        emitted = articles
    elif emit == "backlog":
        emitted = open_rows(state, "articles", articles, "feed")
    else:
        raise ValueError(f"unknown emission {emit!r}")
    return article_items(emitted, feeds)


def poll_bodies(state: State, bodies: DataFrame, *, as_of: datetime | str, **options) -> DataFrame:
    """One poll of landed feed bodies (feed, page, body), see `poll_feeds`.

    Bodies that are no well-formed XML give what can be read of them; feeds whose bodies are no feeds at all are failed polls.
    """
    # Stored, because entries, heads and problems are all taken from it.
    read = state.keep("bodies", feed_source.opened(bodies))
    entries, heads = feed_source.feed_entries(feed_source.raw_entries(read)), feed_source.feed_heads(read)
    return poll_feeds(state, entries, heads, as_of=as_of, problems=feed_source.feed_problems(read), **options)


def _feeds_with_recent(entries: DataFrame, as_of: datetime | str, lookback_days: float) -> DataFrame:
    recent = within_lookback(entries, "published_at", as_of, lookback_days)
    return recent.select("feed").distinct().withColumn("has_recent", F.lit(True))


def feeds_to_notes(
    state: State, entries: DataFrame, heads: DataFrame, make_completer: MakeCompleter, vault: str, *,
    as_of: datetime | str, models: Sequence[Model] | None = None, notes: NoteOptions = NoteOptions(),
    calls: Mapping[str, Any] = _DEFAULT_CALLS, **options,
) -> DataFrame:
    """Feeds through several models into notes. Articles that a model answered leave the backlog once written."""
    items = poll_feeds(state, entries, heads, as_of=as_of, **options)
    kept = state.append("items", items, f"{schema.ITEM}, guid string")
    compared = models or catalogue("gpt4o", "claude", "o3mini")
    results = compare_models(state, kept.drop("guid"), compared, make_completer, **calls)
    # Stored, because the note plan and the backlog read them several times.
    results = store_measured(state, "results", "results", results, schema.RESULT)
    done = to_notes(state, results, vault, replace(notes, key_order=notes.key_order or V.ARTICLE_KEYS), as_of)
    finished = done.filter("ok").join(results.filter("success").select("id"), "id", "left_semi")
    state.mark_processed("articles", finished.join(kept.select("id", "guid"), "id"), "guid")
    return done


_EPISODE_STATS = "feed_url string, new_items bigint, transcribed_items bigint"


def episode_stats(episodes: DataFrame) -> DataFrame:
    """Per podcast: new episodes, and how many of them have a transcript."""
    flagged = episodes.withColumn("transcribed", F.coalesce(F.col("transcript") != "", F.lit(False)))
    return ingest_stats(flagged, "transcribed", parent="feed_url", flag_as="transcribed_items")


def poll_podcasts(
    state: State, entries: DataFrame, heads: DataFrame, transcripts: DataFrame, *, as_of: datetime | str,
    speech: DataFrame | None = None, transcript_required: bool = False, lookback_days: float = V.LOOKBACK_DAYS,
) -> DataFrame:
    """One poll of the podcasts: stores new episodes, returns the items to work on."""
    entries, heads = state.keep("podcast_entries", entries), state.keep("podcast_heads", heads)
    stored = parent_table(state, "podcasts")
    candidates = heads.select(F.col("feed").alias("feed_url"), "title", "author")
    known = stored.matching(candidates.select("feed_url").union(entries.select("feed")))
    fresh = new_parents(candidates, known, "feed_url", [F.col("title")]).withColumns(
        {"muted": F.lit(False), "created_at": utc(as_of), "updated_at": utc(as_of)}
    )
    fresh = state.keep("podcasts_new", conform(fresh, schema.STATE["podcasts"]))
    podcasts = known.unionByName(fresh)
    stored.upsert(fresh)
    earlier = state.earlier("episodes")
    selected = select_episodes(
        entries, podcasts.withColumn("feed", F.col("feed_url")), seen(state, "episodes", entries, earlier, "guid"),
        as_of=as_of, lookback_days=lookback_days,
    )
    texts = with_transcripts(selected, transcripts, speech, required=transcript_required)
    episodes = store_measured(state, "episodes", "episodes", to_episodes(texts, as_of=as_of))
    state.append("podcast_stats", episode_stats(episodes), _EPISODE_STATS)
    remember(state, "episodes", episodes, earlier, "guid")
    emitted = open_rows(state, "episodes", episodes, "feed_url")
    return episode_items(emitted, podcasts)


def podcasts_to_notes(
    state: State, entries: DataFrame, heads: DataFrame, transcripts: DataFrame, speech: DataFrame,
    make_completer: MakeCompleter, vault: str, *, as_of: datetime | str, model: Model | None = None,
    correct: bool = True, notes: NoteOptions = NoteOptions(), calls: Mapping[str, Any] = _DEFAULT_CALLS, **options,
) -> DataFrame:
    """Podcasts through transcription and one model into notes; transcribed episodes skip transcription."""
    items = poll_podcasts(state, entries, heads, transcripts, as_of=as_of, **options)
    kept = state.append("episode_items", items, f"{schema.ITEM}, guid string")
    audio = kept.filter(F.col("content_type") == "audio").drop("guid")
    spoken = transcribe_items(audio, speech, lambda step, answers: state.append(step, answers, _ANSWERS),
                              make_completer if correct else None, ask=partial(complete_in_waves, state), **calls)
    ready = as_results(kept.filter(F.col("content_type") != "audio"))
    # Stored, because the good and the failed half are both read from it.
    transcribed = store_measured(state, "transcripts", "transcripts", conform(spoken, schema.RESULT).unionByName(ready), schema.RESULT)
    summary = one_model(state, model or catalogue("claude")[0], make_completer, "summaries", **calls)
    results = store_measured(state, "results", "results", pass_failed(transcribed, summary), schema.RESULT)
    options_ = replace(notes, key_order=notes.key_order or V.EPISODE_KEYS)
    done = to_notes(state, results, vault, options_, as_of, failed="skip")
    state.mark_processed("episodes", done.filter("ok").join(kept.select("id", "guid"), "id"), "guid")
    return done
