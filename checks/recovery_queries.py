"""Feed bodies that are not well-formed, and dates in free forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.folders import work_folder
from checks.ingest_queries import landed_bodies
from checks.registry import query
from checks.views import AS_OF, table, wide
from contentflow.functions import dates as D
from contentflow.operators.state import State
from contentflow.plans import pipelines
from contentflow.sources import feeds as feed_source

# What is wrong with a body, by the remainder of its document's id.
_DAMAGE = """CASE doc_id % 9 WHEN 0 THEN 'reference' WHEN 1 THEN 'tail' WHEN 2 THEN 'end' WHEN 3 THEN 'tags' WHEN 4 THEN 'signs'
    WHEN 5 THEN 'page' WHEN 6 THEN 'junk' WHEN 7 THEN 'control' ELSE 'none' END"""


def broken_bodies(spark, sf):
    """The landed bodies of all documents, eight in nine of them damaged; one in nine is a web page instead."""
    docs = table(spark, sf, "documents").selectExpr("doc_id AS page", f"{_DAMAGE} AS damage")
    bodies = landed_bodies(spark, sf).join(docs, "page")
    body, damage = F.col("body"), F.col("damage")

    def swap(old: str, new: str) -> F.Column:
        return F.regexp_replace(body, old, new)

    broken = (
        F.when(damage == "reference", swap("<title>Title ", "<title>Title&nbsp;AT&T R&D &amp; "))
        # Cut off behind the last item, and within its last element.
        .when(damage == "tail", swap("</(item|entry)>.*", "</$1>"))
        .when(damage == "end", swap("</(description|content)></(item|entry)>.*", "</"))
        # Markup that is not escaped and not closed.
        .when(damage == "tags", swap("<(description|content[^>]*)>", "<$1><p class=x>lost<br>"))
        .when(damage == "signs", F.concat(F.lit("<!-- a & b -->"), swap("<title>Title ", "<title>1 < 2 & <![CDATA[3 > <b>2</b> &amp;]]> ")))
        .when(damage == "page", F.concat(F.lit("<!DOCTYPE html><html><head><title>Gone</title><body><p>No feed here<br>"), F.col("page")))
        .when(damage == "junk", F.concat(F.lit("\n﻿"), swap("<(channel|entry)>", '<$1><odd a=1 "b>'), F.lit("<p>& trailing")))
        .when(damage == "control", swap("<title>Title ", "<title>Title \u0002\u001f"))
        .otherwise(body)
    )
    return bodies.select("feed", "page", broken.alias("body"))


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
_READABLE = r"regexp_replace(content, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query("broken_feed_entries", f"""WITH d AS (SELECT doc_id AS pos, {_DAMAGE} AS damage FROM documents),
    e AS (SELECT entries.*, damage, trim({_READABLE}, {_SPACE}) AS told FROM entries JOIN d USING (pos))
    SELECT feed, pos, guid, url, published_at, CASE damage WHEN 'reference' THEN 'Title' || chr(160) || 'AT&T R&D & ' || CAST(pos AS VARCHAR)
        WHEN 'signs' THEN '1 < 2 & 3 > <b>2</b> &amp; ' || CAST(pos AS VARCHAR) ELSE title END AS title,
    CASE WHEN damage = 'tags' THEN '<p class=x>lost<br>' || replace(replace(replace(rtrim({_READABLE}, {_SPACE}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
        ELSE told END AS content
    FROM e WHERE damage <> 'page'""")
def broken_feed_entries(spark, sf):
    """Every entry of a damaged body, but for the web pages. Text with tags among it is markup and stays as it is written."""
    parsed = feed_source.feed_entries(feed_source.raw_entries(broken_bodies(spark, sf)))
    return parsed.select("feed", F.shiftright("pos", 32).alias("pos"), "guid", "url", "title", "published_at", "content")


@query("broken_feed_heads", """SELECT source AS feed, min(CASE WHEN doc_id % 9 = 5 THEN source ELSE 'Feed ' || source END) AS title FROM documents GROUP BY source""")
def broken_feed_heads(spark, sf):
    return feed_source.feed_heads(broken_bodies(spark, sf)).select("feed", "title")


def _alone(spark, sf):
    """Each body as a feed of its own."""
    return broken_bodies(spark, sf).select(F.concat("feed", F.lit("/"), "page").alias("feed"), F.lit(0).cast("long").alias("page"), "body")


@query("feed_problems", "SELECT source || '/' || CAST(doc_id AS VARCHAR) AS feed, 'no feed in the body' AS error FROM documents WHERE doc_id % 9 = 5")
def feed_problems(spark, sf):
    return feed_source.feed_problems(_alone(spark, sf))


@query("poll_broken_feeds", """SELECT feed || '/' || CAST(pos AS VARCHAR) AS url, CASE WHEN pos % 9 = 5 THEN feed || '/' || CAST(pos AS VARCHAR) ELSE 'Feed ' || feed END AS title,
    CAST(CASE WHEN pos % 9 = 5 THEN 2 ELSE 0 END AS BIGINT) AS error_count,
    CAST(CASE WHEN pos % 9 = 5 OR published_at IS NULL OR published_at >= TIMESTAMP '2024-01-24 00:00:00' THEN 0 ELSE 2 END AS BIGINT) AS no_entries_count,
    CASE WHEN pos % 9 = 5 THEN 'no feed in the body' END AS last_error FROM entries""")
def poll_broken_feeds(spark, sf):
    """Two polls of damaged bodies: web pages count as errors, feeds without recent entries as empty."""
    root = work_folder(spark, "broken")
    bodies = _alone(spark, sf)
    for run_id in ("run-1", "run-2"):
        pipelines.poll_bodies(State(spark, root, run_id), bodies, as_of=AS_OF)
    feeds = State(spark, root, "reader").snapshot("feeds")
    return feeds.select("url", "title", "error_count", "no_entries_count", "last_error")


# Pattern of Spark for the written date, and what the time is cut to.
_FREE = (
    ("MMM d yyyy h:mm a", "minute"), ("MMMM d, yyyy hh:mm:ss a", "second"), ("yyyy/MM/dd", "day"), ("dd MMM yy", "day"), ("MM/dd/yyyy HH:mm", "minute"),
    ("EEEE, d. MMMM yyyy 'at' HH:mm", "minute"), ("yyyyMMdd", "day"), ("yyyyMMdd HH:mm:ss", "second"), ("HH:mm yyyy-MM-dd", "minute"), ("EEE MMM dd HH:mm:ss 'EST' yyyy", "second"),
    ("d-MMM-yyyy h a", "hour"), ("yyyy MMM d", "day"),
)


@query("free_dates", "SELECT event_id, CASE event_id % 12 " + " ".join(
    f"WHEN {n} THEN date_trunc('{unit}', ts){' + INTERVAL 5 HOUR' if 'EST' in form else ''}" for n, (form, unit) in enumerate(_FREE)
) + " END AS published_at FROM events")
def free_dates(spark, sf):
    """The time of every event, written in twelve forms that no standard names."""
    written = F.lit(None).cast("string")
    for number, (form, _) in enumerate(_FREE):
        written = F.when(F.col("event_id") % len(_FREE) == number, F.date_format("ts", form)).otherwise(written)
    events = wide(spark, sf, "events").select("event_id", written.alias("d"))
    return events.select("event_id", D.parse_date(F.col("d")).cast("timestamp_ntz").alias("published_at"))
