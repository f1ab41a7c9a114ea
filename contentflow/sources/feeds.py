"""Feed and podcast sources: landed RSS and Atom bodies to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentflow import schema
from contentflow.functions.dates import first_date
from contentflow.functions.text import entry_guid, entry_url, non_empty, pick_content
from contentflow.sources import recovery

_LINK = "array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>"
# RSS names a person in the element itself, Atom in an element below it.
_PERSON = "struct<_VALUE:string,name:string>"
_ENTRY = f"""array<struct<
    guid:struct<_VALUE:string,_isPermaLink:string>, id:string, title:string, author:{_PERSON}, `dc:creator`:string,
    pubDate:string, published:string, updated:string, created:string, `dc:date`:string, summary:string,
    description:string, `content:encoded`:string, content:array<struct<_VALUE:string,_type:string,div:string>>,
    value:string, link:{_LINK},
    enclosure:array<struct<_VALUE:string,_url:string,_type:string>>>>"""
_HEAD = f"title:string, description:string, subtitle:string, author:{_PERSON}, link:{_LINK}"
# RSS keeps everything under <channel>, RDF the items beside it, Atom under the root.
_BODY = f"""channel struct<{_HEAD}, item:{_ENTRY}>, item {_ENTRY}, entry {_ENTRY},
    title string, subtitle string, author {_PERSON}, link {_LINK}, _broken string"""
# The strict parser's options: a body that it does not take stands in `_broken`.
_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
_ENTRY_STRUCT = _ENTRY.strip().removeprefix("array<").removesuffix(">")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(feed, page, body) of files landed under `feed=<url>` folders, one fetched body per file.

    `page` numbers a feed's files in the order in which they came, then by path, so that entries of several polls keep
    different places.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("feed").cast("string").alias("feed"), F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("came"),
    )
    order = Window.partitionBy("feed").orderBy("came", "file")
    pages = files.select("file", (F.row_number().over(order) - 1).alias("page"))
    return files.join(pages, "file").select("feed", "page", "body")


def _main_link(links: Column) -> Column:
    """Text of the first link element, or the address of the first that points to the entry itself."""
    own = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    first = F.get(own, F.lit(0))
    return F.coalesce(non_empty(first["_VALUE"]), first["_href"])


def _person(author: Column) -> Column:
    return F.coalesce(non_empty(author["name"]), author["_VALUE"])


def _links(entry: Column) -> Column:
    listed = F.transform(
        F.filter(entry["link"], lambda x: x["_href"].isNotNull()),
        lambda x: F.struct(x["_type"].alias("type"), x["_href"].alias("href"), x["_rel"].alias("rel")),
    )
    enclosed = F.transform(
        entry["enclosure"],
        lambda x: F.struct(x["_type"].alias("type"), x["_url"].alias("href"), F.lit("enclosure").alias("rel")),
    )
    empty = F.array().cast(schema.LINKS)
    return F.concat(F.coalesce(listed.cast(schema.LINKS), empty), F.coalesce(enclosed.cast(schema.LINKS), empty))


def opened(bodies: DataFrame) -> DataFrame:
    """(feed, page, error, found, head) per body of (feed, page, body): its entries, its head, and why it is no feed at all.

    Reading a body is most of a poll's work, above all of one that is no well-formed XML. A poll stores this frame and takes entries, heads
    and problems from it, so that each body is read once.
    """
    doc, clean, item, head = F.col("doc"), F.col("clean"), F.lit(None).cast("string"), F.col("recovered")
    parsed = bodies.select("feed", "page", "body", F.from_xml("body", _BODY, _OPTIONS).alias("doc"))
    parsed = parsed.withColumn("broken", F.col("doc._broken").isNotNull()).withColumn("error", recovery.complaint(F.col("body")))
    # What the parser made of a broken body before it gave up is not used.
    parsed = parsed.withColumn("doc", F.when(~F.col("broken"), doc))
    # Both the entries and the head of a broken body are found in its normalised text.
    parsed = parsed.withColumn("clean", F.when(F.col("broken"), recovery.normalised(F.col("body")))).drop("body")
    readable = F.col("broken") & F.col("error").isNull()
    parsed = parsed.withColumn("recovered", F.when(readable, F.from_xml(recovery.head_xml(clean), f"struct<{_HEAD}>", _OPTIONS)))
    strict = F.concat(
        *[F.coalesce(e, F.array().cast(_ENTRY)) for e in (doc["channel"]["item"], doc["item"], doc["entry"])]
    )
    whole = F.transform(strict, lambda e: F.struct(e.alias("entry"), item.alias("item")))
    cut = F.transform(recovery.items(clean), lambda text: F.struct(F.lit(None).cast(_ENTRY_STRUCT).alias("entry"), text.alias("item")))
    return parsed.select(
        "feed",
        "page",
        "error",
        F.when(F.col("broken"), cut).otherwise(whole).alias("found"),
        F.struct(
            F.coalesce(doc["channel"]["title"], doc["title"], head["title"], F.col("feed")).alias("title"),
            F.coalesce(doc["channel"]["description"], doc["subtitle"], head["description"], head["subtitle"], F.lit("")).alias("description"),
            F.coalesce(*(_person(h["author"]) for h in (doc["channel"], doc, head)), F.lit("")).alias("author"),
            F.coalesce(*(_main_link(h["link"]) for h in (doc["channel"], doc, head)), F.lit("")).alias("website_url"),
        ).alias("head"),
    )


def _opened(bodies: DataFrame) -> DataFrame:
    """Landed bodies, or what `opened` made of them."""
    return opened(bodies) if "body" in bodies.columns else bodies


def raw_entries(bodies: DataFrame) -> DataFrame:
    """One row per entry of (feed, page, body) or of `opened` bodies: raw texts, links, and its place in the feed.

    `page` orders several bodies of one feed. Entries of a body that is no well-formed XML are recovered one by one, see
    `recovery`; a body that is no feed has none, and stands in `feed_problems`.
    """
    # The outer form with a filter behind it: for the inner one the optimizer tests `found` first, and so reads each body twice.
    exploded = _opened(bodies).select("feed", "page", F.posexplode_outer("found").alias("at", "one"))
    exploded = exploded.filter("at is not null").select("feed", "page", "at", "one.*")
    recovered = F.from_xml(recovery.entry_xml(F.col("item")), _ENTRY_STRUCT, _OPTIONS)
    exploded = exploded.withColumn("entry", F.when(F.col("item").isNotNull(), recovered).otherwise(F.col("entry")))
    e = F.col("entry")
    contents = F.concat(
        F.filter(F.array(e["content:encoded"]), lambda v: v.isNotNull()),
        # The content of an XHTML element is the markup in its div.
        F.coalesce(
            F.transform(e["content"], lambda x: F.coalesce(x["div"], x["_VALUE"])), F.array().cast("array<string>")
        ),
    )
    enclosures = F.transform(e["enclosure"], lambda x: F.struct(x["_type"].alias("type"), x["_url"].alias("href")))
    return exploded.select(
        "feed",
        (F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("at")).alias("pos"),
        # An empty guid element is a blank id, not a missing one.
        F.when(e["guid"].isNotNull(), F.coalesce(e["guid"]["_VALUE"], F.lit(""))).otherwise(e["id"]).alias("entry_id"),
        _main_link(e["link"]).alias("link"),
        e["title"].alias("title"),
        F.coalesce(_person(e["author"]), e["dc:creator"]).alias("author"),
        F.coalesce(e["pubDate"], e["published"]).alias("published"),
        F.coalesce(e["updated"], e["dc:date"]).alias("updated"),
        e["created"].alias("created"),
        F.coalesce(e["summary"], e["description"]).alias("summary"),
        F.coalesce(e["description"], e["summary"]).alias("description"),
        contents.alias("contents"),
        e["value"].alias("value"),
        _links(e).alias("links"),
        F.coalesce(enclosures.cast(schema.ENCLOSURES), F.array().cast(schema.ENCLOSURES)).alias("enclosures"),
    )


def feed_entries(entries: DataFrame) -> DataFrame:
    """Entries with resolved guid, address, date, title and content."""
    guid = entry_guid(F.col("entry_id"), F.col("link"))
    return entries.select(
        "feed",
        "pos",
        guid.alias("guid"),
        entry_url(F.col("link"), guid).alias("url"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.col("description"),
        first_date(F.col("published"), F.col("updated"), F.col("created")).alias("published_at"),
        pick_content(F.col("contents"), F.col("summary"), F.col("description"), F.col("value")).alias("content"),
    )


def podcast_entries(entries: DataFrame) -> DataFrame:
    """Podcast entries: only `published` dates them, and the title stays as it is."""
    return entries.select(
        "feed",
        "pos",
        entry_guid(F.col("entry_id"), F.col("link")).alias("guid"),
        "title",
        F.coalesce("description", F.lit("")).alias("description"),
        first_date(F.col("published")).alias("published_at"),
        "links",
        "enclosures",
    )


def feed_heads(bodies: DataFrame) -> DataFrame:
    """Title, description, author and site of each feed, with the defaults for missing ones."""
    # Several bodies of one feed carry the same head: keep one of them, always the same.
    heads = _opened(bodies).groupBy("feed").agg(F.min("head").alias("head"))
    return heads.select("feed", "head.*")


def feed_problems(bodies: DataFrame) -> DataFrame:
    """(feed, error) of the feeds none of whose bodies is a feed: these polls failed, they did not find the feed empty."""
    told = _opened(bodies).groupBy("feed").agg(F.max("error").alias("error"), F.bool_or(F.col("error").isNull()).alias("readable"))
    return told.filter(~F.col("readable")).select("feed", "error")
