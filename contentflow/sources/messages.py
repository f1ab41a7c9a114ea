"""Message history source: four landed tables to message records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.dates import from_apple_nanos, to_apple_nanos
from contentflow.functions.messages import is_group, sender, thread_id, thread_name
from contentflow.functions.text import strip


def recent(messages: DataFrame, as_of: datetime | str, lookback_hours: float = V.LOOKBACK_HOURS) -> DataFrame:
    """Messages with text since the cutoff. The filter stays on the raw column, so it reaches the scan."""
    start = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)
    cutoff = to_apple_nanos(start - timedelta(hours=lookback_hours))
    return messages.filter((F.col("date") > F.lit(cutoff)) & F.col("text").isNotNull())


def message_filter(trigger_word: str | None = None, include_from_me: bool = True) -> Column:
    """Conditions on the message itself. `%` and `_` in the trigger word are wildcards."""
    keep = F.lit(True)
    if trigger_word:
        keep = keep & F.col("text").ilike(f"%{trigger_word}%")
    if not include_from_me:
        keep = keep & ~F.col("is_from_me")
    return keep


def chat_filter(
    include_group_chats: bool = True,
    include_unknown_senders: bool = True,
    contacts_to_include: Sequence[str] = (),
    contacts_to_exclude: Sequence[str] = (),
) -> Column | None:
    """Conditions on chat and sender, with SQL's NULL logic; None when nothing is asked for."""
    parts = []
    if not include_group_chats:
        parts.append(F.col("style") != V.GROUP_CHAT_STYLE)
    if not include_unknown_senders:
        parts.append(F.col("handle").isNotNull())
    if contacts_to_include:
        parts.append(F.col("handle").isin(*contacts_to_include))
    if contacts_to_exclude:
        parts.append(~F.col("handle").isin(*contacts_to_exclude))
    if not parts:
        return None
    keep = parts[0]
    for part in parts[1:]:
        keep = keep & part
    return keep


def with_chats(messages: DataFrame, handles: DataFrame, chat_links: DataFrame, chats: DataFrame) -> DataFrame:
    """Each message with its sender and chats: a message of several chats gives several rows."""
    handles = handles.select(F.col("rowid").cast("string").alias("by_handle"), F.col("id").alias("handle"))
    links = chat_links.select("message_id", "chat_id")
    chats = chats.select(F.col("rowid").cast("string").alias("by_chat"), F.col("display_name").alias("chat_name"), "style")
    messages = messages.withColumnRenamed("rowid", "message_id")
    sent = messages.withColumn("by_handle", _own_key("handle_id", "message_id")).join(handles, "by_handle", "left")
    linked = sent.join(links, "message_id", "left").withColumn("by_chat", _own_key("chat_id", "message_id"))
    return linked.join(chats, "by_chat", "left").drop("by_handle", "by_chat")


def _own_key(key: str, row: str) -> Column:
    """The key as text; a row without one gets a key of its own that matches nothing, so such rows spread over the tasks."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.col(row).cast("string")))


def newest_first() -> list[Column]:
    """The order of the scan; total, since a message is in a chat once."""
    return [F.col("date").desc(), F.col("message_id"), F.col("chat_id").asc_nulls_last()]


def newest(messages: DataFrame, limit: int = V.MAX_MESSAGES) -> DataFrame:
    return messages.orderBy(*newest_first()).limit(limit)


def scan_messages(
    messages: DataFrame,
    handles: DataFrame,
    chat_links: DataFrame,
    chats: DataFrame,
    *,
    as_of: datetime | str,
    lookback_hours: float = V.LOOKBACK_HOURS,
    trigger_word: str | None = None,
    include_from_me: bool = True,
    include_group_chats: bool = True,
    include_unknown_senders: bool = True,
    contacts_to_include: Sequence[str] = (),
    contacts_to_exclude: Sequence[str] = (),
    max_messages: int | None = V.MAX_MESSAGES,
) -> DataFrame:
    """Newest messages with sender and chat. Copies of a message in several chats count each.

    Every message gives at least one joined row, so without conditions on chat or sender the newest
    N joined rows come from the newest N messages: the cut happens before the joins.
    """
    wanted = recent(messages, as_of, lookback_hours).filter(message_filter(trigger_word, include_from_me))
    on_chat = chat_filter(include_group_chats, include_unknown_senders, contacts_to_include, contacts_to_exclude)
    if on_chat is None and max_messages is not None:
        wanted = wanted.orderBy(F.col("date").desc(), F.col("rowid")).limit(max_messages)
        ids = wanted.select(F.col("rowid").alias("message_id"))
        chat_links = chat_links.join(ids, "message_id", "left_semi")
    joined = with_chats(wanted, handles, chat_links, chats)
    if on_chat is not None:
        joined = joined.filter(on_chat)
    return joined if max_messages is None else newest(joined, max_messages)


def contact_names(people: DataFrame, person_handles: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(handle, contact_name) of the first person of each handle; handles without a name are left out.

    `wanted` (handle) limits the address book before it is joined and aggregated.
    """
    if wanted is not None:
        handles = wanted.select("handle").filter(F.col("handle").isNotNull()).distinct()
        person_handles = person_handles.join(handles, "handle", "left_semi")
    named = person_handles.select("person_id", "handle").join(
        people.select(F.col("rowid").alias("person_id"), "first", "last"), "person_id"
    )
    first = F.min_by(F.struct("first", "last"), F.col("person_id"))
    person = named.groupBy("handle").agg(first.alias("person"))
    full = strip(F.concat(F.coalesce("person.first", F.lit("")), F.lit(" "), F.coalesce("person.last", F.lit(""))))
    return person.select("handle", full.alias("contact_name")).filter(F.col("contact_name") != "")


def message_records(scanned: DataFrame, contacts: DataFrame) -> DataFrame:
    """Scanned rows as message records with thread and sender."""
    named = contacts.withColumnRenamed("handle", "by_handle")
    joined = scanned.withColumn("by_handle", _own_key("handle", "message_id")).join(named, "by_handle", "left")
    handle = F.col("handle")
    return joined.select(
        F.col("message_id").cast("string").alias("message_id"),
        "text",
        F.col("is_from_me").alias("from_me"),
        sender(F.col("is_from_me"), handle).alias("sender"),
        thread_id(F.col("chat_id"), handle).alias("thread_id"),
        thread_name(F.col("chat_name"), F.col("contact_name"), handle).alias("thread_name"),
        is_group(F.col("style")).alias("is_group"),
        from_apple_nanos(F.col("date")).alias("date"),
        F.col("chat_id"),
    )
