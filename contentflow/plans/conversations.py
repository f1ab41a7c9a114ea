"""Message history to stored messages, threads and items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.operators.buckets import parents
from contentflow.operators.key_store import remember, seen
from contentflow.operators.known import new_parents, unseen
from contentflow import schema
from contentflow.operators.metrics import store_measured
from contentflow.operators.ranking import first_per_key
from contentflow.operators.stages import conform
from contentflow.operators.state import State
from contentflow.sources.items import message_items
from contentflow.sources.messages import contact_names, message_records, newest_first, scan_messages

def new_messages(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records that are not stored yet, the first copy of each message in scan order."""
    return unseen(first_per_key(records, ["message_id"], newest_first()), stored, "message_id")


def new_threads(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Threads of the new messages that are not known yet, named by their first message."""
    candidates = messages.withColumn("name", F.col("thread_name"))
    return new_parents(candidates, stored, "thread_id", newest_first()).select("thread_id", "name", "is_group")


def check_messages(
    state: State, landed: dict[str, DataFrame], *, as_of: datetime | str, **options
) -> DataFrame:
    """One poll of the message history: stores what is new and returns it as items.

    `landed` holds message, handle, chat_message_join, chat, person and person_handle.
    """
    scanned = scan_messages(
        landed["message"], landed["handle"], landed["chat_message_join"], landed["chat"], as_of=as_of, **options
    )
    contacts = contact_names(landed["person"], landed["person_handle"], scanned)
    # Kept, because the lookup of seen keys reads them too.
    records, earlier = state.keep("messages_scanned", message_records(scanned, contacts)), state.earlier("messages")
    fresh = new_messages(records, seen(state, "messages", records, earlier, "message_id"))
    stored = state.append(
        "messages_found", fresh,
        "message_id string, thread_id string, text string, from_me boolean, sender string, date timestamp_ntz, "
        "thread_name string, is_group boolean, chat_id bigint",
    )
    table = parents(state, "threads")
    known = table.matching(stored)
    found = state.keep("threads_new", conform(new_threads(stored, known), schema.STATE["threads"]))
    threads = known.unionByName(found)
    table.upsert(found)
    messages = store_measured(state, "messages", "messages", stored.withColumn("processed", F.lit(False)))
    remember(state, "messages", messages, earlier, "message_id")
    return message_items(messages, threads)
