"""Column types of items, results and landed inputs, as DDL strings.

All timestamps are TIMESTAMP_NTZ holding UTC, so results do not depend on the session time zone.
"""

METRICS = "struct<execution_time_ms:double,tokens_in:bigint,tokens_out:bigint,call_count:int,errors:int>"

ITEM = (
    "id string, content string, content_type string, source string, timestamp timestamp_ntz, "
    f"metadata map<string,string>, tags array<string>, metrics {METRICS}"
)

RESULT = f"{ITEM}, success boolean, error_message string, result_metrics {METRICS}"

ITEM_COLUMNS = ["id", "content", "content_type", "source", "timestamp", "metadata", "tags", "metrics"]
RESULT_COLUMNS = [*ITEM_COLUMNS, "success", "error_message", "result_metrics"]

MODEL_RESPONSE = """
    choices array<struct<message:struct<content:string>>>,
    usage struct<prompt_tokens:bigint,completion_tokens:bigint>, model string
"""

LINKS = "array<struct<type:string,href:string,rel:string>>"
ENCLOSURES = "array<struct<type:string,href:string>>"
SEGMENTS = "array<struct<start:double,end:double,text:string>>"

# State tables. Keys: feeds.url, articles.guid, podcasts.feed_url, episodes.guid,
# threads.thread_id, messages.message_id. Columns that nothing computes stay NULL.
STATE = {
    "feeds": """
        url string, title string, description string, website_url string, last_updated timestamp_ntz,
        last_checked timestamp_ntz, muted boolean, muted_reason string, peer_through boolean, error_count bigint,
        no_entries_count bigint, last_error string, article_count bigint, avg_quality_score double,
        quality_tier_counts string""",
    "articles": """
        guid string, feed string, title string, url string, description string, content string, author string,
        published_at timestamp_ntz, fetched_at timestamp_ntz, processed boolean, processed_at timestamp_ntz,
        summary string, quality_tier string, quality_score int, labels string, embedding_generated boolean,
        embedding string, word_count bigint, enriched boolean""",
    "podcasts": """
        feed_url string, title string, author string, muted boolean, created_at timestamp_ntz,
        updated_at timestamp_ntz""",
    "episodes": """
        guid string, feed_url string, title string, description string, published_at timestamp_ntz,
        audio_url string, transcript string, transcript_source string, transcript_url string, embedding string,
        summary string, quality_tier string, quality_score int, processed boolean, created_at timestamp_ntz,
        processed_at timestamp_ntz""",
    "threads": "thread_id string, name string, is_group boolean, last_processed timestamp_ntz",
    "messages": """
        message_id string, thread_id string, text string, from_me boolean, sender string, date timestamp_ntz,
        processed boolean, processed_at timestamp_ntz""",
}

# Parent tables and their keys.
PARENT_KEYS = {"feeds": "url", "podcasts": "feed_url", "threads": "thread_id"}
