"""The given tables seen as feeds, messages, pages and attempts: once as frames, once as SQL.

The clock is fixed, so that results are the same on every run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
MESSAGES_AS_OF = "2024-01-01 12:00:00"
LOOKBACK_HOURS = 10
CUTOFF_NS = 725_760_000_000_000_000 + 2 * 3600 * 1_000_000_000

# Expressions that mean the same in both engines.
_GUID = """CASE WHEN doc_id % 11 = 7 THEN ''
    WHEN doc_id % 10 = 9 THEN 'g' || CAST(doc_id - 1 AS VARCHAR(20))
    ELSE 'g' || CAST(doc_id AS VARCHAR(20)) END"""
_HALF_HOURS = "(doc_id * 37) % 1440"
_OUTCOME = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'empty' ELSE 'ok' END"
_ERROR = "CASE WHEN event_type = 'error' THEN 'fetch failed ' || props END"
_HANDLE_ID = "CASE WHEN role = 'system' THEN NULL ELSE conv_id % 150 END"
_CHAT_NAME = "CASE WHEN conv_id % 2 = 0 THEN 'conv ' || CAST(conv_id AS VARCHAR(20)) ELSE '' END"
_STYLE = "CASE WHEN conv_id % 3 = 0 THEN 43 ELSE 45 END"
_DATE_NS = "725760000000000000 + (conv_id * 60 + turn) * 60000000000"
_URL = "'http://site.example/' || CAST(doc_id AS VARCHAR(20))"

SQL_VIEWS = {
    "entries": f"""SELECT source AS feed, doc_id AS pos, {_GUID} AS guid, {_URL} AS url,
        CASE WHEN doc_id % 25 = 3 THEN NULL
             ELSE TIMESTAMP '2024-01-01 00:00:00' + ({_HALF_HOURS}) * INTERVAL '30' MINUTE END AS published_at,
        'Title ' || CAST(doc_id AS VARCHAR(20)) AS title, text AS content FROM documents""",
    "feeds": "SELECT DISTINCT source AS feed, source IN ('src3', 'src7') AS muted FROM documents",
    "seen": "SELECT DISTINCT 'g' || CAST(doc_id AS VARCHAR(20)) AS guid FROM labels",
    "attempts": f"""SELECT user_id AS feed, event_id AS attempt_id, ts, {_OUTCOME} AS outcome, {_ERROR} AS error
        FROM events""",
    "msg": f"""SELECT conv_id * 100 + turn AS rowid_, text, {_DATE_NS} AS date_ns, role = 'user' AS is_from_me,
        {_HANDLE_ID} AS handle_rowid FROM conversations""",
    "msg_handle": "SELECT c_custkey AS rowid_, c_name AS handle FROM customer",
    "msg_chat": f"SELECT DISTINCT conv_id AS rowid_, {_CHAT_NAME} AS display_name, {_STYLE} AS style FROM conversations",
    # System messages are in no chat; the first answer is in the chat before its own, too.
    "msg_chat_join": """SELECT conv_id * 100 + turn AS message_id, conv_id AS chat_id FROM conversations
        WHERE role <> 'system' UNION ALL
        SELECT conv_id * 100 + turn, conv_id - 1 FROM conversations WHERE role = 'assistant' AND turn = 1""",
    "person": """SELECT o_orderkey AS rowid_, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS first_,
        CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS last_ FROM orders""",
    "person_handle": """SELECT o_orderkey AS person_id, c_name AS handle FROM orders
        JOIN customer ON o_custkey = c_custkey""",
    "scan": f"""SELECT m.rowid_ AS message_id, m.text, m.date_ns, m.is_from_me, h.handle, c.rowid_ AS chat_id,
        c.display_name AS chat_name, c.style FROM msg m
        LEFT JOIN msg_handle h ON m.handle_rowid = h.rowid_
        LEFT JOIN msg_chat_join j ON m.rowid_ = j.message_id
        LEFT JOIN msg_chat c ON j.chat_id = c.rowid_
        WHERE m.date_ns > {CUTOFF_NS} AND m.text IS NOT NULL""",
    "contacts": """SELECT handle, trim(coalesce(first_, '') || ' ' || coalesce(last_, '')) AS contact_name FROM (
        SELECT handle, first_, last_, row_number() OVER (PARTITION BY handle ORDER BY person_id) AS n
        FROM person_handle JOIN person ON person_id = rowid_) WHERE n = 1
        AND trim(coalesce(first_, '') || ' ' || coalesce(last_, '')) <> ''""",
    "records": """SELECT CAST(message_id AS VARCHAR) AS message_id, text, is_from_me AS from_me,
        CASE WHEN is_from_me THEN 'me' ELSE s.handle END AS sender,
        coalesce(CAST(chat_id AS VARCHAR), s.handle, 'None') AS thread_id,
        coalesce(nullif(chat_name, ''), contact_name, s.handle) AS thread_name,
        coalesce(style = 43, false) AS is_group,
        make_timestamp(CAST(date_ns // 1000 + 978307200000000 AS BIGINT)) AS date, chat_id, message_id AS row_no
        FROM scan s LEFT JOIN contacts ct ON s.handle = ct.handle""",
    "models": """SELECT * FROM (VALUES (1, 'alpha', 'vendor_a/alpha-1'), (2, 'beta', 'vendor_b/beta-1'),
        (3, 'gamma', 'vendor_c/gamma-1')) AS t(model_ord, name, model_id)""",
    # One call per document and model; the first two models fail for some text lengths.
    "results": """SELECT *, CASE WHEN success THEN name || ': ' || text ELSE text END AS content FROM (
        SELECT doc_id AS id, CAST(model_ord AS BIGINT) AS model_ord, name, model_id, text, model_ord * 10.25 AS ms,
        NOT (model_ord = 1 AND length(text) % 7 = 0 OR model_ord = 2 AND length(text) % 11 = 0) AS success
        FROM documents CROSS JOIN models)""",
}

_USES = {
    "scan": ("msg", "msg_handle", "msg_chat", "msg_chat_join"),
    "contacts": ("person", "person_handle"),
    "records": ("scan", "contacts"),
    "results": ("models",),
}


def _needed(text: str) -> list[str]:
    order: list[str] = []

    def add(name: str) -> None:
        for used in _USES.get(name, ()):
            add(used)
        if name not in order:
            order.append(name)

    for name in SQL_VIEWS:
        if re.search(rf"\b{name}\b", text):
            add(name)
    return order


def with_views(sql: str) -> str:
    """The statement with the views it names, as one self-contained query."""
    names = _needed(sql)
    if not names:
        return sql
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


# --- the same views as frames ------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for heavy work per row: spread over all cores if its scan uses fewer, as a single small file does."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def entries(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return documents.selectExpr(
        "source AS feed", "doc_id AS pos", f"{_GUID} AS guid", f"{_URL} AS url",
        f"""CASE WHEN doc_id % 25 = 3 THEN NULL
            ELSE timestampadd(MINUTE, 30 * ({_HALF_HOURS}), timestamp_ntz'2024-01-01 00:00:00') END AS published_at""",
        "'Title ' || CAST(doc_id AS VARCHAR(20)) AS title", "text AS content",
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("source AS feed").distinct().selectExpr(
        "feed", "feed IN ('src3', 'src7') AS muted"
    )


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("'g' || CAST(doc_id AS VARCHAR(20)) AS guid")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS feed", "event_id AS attempt_id", "ts", f"{_OUTCOME} AS outcome", f"{_ERROR} AS error"
    )


def history(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The landed message tables."""
    conversations = table(spark, sf_dir, "conversations")
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = conversations.filter("role <> 'system'").selectExpr("conv_id * 100 + turn AS message_id", "conv_id AS chat_id")
    more = conversations.filter("role = 'assistant' AND turn = 1").selectExpr(
        "conv_id * 100 + turn AS message_id", "conv_id - 1 AS chat_id"
    )
    return {
        "message": conversations.selectExpr(
            "conv_id * 100 + turn AS rowid", "text", f"{_DATE_NS} AS date", "role = 'user' AS is_from_me",
            f"{_HANDLE_ID} AS handle_id",
        ),
        "handle": customer.selectExpr("c_custkey AS rowid", "c_name AS id"),
        "chat": conversations.select("conv_id").distinct().selectExpr(
            "conv_id AS rowid", f"{_CHAT_NAME} AS display_name", f"{_STYLE} AS style"
        ),
        "chat_message_join": own.unionByName(more),
        "person": orders.selectExpr(
            "o_orderkey AS rowid", "CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS first",
            "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS last",
        ),
        "person_handle": orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
            "o_orderkey AS person_id", "c_name AS handle"
        ),
    }
