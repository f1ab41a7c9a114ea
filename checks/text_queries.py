"""Text, date, page and transcript expressions over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import expected as X
from checks.registry import query
from checks.views import AS_OF, entries, history, wide
from contentflow.functions import dates as D
from contentflow.functions import text as T
from contentflow.functions import transcripts as TR
from contentflow.sources import pages as page_source

# White space for RE2: the same characters, listed.
WS = f"[{X.WHITESPACE}]"
TRIM = f"'{X.WHITESPACE}'"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_words(c: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda t: t <> '')) AS BIGINT)"


def _is_markdown(c: str) -> str:
    return (
        f"(starts_with({c}, '#') OR contains({c}, '*') OR contains({c}, '>') OR contains({c}, '- ')"
        f" OR contains({c}, '```') OR (contains({c}, '[') AND contains({c}, '](')))"
    )


def _clean_markdown(c: str) -> str:
    for pattern, new in (
        ("<[^>]+>", " "),
        (rf"\[{WS}*\]\({WS}*\)", ""),
        (rf"\[{WS}*\]\(http[^)]+\)", ""),
        (r"\n{3,}", "\n\n"),
        (f"{WS}{{2,}}", " "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return f"trim({c}, {TRIM})"


def _clean_html(c: str) -> str:
    for pattern in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!--.*?-->"):
        c = f"regexp_replace({c}, '{pattern}', '', 'gs')"
    for entity, char in X.FEED_ENTITIES:
        c = f"replace({c}, '{entity}', {sql_text(char)})"
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), {TRIM})"


def sql_clean(c: str) -> str:
    return f"CASE WHEN {_is_markdown(c)} THEN {_clean_markdown(c)} ELSE {_clean_html(c)} END"


# Texts of all three kinds of source, so that markup, plain prose and chat are all met.
_ALL_TEXTS = """SELECT 'page' AS kind, page_id AS id, html AS t FROM pages
    UNION ALL SELECT 'doc', doc_id, text FROM documents
    UNION ALL SELECT 'chat', conv_id * 100 + turn, text FROM conversations"""


def all_texts(spark, sf):
    pages = wide(spark, sf, "pages").selectExpr("'page' AS kind", "page_id AS id", "html AS t")
    docs = wide(spark, sf, "documents").selectExpr("'doc' AS kind", "doc_id AS id", "text AS t")
    chat = wide(spark, sf, "conversations").selectExpr("'chat' AS kind", "conv_id * 100 + turn AS id", "text AS t")
    return pages.unionByName(docs).unionByName(chat)


@query("text_format", f"""SELECT kind, id, CASE WHEN {_is_markdown('t')} THEN 'markdown' ELSE 'html' END AS format
    FROM ({_ALL_TEXTS})""")
def text_format(spark, sf):
    return all_texts(spark, sf).select("kind", "id", T.text_format(F.col("t")).alias("format"))


@query("clean_compat", f"SELECT kind, id, {sql_clean('t')} AS cleaned FROM ({_ALL_TEXTS})")
def clean_compat(spark, sf):
    return all_texts(spark, sf).select("kind", "id", T.clean(F.col("t")).alias("cleaned"))


@query("clean_html", f"SELECT kind, id, {_clean_html('t')} AS cleaned FROM ({_ALL_TEXTS})")
def clean_html(spark, sf):
    return all_texts(spark, sf).select("kind", "id", T.clean(F.col("t"), mode="html").alias("cleaned"))


@query("word_count", f"SELECT kind, id, {sql_words('t')} AS words FROM ({_ALL_TEXTS})")
def word_count(spark, sf):
    return all_texts(spark, sf).select("kind", "id", T.word_count(F.col("t")).alias("words"))


# Feed content: the lines of a document as content values, the whole as summary, the language as last resort.
@query("pick_content", """SELECT doc_id, coalesce(list_filter(ls, lambda v: length(v) > 500)[1],
    nullif(ls[len(ls)], ''), nullif(text, ''), nullif(lang, ''), '') AS content
    FROM (SELECT doc_id, text, lang, string_split(text, chr(10)) AS ls FROM documents)""")
def pick_content(spark, sf):
    docs = wide(spark, sf, "documents")
    values = F.split("text", "\n", -1)
    return docs.select("doc_id", T.pick_content(values, F.col("text"), F.col("lang")).alias("content"))


# The pages' addresses as anchors (both quote styles, upper case too), as bare links, and not at all.
_DESCRIPTION = """CASE WHEN page_id % 4 = 0 THEN 'see <a class="x" href="' || url || '">it</a> or ' || html
    WHEN page_id % 4 = 1 THEN '<A HREF=' || chr(39) || url || chr(39) || '>it</A>' || html
    WHEN page_id % 4 = 2 THEN '<p>(' || url || ')</p> ' || html ELSE html END"""


@query("origin_url", f"""SELECT page_id, coalesce(
    nullif(regexp_extract(d, '(?i)<a{WS}+(?:[^>]*?{WS}+)?href=("(https?://[^"''>]+)"|''(https?://[^"''>]+)'')', 2), ''),
    nullif(regexp_extract(d, '(?i)<a{WS}+(?:[^>]*?{WS}+)?href=("(https?://[^"''>]+)"|''(https?://[^"''>]+)'')', 3), ''),
    nullif(regexp_extract(d, '(?i)https?://[^{X.WHITESPACE}<>"'')]+'), '')) AS origin
    FROM (SELECT page_id, {_DESCRIPTION} AS d FROM pages)""")
def origin_url(spark, sf):
    described = wide(spark, sf, "pages").selectExpr("page_id", f"{_DESCRIPTION} AS d")
    return described.select("page_id", T.origin_url(F.col("d")).alias("origin"))


_IDS = """SELECT e.pos, CASE WHEN e.feed IN ('src1', 'src2') THEN NULL ELSE e.guid END AS entry_id,
    CASE WHEN e.feed = 'src2' THEN NULL WHEN e.feed = 'src4' THEN '' ELSE e.url END AS link,
    CASE WHEN e.feed = 'src5' THEN NULL ELSE e.title END AS title FROM entries e"""


@query("resolve_ids", f"""SELECT pos, coalesce(entry_id, link, '') AS guid,
    coalesce(nullif(link, ''), coalesce(entry_id, link, '')) AS url, coalesce(title, 'Untitled') AS title FROM ({_IDS})""")
def resolve_ids(spark, sf):
    raw = entries(spark, sf).selectExpr(
        "pos", "CASE WHEN feed IN ('src1', 'src2') THEN NULL ELSE guid END AS entry_id",
        "CASE WHEN feed = 'src2' THEN NULL WHEN feed = 'src4' THEN '' ELSE url END AS link",
        "CASE WHEN feed = 'src5' THEN NULL ELSE title END AS title",
    )
    guid = T.entry_guid(F.col("entry_id"), F.col("link"))
    return raw.select(
        "pos", guid.alias("guid"), T.entry_url(F.col("link"), guid).alias("url"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
    )


# Event times written in every accepted form, by event type.
_DATE_FORMS = {
    "click": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", 0),
    "view": ("EEE, dd MMM yyyy HH:mm:ss '-0500'", "%a, %d %b %Y %H:%M:%S -0500", 5),
    "error": ("dd MMM yyyy HH:mm:ss 'EST'", "%d %b %Y %H:%M:%S EST", 5),
    "purchase": ("yyyy-MM-dd HH:mm:ss'+02:00'", "%Y-%m-%d %H:%M:%S+02:00", -2),
    "signup": ("MMMM d, yyyy HH:mm:ss", "%B %-d, %Y %H:%M:%S", 0),
}


@query("parse_dates", "SELECT event_id, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN date_trunc('second', ts) + INTERVAL '{h}' HOUR" for k, (_, _, h) in _DATE_FORMS.items())
    + " END AS published_at FROM events")
def parse_dates(spark, sf):
    written = F.lit(None).cast("string")
    for kind, (pattern, _, _) in _DATE_FORMS.items():
        written = F.when(F.col("event_type") == kind, F.date_format("ts", pattern)).otherwise(written)
    events = wide(spark, sf, "events").select("event_id", written.alias("d"))
    return events.select("event_id", D.first_date(F.lit(None).cast("string"), F.lit("junk"), F.col("d")).alias("published_at"))


@query("mac_time", """SELECT rowid_ AS message_id, make_timestamp(CAST(date_ns // 1000 + 978307200000000 AS BIGINT)) AS date
    FROM msg""")
def mac_time(spark, sf):
    return history(spark, sf)["message"].select(
        F.col("rowid").alias("message_id"), D.from_apple_nanos(F.col("date")).alias("date")
    )


_MARKUP = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[!?/]?[a-z][^>]*>"
)
_NAMED = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def _decode(c: str) -> str:
    for entity, char in _NAMED:
        c = f"replace({c}, '{entity}', {sql_text(char)})"
    return c


_PAGE = f"""SELECT page_id, url, html,
    coalesce({_decode("nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")}, 'No title') AS title,
    array_to_string(list_filter(list_transform(regexp_split_to_array(html, '{_MARKUP}'),
        lambda n: trim({_decode('n')}, {TRIM})), lambda n: n <> ''), chr(10)) AS body FROM pages"""


@query("page_text", f"SELECT page_id, title, body FROM ({_PAGE})")
def page_text(spark, sf):
    html = F.col("html")
    return wide(spark, sf, "pages").select(
        "page_id", T.page_title(html).alias("title"), T.page_text(html).alias("body")
    )


@query("page_items", f"""SELECT sha256('web' || chr(31) || url) AS id, 'text' AS content_type, 'web' AS source,
    '# ' || title || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Source: ' || url AS content,
    title, '200' AS status_code, TIMESTAMP '{AS_OF}' AS "timestamp" FROM ({_PAGE})""")
def page_items(spark, sf):
    made = page_source.page_items(wide(spark, sf, "pages").select("url", "html"), as_of=AS_OF)
    return made.select(
        "id", "content_type", "source", "content", F.col("metadata")["title"].alias("title"),
        F.col("metadata")["status_code"].alias("status_code"), "timestamp",
    )


# Media links: every document is an episode, its lines are its links and its enclosures.
_LINK_TYPE = "CASE length(l) % 5 WHEN 0 THEN 'Audio/MPEG' WHEN 1 THEN 'text/html' WHEN 2 THEN 'Text/VTT' ELSE '' END"
_LINK_REL = "CASE WHEN length(l) % 7 = 3 THEN 'transcript' ELSE '' END"
_LINK_HREF = "'http://media.example/' || CAST(doc_id AS VARCHAR(20)) || '/' || CAST(length(l) AS VARCHAR(20))"


@query("media_links", f"""WITH e AS (SELECT doc_id, lang, list_transform(string_split(text, chr(10)),
        lambda l: {{'type': {_LINK_TYPE}, 'href': {_LINK_HREF}, 'rel': {_LINK_REL}}}) AS links FROM documents)
    SELECT doc_id, coalesce(CASE WHEN lang <> 'fr' THEN list_filter(links, lambda x: x.type = 'Audio/MPEG')[-1].href END,
        list_filter(links, lambda x: x.type = 'Audio/MPEG')[1].href) AS audio_url,
        list_filter(links, lambda x: (lang = 'fr' OR x.type <> 'Audio/MPEG') AND (x.rel = 'transcript'
            OR x.type = 'Text/VTT'))[-1].href AS transcript_url FROM e""")
def media_links(spark, sf):
    listed = wide(spark, sf, "documents").select("doc_id", "lang", F.expr(f"""transform(split(text, '\\n', -1),
        l -> named_struct('type', {_LINK_TYPE}, 'href', {_LINK_HREF}, 'rel', {_LINK_REL}))""").alias("links"))
    # French episodes name their audio only in the enclosures.
    silent = F.transform("links", lambda x: F.struct(
        F.when(x["type"] != "Audio/MPEG", x["type"]).otherwise("").alias("type"), x["href"].alias("href"), x["rel"].alias("rel")
    ))
    links = F.when(F.col("lang") == "fr", silent).otherwise(F.col("links"))
    enclosures = F.transform("links", lambda x: F.struct(x["type"].alias("type"), x["href"].alias("href")))
    return listed.select("doc_id", TR.media_links(links, enclosures).alias("m")).select("doc_id", "m.*")


# Transcripts: each document as a subtitle file, a JSON transcript or plain text, by language.
@query("transcript_text", """SELECT doc_id, CASE lang
    WHEN 'de' THEN array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''
        AND NOT contains(l, '-->') AND NOT starts_with(l, 'WEBVTT') AND NOT regexp_matches(l, '^[0-9]')), ' ')
    ELSE text END AS transcript FROM documents""")
def transcript_text(spark, sf):
    vtt = F.concat(
        F.lit("WEBVTT\n\n1\n00:00:01.000 --> 00:00:04.000\n"), F.replace("text", F.lit("\n"), F.lit("\n2\n00:04 --> 00:09\n"))
    )
    whole = F.to_json(F.struct(F.col("text").alias("transcript")))
    listed = F.to_json(F.array(F.struct("text")))
    nested = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("text").alias("transcript"))).alias("transcripts")).alias("results")))
    body = F.when(F.col("lang") == "de", vtt).when(F.col("lang") == "fr", whole).when(F.col("lang") == "es", listed)
    body = body.when(F.col("doc_id") % 2 == 0, nested).otherwise(F.col("text"))
    kind = F.when(F.col("lang") == "de", "text/vtt; charset=utf-8").when(
        F.col("lang").isin("fr", "es") | (F.col("doc_id") % 2 == 0), "application/json"
    ).otherwise("text/plain")
    docs = wide(spark, sf, "documents").select("doc_id", body.alias("body"), kind.alias("kind"))
    return docs.select("doc_id", TR.transcript_text(F.col("body"), F.col("kind"), F.lit("http://t.example/x")).alias("transcript"))


# Segments: the lines of a document, 37.5 seconds each.
@query("segments_markdown", f"""SELECT doc_id, '# Transcription' || chr(10) || chr(10) || array_to_string(list_transform(
    string_split(text, chr(10)), lambda l, i: '**[' || printf('%02d:%02d', CAST(floor((i - 1) * 37.5 / 60) AS INT),
        CAST(floor((i - 1) * 37.5) AS INT) % 60) || ' - ' || printf('%02d:%02d', CAST(floor(i * 37.5 / 60) AS INT),
        CAST(floor(i * 37.5) AS INT) % 60) || ']** ' || trim(l, {TRIM}) || chr(10) || chr(10)), '') AS content FROM documents""")
def segments_markdown(spark, sf):
    segments = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct((i * 37.5).alias("start"), ((i + 1) * 37.5).alias("end"), line.alias("text")),
    )
    docs = wide(spark, sf, "documents")
    return docs.select("doc_id", TR.format_transcription(F.col("text"), segments).alias("content"))
