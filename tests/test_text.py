"""Text, date and transcript expressions against plain Python on edge cases."""

import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions import dates as D
from contentflow.functions import text as T
from contentflow.functions import transcripts as TR


def apply(spark, column, values, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


EDGES = [
    "", " ", "\n\n\n\n", "a  b", "a   b", "\x1c\x1d a \x85", "[ ]( )x", "[](http://x)y", "a\n\n\n\nb", "# T\n\n\n\nx <b>y</b>",
    "&amp;lt;b&amp;gt; t", "a < b", "a <b", "<script>x<y</script>z", "no tags <script src='a'>b > c</script> d", "<!-- c --> x",
    "- item", "**bold**", "```code```", "[l](u)", "plain &nbsp; text", "é😀 ok", "x<style>p{}</style>y", "᠎ kept", "tab\tnew\r\nline",
]


def model_clean(text):
    """The rules in words: markdown marks choose the branch, then substitutions in a fixed order."""
    marks = any(m in text for m in V.MARKDOWN_MARKS) or text.startswith("#") or ("[" in text and "](" in text)
    if marks:
        steps = [(r"<[^>]+>", " "), (r"\[\s*\]\(\s*\)", ""), (r"\[\s*\]\(http[^)]+\)", ""), (r"\n{3,}", "\n\n"), (r"\s{2,}", " ")]
    else:
        text = re.sub(r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "", text)
        for entity, char in V.FEED_ENTITIES:
            text = text.replace(entity, char)
        steps = [(r"<[^>]+>", " "), (r"\s+", " ")]
    for pattern, new in steps:
        text = re.sub(pattern, new, text)
    return text.strip()


def random_texts(count):
    alphabet = ["a", "B", " ", "  ", "\n", "\n\n\n", " ", "\x1c", "<b>", "<", ">", "&amp;", "&lt;", "[", "]", "(", ")", "](", "# ", "- ", "*", "é", "😀"]
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(count)]


def test_clean_equals_model(spark):
    texts = EDGES + random_texts(2000)
    assert apply(spark, T.clean, texts) == [model_clean(t) for t in texts]
    assert apply(spark, T.clean, [None]) == [""]


def test_unclosed_markup_stays_linear(spark):
    texts = ["a < b " * 200_000, "x<!-- " * 100_000, "<script>" * 100_000, "<style>- " * 100_000, "<b" * 200_000 + ">"]
    started = time.time()
    for mode in ("compat", "html"):
        cleaned = apply(spark, lambda c, m=mode: T.clean(c, m), texts)
        assert cleaned[0] == texts[0].strip() and cleaned[4] == ""
    assert time.time() - started < 60


def test_white_space_is_that_of_python(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    assert apply(spark, lambda c: c.rlike(V.WS), chars) == [c.isspace() for c in chars]
    assert apply(spark, lambda c: T.strip(F.concat(c, F.lit("x"), c)) == "x", chars) == [c.isspace() for c in chars]


def test_word_count_equals_split(spark):
    texts = EDGES + random_texts(500)
    assert apply(spark, T.word_count, [*texts, None]) == [*[len(t.split()) for t in texts], 0]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ([["a" * 500, "b" * 501]], "b" * 501), ([["a" * 501, "b" * 600]], "a" * 501), ([["one", "two"]], "two"),
        ([["one", ""]], "fallback"), ([[]], "fallback"), ([None], "fallback"), ([["one", None]], "one"),
    ],
)
def test_pick_content(spark, values, expected):
    assert apply(spark, lambda c: T.pick_content(c, F.lit(None), F.lit(""), F.lit("fallback")), values, "array<string>") == [expected]


def test_origin_url(spark):
    cases = {
        '<a class="x" href="https://a.example/1">t</a> http://b.example': "https://a.example/1",
        "<A HREF='http://c.example/2'>t</A>": "http://c.example/2",
        "see (http://d.example/3) now": "http://d.example/3",
        '<a href="/relative">x</a>': None,
        """<a href="http://e.example'>x</a>""": "http://e.example",
        "": None,
    }
    assert apply(spark, T.origin_url, [*cases, None]) == [*cases.values(), None]


def test_needs_enrichment(spark):
    long = "x" * 1000
    cases = {"x" * 999: True, long: False, long + " [...]": True, long + " READ MORE": True, long + " Continue Reading": True}
    assert apply(spark, lambda c: T.needs_enrichment(c, F.lit("http://x")), [*cases, None]) == [*cases.values(), True]
    assert apply(spark, lambda c: T.needs_enrichment(c, F.lit("guid-1")), ["short"]) == [False]
    assert apply(spark, lambda c: T.needs_enrichment(c, F.lit("http://x"), enabled=False), ["short"]) == [False]


def test_ids(spark):
    df = spark.createDataFrame([("i", "l"), ("", "l"), (None, "l"), (None, None), ("i", "")], "e string, l string")
    guid = T.entry_guid(F.col("e"), F.col("l"))
    got = [tuple(r) for r in df.select(guid, T.entry_url(F.col("l"), guid)).collect()]
    assert got == [("i", "l"), ("", "l"), ("l", "l"), ("", ""), ("i", "i")]


def test_dates(spark):
    cases = {
        "2024-01-15T10:00:00Z": datetime(2024, 1, 15, 10), "2024-01-15T10:00:00+02:00": datetime(2024, 1, 15, 8),
        "2024-01-15": datetime(2024, 1, 15), "2024-01-15 10:00:00.123456": datetime(2024, 1, 15, 10, 0, 0, 123456),
        "2024-01-15T10:00:00.250Z": datetime(2024, 1, 15, 10, 0, 0, 250000), " 2024-01-15T10:00Z\n": datetime(2024, 1, 15, 10),
        "Mon, 15 Jan 2024 10:00:00 GMT": datetime(2024, 1, 15, 10), "15 Jan 2024 10:00:00 -0530": datetime(2024, 1, 15, 15, 30),
        "5 January 2024": datetime(2024, 1, 5), "Mon Jan 15 10:00:00 2024": datetime(2024, 1, 15, 10),
        "January 15, 2024": datetime(2024, 1, 15), "1969-05-01T00:00:00": datetime(1969, 5, 1), "15 Jan 2024 10:00 PDT": datetime(2024, 1, 15, 17),
        "junk": None, "": None, "2024-13-45": None, "31 Foo 2024": None, "2024-02-30": None, "99": None,
    }
    assert apply(spark, D.parse_date, [*cases, None]) == [*cases.values(), None]


def test_dates_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert apply(spark, D.parse_date, ["2024-01-15T10:00:00Z"]) == [datetime(2024, 1, 15, 10)]
        assert apply(spark, D.from_apple_nanos, [725_760_000_000_000_000], "bigint") == [datetime(2024, 1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_apple_time_both_ways(spark):
    moment = datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert apply(spark, D.from_apple_nanos, [D.to_apple_nanos(moment)], "bigint") == [moment]


def test_page_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><p> hi &amp;lt; &#128512;&#x41; &nbsp;</p><!-- no --><b>t</b>&bogus; 3 < 4<p></p><script>open"
    )
    assert apply(spark, T.page_title, [page, "<p>x", None]) == ["A & B", "No title", "No title"]
    assert apply(spark, T.page_text, [page, None]) == ["A & B\nhi &lt; 😀A\nt\n&bogus; 3 < 4", ""]


def test_media_links(spark):
    link = "array<struct<type:string,href:string,rel:string>>"
    enclosure = "array<struct<type:string,href:string>>"
    cases = [
        ([("audio/mpeg", "1", ""), ("Audio/mp3", "2", "")], None, ("2", None)),
        (None, [("image/png", "0"), ("audio/a", "1"), ("audio/b", "2")], ("1", None)),
        ([("text/vtt", "v", ""), (None, "r", "transcript"), ("", "http://x/Transcript.html", None)], None, (None, "http://x/Transcript.html")),
        ([("audio/a", "transcript.mp3", "transcript")], None, ("transcript.mp3", None)),
        ([], [], (None, None)),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {link}, b {enclosure}")
    got = df.orderBy("i").select(TR.media_links(F.col("a"), F.col("b")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [c[2] for c in cases]


def test_transcript_text(spark):
    def read(body, kind="", url=""):
        return apply(spark, lambda c: TR.transcript_text(c, F.lit(kind), F.lit(url)), [body])[0]

    assert read('[{"text":"a"},{"text":"b"}]', "application/json") == "a b"
    assert read("[]", "application/json") == ""
    assert read('{"transcript":"t"}', url="http://x/y.json") == "t"
    assert read('{"results":{"transcripts":[{"transcript":"x"}]}}', "application/json") == "x"
    assert read('{"z":1}', "application/json") == '{"z":1}'
    assert read("{bad", "application/json") == "{bad"
    vtt = "WEBVTT\n\n1\n00:01 --> 00:02\nhello\n3 pigs\r\n  there \n"
    assert read(vtt, "text/vtt") == "hello   there "
    assert read("1\n00:01 --> 00:02\nWEBVTT stays\n", url="a.srt") == "WEBVTT stays"
    assert read(vtt, "text/plain") == vtt


def test_segments(spark):
    ddl = "array<struct<start:double,end:double,text:string>>"
    format_ = lambda c: TR.format_transcription(F.lit("whole"), c)
    got = apply(spark, format_, [[(0.0, 59.9, " a "), (60.0, 6000.0, "")], [], None], ddl)
    assert got == ["# Transcription\n\n**[00:00 - 00:59]** a\n\n**[01:00 - 100:00]** \n\n", "# Transcription\n\n", "# Transcription\n\nwhole"]
    plain = apply(spark, lambda c: TR.format_transcription(F.lit("whole"), c, "text"), [None], ddl)
    assert plain == ["whole"]
