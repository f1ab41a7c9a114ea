"""Damaged feed bodies, page markup and dates in free forms, next to expectations written by hand."""

from datetime import datetime

from pyspark.sql import functions as F

from contentflow.functions import dates as D
from contentflow.functions import text as T
from contentflow.operators.state import State
from contentflow.plans import pipelines
from contentflow.sources import feeds as S

HEAD = '<?xml version="1.0"?><rss version="2.0"><channel><title>A &amp; B</title><link>http://a.example</link><description>about</description>'
ONE = "<item><title>One</title><guid>g1</guid><link>http://a.example/1</link><pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate><description>first</description></item>"
TWO = "<item><title>Two</title><guid>g2</guid><description>second</description></item>"


def read(spark, *bodies):
    frame = spark.createDataFrame([(f"f{i}", 0, b) for i, b in enumerate(bodies)], "feed string, page int, body string")
    entries = {}
    for r in S.feed_entries(S.raw_entries(frame)).orderBy("feed", "pos").collect():
        entries.setdefault(r.feed, []).append((r.guid, r.title, r.content))
    heads = {r.feed: (r.title, r.description, r.website_url) for r in S.feed_heads(frame).collect()}
    problems = {r.feed: r.error for r in S.feed_problems(frame).collect()}
    return [(entries.get(f"f{i}", []), heads[f"f{i}"], problems.get(f"f{i}")) for i in range(len(bodies))]


def test_bodies_that_a_strict_parser_rejects_keep_what_can_be_read(spark):
    good = [("g1", "One", "first"), ("g2", "Two", "second")]
    head = ("A & B", "about", "http://a.example")
    bodies = [
        HEAD + ONE + TWO + "</channel></rss>",
        HEAD + ONE + TWO,  # cut behind the last item
        HEAD + ONE + TWO[:-20],  # cut within the last item's text
        HEAD + ONE + "<item><title>Two</title><guid>g2</guid><desc",  # cut within a tag
        HEAD + ONE.replace("One", "O&nbsp;n&e &bogus; &#xE9;&eacute;") + TWO + "</channel></rss>",
        HEAD + ONE.replace("first", "<p>a<br>b & c</p><img alt='x>y'>") + TWO + "</channel></rss>",
        HEAD + ONE + TWO + "</channel></rss><script>a && b</script>",
        "\n ﻿" + HEAD + ONE.replace("One", "O\x03ne") + TWO + "</channel></rss>",
        HEAD + ONE.replace("One", "<![CDATA[R&D <b>x</b> &amp;]]> & more") + TWO + "</channel></rss>",
        HEAD + ONE.replace("</title>", "", 1) + TWO + "</channel></rss>",  # an element that does not end
        HEAD + ONE.replace("<title>", "<title x=1 'y>") + TWO + "</channel></rss>",
        HEAD + "<!-- <item><guid>no</guid></item> & -->" + ONE + TWO + "</channel></rss>",
        HEAD + ONE.replace("</item>", "") + TWO + "</channel></rss>",  # the next item begins
    ]
    got = read(spark, *bodies)
    assert [g[1] for g in got] == [head] * len(bodies) and {g[2] for g in got} == {None}
    entries = [g[0] for g in got]
    assert entries[0] == entries[1] == entries[6] == entries[7] == entries[10] == entries[11] == entries[12] == good
    assert entries[2] == good
    assert entries[3] == [good[0], ("g2", "Two", "")]
    assert entries[4][0] == ("g1", "O\xa0n&e &bogus; éé", "first")
    assert entries[5] == [("g1", "One", "<p>a<br>b &amp; c</p><img alt='x>y'>"), good[1]]
    assert entries[8][0] == ("g1", "R&D <b>x</b> &amp; & more", "first")
    assert entries[9][0] == ("g1", "One", "first")


def test_atom_bodies_are_recovered_with_links_persons_and_enclosures(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T & U</title><link href="http://b.example/?a=1&b=2"/><author><name>Ann</name></author>
        <entry><id>e1</id><title>E</title><link rel="enclosure" type="audio/mp3" href='http://b/e.mp3'/><link href=http://b.example/e1 />
        <author><name>Bob & Co</name></author><updated>2024-01-30T10:00:00Z</updated><content type="xhtml"><div class="c"><p>Hi <b>you</b></p></div></content></entry>"""
    frame = spark.createDataFrame([("b", 3, atom)], "feed string, page int, body string")
    raw = S.raw_entries(frame).first()
    assert (raw.entry_id, raw.link, raw.author, raw.updated, raw.contents) == ("e1", "http://b.example/e1", "Bob & Co", "2024-01-30T10:00:00Z", ["<p>Hi <b>you</b></p>"])
    assert [tuple(x) for x in raw.links] == [("audio/mp3", "http://b/e.mp3", "enclosure"), (None, "http://b.example/e1", None)] and raw.pos == 3 << 32
    head = S.feed_heads(frame).first()
    assert tuple(head) == ("b", "T & U", "", "Ann", "http://b.example/?a=1&b=2")


def test_bodies_that_are_no_feeds_are_problems(spark):
    page = "<!DOCTYPE html><html><head><title>404</title></head><body><p>Not found<br></body></html>"
    got = read(spark, page, "", None, '{"error": 1}', HEAD + "</channel></rss>", "<html><body><p>well formed</p></body></html>")
    assert [g[2] for g in got] == ["no feed in the body", "empty body", "empty body", "no feed in the body", None, "no feed in the body"]
    assert all(g[0] == [] for g in got)
    two = spark.createDataFrame([("f", 0, page), ("f", 1, HEAD + ONE)], "feed string, page int, body string")
    assert S.feed_problems(two).count() == 0


def test_recovery_is_linear(spark):
    bodies = ["<rss>" + "<item><title>x" * 500, "<rss><item " + "a='" * 60_000, "<rss>" + "<![CDATA[" * 30_000, "<rss><item>" + "<title " * 30_000, "<rss><item><description>" + "<p>&" * 30_000]
    assert [len(g[0]) for g in read(spark, *bodies)] == [500, 0, 0, 1, 1]


def test_a_poll_reads_each_body_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(body):
        reads.add(1)
        return body

    landed = spark.createDataFrame(
        [("a", 0, HEAD + ONE + TWO), ("a", 1, HEAD + ONE.replace("g1", "g3")), ("b", 0, "<html><p>gone<br>"), ("c", 0, HEAD + TWO + "</channel></rss>")],
        "feed string, page int, body string",
    )
    bodies = landed.withColumn("body", F.udf(count, "string").asNondeterministic()("body"))
    state = State(spark, str(tmp_path), "run-1")
    pipelines.poll_bodies(state, bodies, as_of="2024-01-31 00:00:00").collect()
    assert reads.value == 4
    feeds = {r.url: (r.title, r.last_error) for r in state.of_run("reader").snapshot("feeds").collect()}
    assert feeds == {"a": ("A & B", None), "b": ("b", "no feed in the body"), "c": ("A & B", None)}
    assert sorted(r.guid for r in state.rows("articles").collect()) == ["g1", "g2", "g3"]


def test_items_end_at_their_own_end_tags_only(spark):
    cases = [
        "<rss><item>a</items></entry></item x></item \n><entry>b<item>c</item >",
        "<rss><item>a</item<item>b<itemx>c<item\td='>'>e",
        "<rss><channel><item/><item>\U0001f600\ufffe\uffff\x7f\x85\ufffd \x0b</item>",
    ]
    got = apply(spark, lambda body: F.array_join(S.recovery.items(S.recovery.normalised(body)), "|"), cases)
    assert got == ["a</items></entry></item x>|b<item>c</item >", "a</item|b<itemx>c|e", "\U0001f600\x7f\x85\ufffd "]


def apply(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_pages_are_cut_where_browsers_cut_them(spark):
    cases = {
        '<a title="x>y">z</a>': "z",
        '<img alt="5 > 3">ok': "ok",
        "<img alt='a>\"b'>ok<br/>more": "ok\nmore",
        '<p data-x = "1>2" hidden>a</p>': "a",
        '<p title="never closed>text</p>after': "text\nafter",
        "<p title=it's>text</p>": "text",
        "<textarea><b>raw</b> &amp; <i></textarea><b>not</b>": "<b>raw</b> & <i>\nnot",
        "<title>a <b>c</b></title>x": "a <b>c</b>\nx",
        "a &copy b &amp c &lt;d &notit; &#65 &#x42; &#128; &bogus; &copy2": "a © b & c <d ¬it; A B € &bogus; ©2",
        "&amp;lt; & &; &#; 1 < 2 <3": "&lt; & &; &#; 1 < 2 <3",
        '<script src="a>b">if (a > "</b>") x()</script>y': "y",
        "<style media='a>b'>p { }</style >z<scripty>w": "z\nw",
        "<!-- a > b --><!DOCTYPE html><?xml x?>t": "t",
        "<script>open": "",
    }
    assert dict(zip(cases, apply(spark, T.page_text, list(cases)))) == cases
    assert apply(spark, T.page_title, ['<title lang="a>b">A &amp; B &copy C</title>', "none"]) == ["A & B © C", "No title"]


def test_page_markup_is_read_in_linear_time(spark):
    pages = ['<a ="' * 50_000, "<a '" * 50_000, '<a x="' + "b" * 500_000, "<textarea>" + "<" * 5_000, "<p " + "a=b " * 100_000 + ">t", "&" * 200_000 + "&copy" * 2_000]
    assert [len(text) for text in apply(spark, T.page_text, pages)] == [250_000, 200_000, 500_006, 5_000, 1, 202_000]


DATES = [
    ("Jan 5 2024 3:04 PM", datetime(2024, 1, 5, 15, 4)),
    ("January 5, 2024 10:00 AM", datetime(2024, 1, 5, 10)),
    ("January 5th, 2024 at 12:30 a.m.", datetime(2024, 1, 5, 0, 30)),
    ("12 PM on Friday, 5 Sept. 2025", datetime(2025, 9, 5, 12)),
    ("2024/01/05", datetime(2024, 1, 5)),
    ("2024/1/5 7:08:09", datetime(2024, 1, 5, 7, 8, 9)),
    ("2024/13/05", datetime(2024, 5, 13)),
    ("05 Jan 24", datetime(2024, 1, 5)),
    ("05-Jan-99", datetime(1999, 1, 5)),
    ("2024 Jan 5", datetime(2024, 1, 5)),
    ("01/05/2024", datetime(2024, 1, 5)),
    ("13/05/2024", datetime(2024, 5, 13)),
    ("1/5/24 23:59", datetime(2024, 1, 5, 23, 59)),
    ("5.1.2024", datetime(2024, 5, 1)),
    ("20240105", datetime(2024, 1, 5)),
    ("20240105 101112", None),
    ("10:11:12.5 2024-01-05", datetime(2024, 1, 5, 10, 11, 12, 500000)),
    ("Fri Jan 05 15:04:05 EST 2024", datetime(2024, 1, 5, 20, 4, 5)),
    ("Jan 5 2024 3:04 PM -0500", datetime(2024, 1, 5, 20, 4)),
    ("Jan 5 2024 3:04 PM EST", datetime(2024, 1, 5, 20, 4)),
    ("May 2 2024", datetime(2024, 5, 2)),
    ("Jan 2024", None),
    ("Jan 5", None),
    ("5 January Feb 2024", None),
    ("hello 2024 5 6", None),
    ("31 Feb 2024", None),
    ("2024/01/05 25:00", None),
    ("13:00 PM Jan 5 2024", None),
    ("1 2 3 4", None),
    ("soon", None),
    ("", None),
    ("x" * 1000, None),
]


def test_dates_in_free_forms(spark):
    got = apply(spark, D.parse_date, [text for text, _ in DATES])
    assert [(text, g) for (text, _), g in zip(DATES, got)] == DATES
