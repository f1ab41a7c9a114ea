"""State tables, ingest plans, polls and streams."""

import random

import pytest
from pyspark.sql import functions as F

from contentflow.operators import health, known, ranking
from contentflow.operators.models import Model
from contentflow.operators.note_files import NoteOptions
from contentflow.operators.state import State
from contentflow.plans import articles, episodes, pipelines
from contentflow.plans.conversations import check_messages
from contentflow.sources import feeds as S
from contentflow.streaming import polls

AS_OF = "2024-01-31 00:00:00"
ENTRY = "feed string, pos long, guid string, url string, title string, summary string, description string, published_at string, content string"


def entries(spark, *rows):
    """(feed, pos, guid, published_at, content)"""
    full = [(f, p, g, f"http://x/{g}", f"T{p}", "s", None, d, c) for f, p, g, d, c in rows]
    return spark.createDataFrame(full, ENTRY).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def feeds(spark, *rows):
    return spark.createDataFrame(list(rows), "feed string, muted boolean, peer_through boolean")


def guids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "guid string")


def select(spark, rows, parents=(("f", False, False),), seen=(), **limits):
    chosen = articles.select_entries(entries(spark, *rows), feeds(spark, *parents), guids(spark, *seen), as_of=AS_OF, **limits)
    return sorted((r.feed, r.pos) for r in chosen.collect())


def test_old_and_seen_entries_use_up_the_quota(spark):
    rows = [("f", 0, "a", "2024-01-30", ""), ("f", 1, "b", "2024-01-29", ""), ("f", 2, "c", None, ""), ("f", 3, "d", "2024-01-01", "")]
    assert select(spark, rows, seen=("a",), max_articles=2) == [("f", 1)]
    assert select(spark, rows, max_articles=3) == [("f", 0), ("f", 1), ("f", 2)]
    assert select(spark, rows, parents=(("f", True, False),)) == []


def test_copies_of_a_guid_keep_the_first_feed(spark):
    rows = [("b", 0, "x", "2024-01-30", ""), ("a", 1, "x", "2024-01-29", ""), ("a", 0, "x", "2024-01-28", ""), ("a", 2, "", "2024-01-30", "")]
    assert select(spark, rows, parents=(("a", False, False), ("b", False, False))) == [("a", 1)]


def test_undated_come_last_and_ties_keep_feed_order(spark):
    rows = [("f", i, f"g{i}", d, "") for i, d in enumerate([None, "2024-01-30", "2024-01-30", None])]
    assert select(spark, rows, max_articles=3) == [("f", 0), ("f", 1), ("f", 2)]


@pytest.mark.parametrize("n", [1, 25, 1500])
def test_top_per_group_with_a_hot_group(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(100), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(6)
    got = sorted(tuple(r) for r in ranking.top_per_group(df, ["k"], [F.col("v").desc(), F.col("i")], n, spread=3).collect())
    want = []
    for key in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:n]
    assert got == sorted(want)


def test_rows_are_cut_before_the_shuffle(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.range(100).selectExpr("id % 3 AS k", "id")
    text = plan(ranking.top_per_group(df, ["k"], [F.col("id")], 5))
    assert text.count("WindowGroupLimit") == 4 and "Partial" in text
    assert "Partial" in plan(ranking.first_per_key(df, ["k"], [F.col("id")]))


def test_peer_through_and_enrichment(spark):
    rows = entries(spark, ("f", 0, "a", None, "short"), ("f", 1, "b", None, "long " * 300), ("p", 0, "c", None, ""))
    rows = rows.withColumn("description", F.lit('<a href="http://origin/1">x</a>'))
    chosen = articles.select_entries(rows, feeds(spark, ("f", False, False), ("p", False, True)), guids(spark), as_of=AS_OF)
    external = spark.createDataFrame(
        [("http://x/a", "<p>a much longer text</p>"), ("http://x/a", "no"), ("http://x/b", "y" * 9000), ("http://origin/1", "found")],
        "url string, external_text string",
    )
    got = {r.guid: r for r in articles.to_articles(chosen, as_of=AS_OF, external=external).collect()}
    assert (got["a"].content, got["a"].enriched, got["a"].word_count) == ("a much longer text", True, 4)
    assert (got["b"].enriched, got["b"].word_count) == (False, 300)
    assert (got["c"].url, got["c"].content) == ("http://origin/1", "found")
    off = articles.to_articles(chosen, as_of=AS_OF, external=external, enrich_content=False)
    assert off.filter("enriched").count() == 0


def test_rows_without_need_do_not_share_a_join_key(spark):
    rows = spark.createDataFrame([(str(i), "u", "x" * 2000) for i in range(50)], "guid string, url string, content string")
    external = spark.createDataFrame([("u", "y" * 3000)], "url string, external_text string")
    got = known.enrich(rows, external, F.lit(False))
    assert got.count() == 50 and got.filter("enriched").count() == 0


# --- state -------------------------------------------------------------------------------------


def test_children_are_appended_once_per_run(spark, tmp_path):
    state = State(spark, str(tmp_path), "r1")
    assert state.earlier("articles").count() == 0
    for _ in range(2):
        state.append("articles", guids(spark, "a", "b"))
    later = State(spark, str(tmp_path), "r2")
    later.append("articles", guids(spark, "c"))
    assert later.earlier("articles").count() == 2 and later.rows("articles").count() == 3
    later.mark_processed("articles", guids(spark, "a"), "guid")
    third = State(spark, str(tmp_path), "r3")
    assert [r.guid for r in third.processed("articles", "guid").collect()] == ["a"]


def test_parents_are_snapshots(spark, tmp_path):
    def parents(*names):
        return spark.createDataFrame([(n,) for n in names], "thread_id string")

    first = State(spark, str(tmp_path), "r1")
    assert first.snapshot("threads").count() == 0
    first.write_snapshot("threads", parents("a"))
    second = State(spark, str(tmp_path), "r2")
    for _ in range(2):  # a repeated run starts from the same parents
        base = second.snapshot("threads")
        assert [r.thread_id for r in base.collect()] == ["a"]
        second.write_snapshot("threads", base.unionByName(parents("b"), allowMissingColumns=True))
    assert State(spark, str(tmp_path), "r3").snapshot("threads").count() == 2
    with pytest.raises(ValueError):
        first.snapshot("threads")


# --- feeds and podcasts ------------------------------------------------------------------------

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>A feed</title><link>http://a.example</link><description>about</description>
<item><title>One &amp; only</title><link>http://a.example/1</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate>
<description>&lt;p&gt;hello&lt;/p&gt;</description><enclosure url="http://a/1.mp3" type="audio/mpeg" length="1"/></item>
<item><link>http://a.example/2</link><content:encoded xmlns:content="x"><![CDATA[<b>full</b> text]]></content:encoded></item>
<item><title>blank id</title><guid></guid><link>http://a.example/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>B</title><link href="http://b.example" rel="alternate"/>
<entry><id>e1</id><title>E1</title><link rel="enclosure" type="audio/mp3" href="http://b/e1.mp3"/><link href="http://b.example/e1"/>
<updated>2024-01-30T10:00:00Z</updated><summary>sum</summary><content type="html">body</content></entry></feed>"""


def bodies(spark):
    return spark.createDataFrame([("a", 0, RSS), ("b", 0, ATOM), ("c", 0, "no xml"), ("d", 0, None)], "feed string, page int, body string")


def test_feed_bodies(spark):
    got = [tuple(r) for r in S.feed_entries(S.raw_entries(bodies(spark))).drop("author", "summary", "description").orderBy("feed", "pos").collect()]
    assert [(g[0], g[1], g[2], g[3], g[4], str(g[5]), g[6]) for g in got] == [
        ("a", 0, "g1", "http://a.example/1", "One & only", "2024-01-29 10:00:00", "<p>hello</p>"),
        ("a", 1, "http://a.example/2", "http://a.example/2", "Untitled", "None", "<b>full</b> text"),
        ("a", 2, "", "http://a.example/3", "blank id", "None", ""),
        ("b", 0, "e1", "http://b.example/e1", "E1", "2024-01-30 10:00:00", "body"),
    ]
    heads = {r.feed: (r.title, r.description, r.website_url) for r in S.feed_heads(bodies(spark)).collect()}
    assert heads == {"a": ("A feed", "about", "http://a.example"), "b": ("B", "", "http://b.example"), "c": ("c", "", ""), "d": ("d", "", "")}


def test_landed_feed_files(spark, tmp_path):
    folder = tmp_path / "feed=http%3A%2F%2Fa.example%2Frss"
    folder.mkdir()
    (folder / "1.xml").write_text(RSS)
    got = S.feed_entries(S.raw_entries(S.read_bodies(spark, str(tmp_path))))
    assert {r.feed for r in got.collect()} == {"http://a.example/rss"} and got.count() == 3


def test_episodes(spark):
    raw = S.podcast_entries(S.raw_entries(bodies(spark)))
    chosen = episodes.select_episodes(raw, spark.createDataFrame([("a", False), ("b", False)], "feed string, muted boolean"), guids(spark), as_of=AS_OF)
    assert sorted((r.guid, r.audio_url) for r in chosen.collect()) == [("e1", "http://b/e1.mp3"), ("g1", "http://a/1.mp3")]
    with_url = chosen.withColumn("transcript_url", F.when(F.col("guid") == "g1", "http://t/1.vtt"))
    landed = spark.createDataFrame([("http://t/1.vtt", "", "WEBVTT\n\nhello\nyou")], "url string, content_type string, body string")
    speech = spark.createDataFrame([("e1", "spoken"), ("g1", "unused")], "guid string, text string")
    got = {r.guid: (r.transcript, r.transcript_source, r.transcript_url) for r in episodes.with_transcripts(with_url, landed, speech).collect()}
    assert got == {"g1": ("hello you", "external", "http://t/1.vtt"), "e1": ("spoken", "whisper", None)}
    assert episodes.with_transcripts(with_url, landed, required=True).count() == 1


def shouting_model():
    def make():
        def complete(messages, params):
            if "refuse" in messages[-1]["content"]:
                raise RuntimeError("refused")
            return {"choices": [{"message": {"content": messages[-1]["content"][-60:].upper()}}], "model": params["model"]}

        return complete

    return make


NOW = {"retries": 1, "retry_seconds": 0.0}


def test_feeds_to_notes_is_idempotent_and_drains_its_backlog(spark, tmp_path):
    rows = entries(spark, ("a", 0, "g1", "2024-01-30", "one"), ("a", 1, "g2", None, "two refuse"), ("b", 0, "g3", "2024-01-01", "old"))
    heads = spark.createDataFrame([("a", "Feed A", "", ""), ("b", "Feed B", "", "")], "feed string, title string, description string, website_url string")
    vault, models = str(tmp_path / "vault"), [Model("m1", "v/1"), Model("m2", "v/2", "{title}: {content}", variables=("title", "content"))]

    def run(run_id, frame):
        state = State(spark, str(tmp_path / "state"), run_id)
        done = pipelines.feeds_to_notes(state, frame, heads, shouting_model(), vault, as_of=AS_OF, models=models, calls=NOW)
        return sorted((r.ok, r.error) for r in done.collect())

    assert run("r1", rows) == [(True, None), (True, None)]
    notes = {p.name: p.read_text() for p in (tmp_path / "vault").rglob("*.md")}
    assert "## m1 (v/1)" in notes["T0.md"] and "## m2 (v/2)\n\nT0: ONE" in notes["T0.md"] and "feed_title: Feed A" in notes["T0.md"]
    again = run("r1", rows)  # the same run again
    assert {p.name for p in (tmp_path / "vault").rglob("*.md")} == set(notes) and again
    kept = {r.url: r for r in State(spark, str(tmp_path / "state"), "reader").snapshot("feeds").collect()}
    assert (kept["a"].article_count, kept["a"].no_entries_count, kept["b"].no_entries_count) == (2, 0, 1)
    assert run("r2", rows) == []  # nothing new, so nothing is emitted
    kept = {r.url: r for r in State(spark, str(tmp_path / "state"), "reader").snapshot("feeds").collect()}
    assert (kept["a"].article_count, kept["b"].no_entries_count) == (2, 2)
    # News in the feed brings back the article that no model answered, but not the finished one.
    more = rows.unionByName(entries(spark, ("a", 2, "g4", "2024-01-30", "three")))
    assert len(run("r3", more)) == 2
    names = {p.name for p in (tmp_path / "vault").rglob("*.md")}
    assert names == {"T0.md", "T1.md", "T1_20240131000000.md", "T2.md"}


def test_message_poll_twice(spark, tmp_path):
    from tests_support import message_tables

    landed = message_tables(spark)
    first = check_messages(State(spark, str(tmp_path), "p1"), landed, as_of="2001-01-01 00:00:00", lookback_hours=0)
    assert sorted((r.message_id, r.source) for r in first.collect()) == [("1", "imessage:Ann"), ("2", "imessage:Ann")]
    again = check_messages(State(spark, str(tmp_path), "p2"), landed, as_of="2001-01-01 00:00:00", lookback_hours=0)
    assert again.count() == 0


def test_backlog_emits_all_open_rows_of_touched_parents(spark):
    children = spark.createDataFrame([("a", "1", False), ("a", "2", False), ("a", "3", True), ("b", "4", False)], "feed string, guid string, processed boolean")
    new = children.filter("guid = '2'")
    assert sorted(r.guid for r in known.backlog(children, new, "feed").collect()) == ["1", "2"]
    assert [r.guid for r in known.backlog(children, new, "feed", processed=guids(spark, "1")).collect()] == ["2"]


# --- streams -----------------------------------------------------------------------------------


def test_two_batches_store_what_one_batch_stores(spark, tmp_path):
    rows = [("f", i, f"g{i % 37}", None if i % 5 else "2024-01-30", f"text {i}") for i in range(120)]
    parents = feeds(spark, ("f", False, False))
    stored = {}
    for name, cuts in {"one": [(0, 120)], "two": [(0, 70), (50, 120)]}.items():
        root = str(tmp_path / name)
        for start, end in cuts:  # the second landing overlaps the first
            frame = entries(spark, *rows[start:end])
            frame.write.mode("append").parquet(f"{root}/landing")
            stream = polls.landed(spark, f"{root}/landing", frame.schema, files_per_batch=2)
            polls.ingest_stream(stream, parents, f"{root}/state", as_of=AS_OF, max_articles=None)
        got = [r.guid for r in State(spark, f"{root}/state", "reader").rows("articles").collect()]
        assert len(got) == len(set(got))
        stored[name] = set(got)
    assert stored["one"] == stored["two"] == {f"g{i}" for i in range(37)}


def test_counters(spark):
    base = spark.createDataFrame([("a", 3, None), ("b", 1, None)], "url string, article_count long, last_updated timestamp_ntz").withColumn("last_checked", F.col("last_updated"))
    stats = spark.createDataFrame([("a", 2)], "feed string, new_items long")
    checked = spark.createDataFrame([("a",), ("b",)], "feed string")
    got = {r.url: r for r in health.update_counters(base, stats, checked, AS_OF).collect()}
    assert (got["a"].article_count, str(got["a"].last_updated)) == (5, AS_OF)
    assert (got["b"].article_count, got["b"].last_updated, str(got["b"].last_checked)) == (1, None, AS_OF)


def test_note_options_default():
    assert NoteOptions().mode == "new"


def test_landed_files_keep_their_order(spark, tmp_path):
    import os

    folder = tmp_path / "feed=f"
    folder.mkdir()
    item = "<rss><channel><title>t</title><item><guid>{0}</guid><title>{0}</title></item><item><guid>{0}2</guid></item></channel></rss>"
    for name, when in (("z.xml", 1000), ("a.xml", 2000), ("b.xml", 2000)):
        (folder / name).write_text(item.format(name[0]))
        os.utime(folder / name, (when, when))
    raw = S.raw_entries(S.read_bodies(spark, str(tmp_path)))
    assert [r.entry_id for r in raw.orderBy("pos").collect()] == ["z", "z2", "a", "a2", "b", "b2"]
    assert raw.select("pos").distinct().count() == 6


def test_persons_dates_and_markup_of_common_feeds(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><author><name>Ann</name><email>a@b.x</email></author>
        <entry><id>1</id><author><name>Bob</name><email>b@b.x</email></author>
        <content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Hi <b>there</b></p></div></content></entry></feed>"""
    rss = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title>
        <item><guid>2</guid><dc:creator>Cy</dc:creator><dc:date>2024-01-30T10:00:00Z</dc:date></item>
        <item><guid>3</guid><author>Di</author></item></channel></rss>"""
    landed = spark.createDataFrame([("a", 0, atom), ("r", 0, rss)], "feed string, page int, body string")
    got = {r.guid: r for r in S.feed_entries(S.raw_entries(landed)).collect()}
    assert {g: r.author for g, r in got.items()} == {"1": "Bob", "2": "Cy", "3": "Di"}
    assert "<b>there</b>" in got["1"].content and str(got["2"].published_at) == "2024-01-30 10:00:00"
    assert {r.feed: r.author for r in S.feed_heads(landed).collect()} == {"a": "Ann", "r": ""}
