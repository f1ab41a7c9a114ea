"""Message splitting, truncation, history and the outbox."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentflow.functions import messages as M
from contentflow.operators import outbox as O
from contentflow.operators.state import State
from contentflow.plans.conversations import check_messages
from contentflow.sources import messages as S
from tests_support import message_tables


def model_split(text, limit):
    """Last blank line, else newline, else sentence end, each only after the first character; else the limit."""
    parts = []
    while len(text) > limit:
        window = text[:limit]
        cut = next((p for p in (window.rfind("\n\n"), window.rfind("\n"), window.rfind(". ")) if p > 0), limit)
        parts.append(text[:cut])
        text = text[cut:].lstrip()
    return [*parts, text] if text or not parts else parts


texts = st.lists(st.sampled_from(["a", "é", "😀", " ", "\n", "\n\n", ". ", "word ", " "]), max_size=60).map("".join)


@settings(max_examples=8, deadline=None)
@given(batch=st.lists(texts, min_size=40, max_size=80), limit=st.integers(1, 40))
def test_split_equals_model(spark, batch, limit):
    df = spark.createDataFrame(list(enumerate(batch)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", M.split_message(F.col("t"), limit).alias("p")).collect()}
    assert [got[i] for i in range(len(batch))] == [model_split(t, limit) for t in batch]


def test_split_edges(spark):
    cases = ["", None, "x" * 20, "x" * 21, ". " + "x" * 40, "\n" + "y" * 30, "Hello. " + "x" * 50, "a" * 19 + "\n\n" + "b" * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    got = [r.p for r in df.select(M.split_message(F.col("t"), 20).alias("p")).collect()]
    assert got[1] == [None]
    assert [g for i, g in enumerate(got) if i != 1] == [model_split(t, 20) for t in cases if t is not None]


def test_long_text_is_split_whole(spark):
    text = "".join(f"Sentence number {i}. " + ("\n\n" if i % 50 == 0 else "") for i in range(60_000))
    df = spark.createDataFrame([(text,)], "t string")
    parts = df.select(M.split_message(F.col("t")).alias("p")).first().p
    assert parts == model_split(text, 2000)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_truncation_keeps_the_known_length(spark):
    df = spark.createDataFrame([("x" * n,) for n in (1999, 2000, 2001)], "t string")
    assert [len(r.t) for r in df.select(M.truncate(F.col("t")).alias("t")).collect()] == [1999, 2000, 2003]


def test_splitting_takes_precedence_over_truncation(spark):
    items = spark.createDataFrame([("1", "word " * 1000)], "id string, content string")
    parts = O.message_parts(items, split=True).orderBy("part_no").collect()
    assert len(parts) == 3 and parts[0].text.startswith("[Part 1/3]\n\nword")
    assert not any("truncated" in p.text for p in parts)


def test_outbox_write_is_idempotent(spark, tmp_path):
    items = spark.createDataFrame([("1", "hi"), ("2", "ho")], "id string, content string")
    for _ in range(2):
        O.write_outbox(O.outbox(items, ["a", "b"]), str(tmp_path / "out"), "run-1")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def history(spark):
    return (
        spark.createDataFrame(
            [(1, 10, "old", True, 1), (2, 20, "Hello 100%", False, 1), (3, 30, None, False, 2), (4, 40, "", False, None), (5, 50, "HELLO", True, 9)],
            "rowid long, date long, text string, is_from_me boolean, handle_id long",
        ),
        spark.createDataFrame([(1, "+1555"), (2, "a@b")], "rowid long, id string"),
        spark.createDataFrame([(2, 7), (2, 8), (5, 8)], "message_id long, chat_id long"),
        spark.createDataFrame([(7, "", 43), (8, "Team", 45)], "rowid long, display_name string, style int"),
    )


def scan(spark, **options):
    rows = S.scan_messages(*history(spark), as_of="2001-01-01 00:00:00", lookback_hours=0, **options)
    return sorted((r.message_id, r.chat_id or 0) for r in rows.collect())


def test_scan_keeps_blank_text_and_fans_out(spark):
    assert scan(spark) == [(1, 0), (2, 7), (2, 8), (4, 0), (5, 8)]


def test_limit_counts_copies(spark):
    assert scan(spark, max_messages=3) == [(2, 7), (4, 0), (5, 8)]


def test_filters_use_sql_null_logic(spark):
    assert scan(spark, include_group_chats=False) == [(2, 8), (5, 8)]  # no chat, no style: left out
    assert scan(spark, contacts_to_exclude=["a@b"]) == [(1, 0), (2, 7), (2, 8)]  # unknown senders are left out
    assert scan(spark, include_unknown_senders=False) == [(1, 0), (2, 7), (2, 8)]
    assert scan(spark, trigger_word="hello", include_from_me=False) == [(2, 7), (2, 8)]
    assert scan(spark, trigger_word="h%o 1") == [(2, 7), (2, 8)]


def test_cutoff_reaches_the_scan(spark, tmp_path):
    message, *others = history(spark)
    message.write.parquet(str(tmp_path / "m"))
    rows = S.scan_messages(spark.read.parquet(str(tmp_path / "m")), *others, as_of="2024-01-01 00:00:00")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(date," in plan and "CartesianProduct" not in plan


def test_contact_is_the_first_person(spark):
    people = spark.createDataFrame([(2, "Bo", None), (1, "", " "), (3, "Cy", "Li")], "rowid long, first string, last string")
    handles = spark.createDataFrame([(2, "h"), (3, "h"), (1, "g")], "person_id long, handle string")
    assert [tuple(r) for r in S.contact_names(people, handles).collect()] == [("h", "Bo")]


def test_messages_without_chat_and_sender_are_emitted(spark, tmp_path):
    tables = message_tables(spark)
    tables["chat_message_join"] = tables["chat_message_join"].filter("message_id = 1")
    tables["message"] = spark.createDataFrame(
        [(1, "hi", 10**18, False, 1), (2, "ho", 10**18, True, None), (3, "he", 10**18, True, None)],
        "rowid long, text string, date long, is_from_me boolean, handle_id long",
    )
    for run in ("a", "b"):
        items = check_messages(State(spark, str(tmp_path), run), tables, as_of="2024-01-01 00:00:00")
        got = {r.message_id: r.source for r in items.collect()}
        assert got == ({"1": "imessage:Ann", "2": "imessage:None", "3": "imessage:None"} if run == "a" else {})
    threads = State(spark, str(tmp_path), "c").snapshot("threads")
    assert sorted(r.thread_id for r in threads.collect()) == ["7", "None"]


def test_a_batch_of_long_messages_is_split_a_few_texts_at_a_time():
    """All texts and parts of a batch were Python strings at once (8,292 MB an executor at 6 GB by projection)."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, *(f"{i} " + "word. " * 10_000 for i in range(400)), "short"])
    tracemalloc.start()
    try:
        got = M._splitter(2000)(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 24 million characters go through.
    assert peak < 8_000_000 and len(got) == 402 and got[0].as_py() is None and got[401].as_py() == ["short"]
    parts = got[7].as_py()
    assert parts[0].startswith("6 word. ") and max(map(len, parts)) <= 2000 and "".join(parts) == texts[7].as_py()
