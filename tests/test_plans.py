"""What the planner makes of the queries: no cross joins, no Python where none is needed, early cuts."""

import pytest
from pyspark.sql import functions as F

from checks import ingest_queries, model_queries, text_queries  # noqa: F401
from checks.registry import QUERIES
from contentflow import values as V
from contentflow.operators import filters, known, models
from contentflow.plans import articles, transcription
from contentflow.session import work_folder

SF = "/root/testdata/sf0.001"
# These store something while they are built, or call models.
ACTS = {"batch_model", "token_usage", "correct_transcripts", "transcribe_items"}
ARROW = {"message_parts", "outbox"}
MODULES = (text_queries, ingest_queries, model_queries)
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ in {m.__name__ for m in MODULES} and n not in ACTS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = [node for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups") if node in text]
    assert python == (["ArrowEvalPython"] if name in ARROW else [])


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["newest_per_feed"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_lookback_reaches_the_scan(spark, tmp_path):
    spark.range(3).select(F.lit("2024-01-30").cast("timestamp_ntz").alias("d"), "id").write.parquet(str(tmp_path / "e"))
    kept = filters.within_lookback(spark.read.parquet(str(tmp_path / "e")), "d", "2024-01-31 00:00:00")
    assert "Or(IsNull(d),GreaterThanOrEqual(d,2024-01-24T00:00))" in plan(kept)


def test_stored_keys_are_reduced_before_their_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).selectExpr("cast(id % 7 as string) AS guid", "id")
        text = plan(known.unseen(rows, rows.select("guid"), "guid"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2 and text.count("HashAggregate") == 2


def test_work_folder_is_below_the_named_one(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_calls_run_in_the_tasks_asked_for(spark):
    rows = spark.range(2000).select(
        F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"),
        F.lit("m").alias("model_id"), F.lit("{}").alias("params"),
    )
    calls = models.complete(rows.union(rows), lambda: lambda messages, params: {}, concurrency=20, retries=1)
    found = calls.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(found) == 20 and sum(r["count"] for r in found) == 2000
    text = plan(models.complete(rows, lambda: None))
    assert "Sort" not in text and "hashpartitioning(call_key" in text and f", {V.MODEL_CONCURRENCY})" in text


def test_articles_are_chosen_without_their_texts(spark):
    rows = spark.createDataFrame([], "feed string, pos long, guid string, published_at timestamp_ntz, content string, title string")
    parents = spark.createDataFrame([], "feed string, muted boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(articles.select_entries(rows, parents, rows.select("guid"), as_of="2024-01-31 00:00:00"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    windows = [line for line in text.splitlines() if "WindowGroupLimit" in line or "Window [" in line]
    assert windows and not any("content" in line for line in windows)


def test_pages_are_limited_to_those_needed_before_they_are_compared(spark):
    entries = spark.createDataFrame([("g", "http://a", "x")], "guid string, url string, content string")
    pages = spark.createDataFrame([("http://a", "long text"), ("http://b", "no")], "url string, external_text string")
    made = known.enrich(entries, pages, F.lit(True))
    text = plan(made)
    assert text.index("SortAggregate" if "SortAggregate" in text else "HashAggregate") < text.index("LeftSemi")
    assert made.first().content == "long text"


def test_transcripts_are_not_sorted_to_meet_their_answers(spark):
    """Sorts of whole transcripts spill (70,938 MB shuffled, spilled and written at 6 GB by projection)."""
    rows = spark.createDataFrame([("t", "text")], "title string, transcript string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(transcription.correct_transcripts(rows, lambda: None, lambda step, answers: answers))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_texts_meet_the_answers_of_all_models_at_once(spark):
    """Each text was shuffled once for each model (126,791 MB shuffled, spilled and written at 6 GB by projection)."""
    items = spark.createDataFrame(
        [("1", "a", {"k": "v"}), ("2", "a", {"k": "v"}), ("3", "a", None), ("4", None, None)], "id string, content string, metadata map<string,string>"
    ).withColumn("prompt_key", models.prompt_key())
    asked = [models.Model("x", "v/1"), models.Model("y", "v/2", "{content} {k}", variables=("content", "k"))]
    requests = models.with_prompts(models.fan_out(items, asked), asked)
    told = requests.select(models.call_key().alias("call_key"), "model_id", F.get("messages", F.lit(0))["content"].alias("text")).distinct()
    answers = told.filter("text not like '%None%' or model_id = 'v/1'").select(
        "call_key", F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), F.col("model_id").alias("model"))).alias("response"),
        F.lit(None).cast("string").alias("call_error"), F.lit(1).alias("calls"), F.lit(1.0).alias("elapsed_ms"),
    )
    columns = ["id", "model_ord", "content", "success", "error_message", "metadata", "result_metrics"]
    one = models.with_answers(requests, answers).select(*columns)
    made = models.with_item_answers(items, asked, requests, answers).select(*columns)
    key = lambda r: (r.id, r.model_ord)
    assert sorted(made.collect(), key=key) == sorted(one.collect(), key=key) and made.count() == 8
    text = plan(made)
    assert text.rindex("Generate explode") > -1 and text.index("Generate explode") < text.index("Join")
