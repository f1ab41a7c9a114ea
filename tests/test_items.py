"""Items, stages, text source, prompts and models."""

import json
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from contentflow import schema
from contentflow import values as V
from contentflow.functions import prompts as P
from contentflow.operators import filters, models as M, stages
from contentflow.sources.items import item_json, make_items
from contentflow.sources.text_files import read_texts, text_items

AS_OF = "2024-01-31 00:00:00"


def texts(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "path string, text string")


def test_text_source_defaults(spark):
    row = text_items(texts(spark, "Test input"), as_of=AS_OF).first()
    assert (row.content, row.content_type, row.source, row.metadata) == ("Test input", "text", "cli", {"size": "10", "source": "stdin"})
    assert row.timestamp == datetime(2024, 1, 31)


def test_text_source_options(spark):
    row = text_items(texts(spark, "Test"), as_of=AS_OF, source="custom_source", content_type="markdown").first()
    assert (row.source, row.content_type) == ("custom_source", "markdown")
    cut = text_items(texts(spark, "  ab cd  "), as_of=AS_OF, max_size=5).first()
    assert (cut.content, cut.metadata["size"]) == ("ab", "2")  # the limit counts before trimming
    kept = text_items(texts(spark, "  ab  "), as_of=AS_OF, trim_whitespace=False).first()
    assert kept.content == "  ab  "
    with pytest.raises(ValueError):
        text_items(texts(spark, "x"), as_of=AS_OF, content_type="movie")


def test_empty_text_gives_no_item(spark):
    assert text_items(texts(spark, "", "  \n ", None), as_of=AS_OF).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert read_texts(spark, str(tmp_path)).first().text == "one\ntwo"


def items(spark, **metadata):
    df = spark.createDataFrame([("k", "Test content")], "k string, c string")
    return make_items(
        df, content=F.col("c"), source="test-source", natural_key=F.col("k"), timestamp=F.lit("2024-01-02 03:04:05"),
        metadata=metadata or {"key": F.lit("value")},
    )


def test_item_defaults_and_json(spark):
    row = items(spark).withColumn("j", item_json()).first()
    assert (row.metrics.execution_time_ms, row.metrics.call_count, row.metrics.tokens_in) == (0.0, 1, None)
    data = json.loads(row.j)
    assert (data["content"], data["content_type"], data["timestamp"]) == ("Test content", "text", "2024-01-02T03:04:05")
    assert data["metadata"] == {"key": "value"} and data["metrics"]["tokens_out"] is None


def test_item_ids_are_reproducible(spark):
    assert items(spark).first().id == items(spark).first().id


def test_metadata_texts(spark):
    row = items(spark, yes=F.lit(True), no=F.lit(False), none=F.lit(None).cast("boolean"), n=F.lit(3)).first()
    assert row.metadata == {"yes": "True", "no": "False", "none": None, "n": "3"}


def test_results_have_defaults(spark):
    row = stages.as_results(items(spark)).first()
    assert (row.success, row.error_message, row.result_metrics.execution_time_ms, row.result_metrics.call_count) == (True, None, 0.0, 1)


def test_stage_gates_types_and_keeps_failures(spark):
    both = items(spark).unionByName(items(spark).withColumns({"content_type": F.lit("image"), "id": F.lit("pic")}))

    def upper(df):
        return df.withColumns({"content": F.upper("content"), "success": F.lit(True)})

    dropped = stages.process({"a": both}, upper, accepts="text", output_type="markdown").collect()
    assert [(r.content, r.content_type) for r in dropped] == [("TEST CONTENT", "markdown")]
    failed = {r.id: r for r in stages.process(both, upper, accepts=["text"], others="fail").collect()}
    assert failed["pic"].error_message == "Cannot handle data of type image" and not failed["pic"].success
    again = stages.pass_failed(stages.process(both, upper, accepts=["text"], others="fail"), lambda df: df.withColumns({"content": F.lit("x"), "success": F.lit(True)}))
    assert sorted((r.success, r.content) for r in again.collect()) == [(False, "Test content"), (True, "x")]


def test_delivery_reports_every_result(spark):
    good = stages.as_results(items(spark))
    bad = good.withColumns({"id": F.lit("bad"), "success": F.lit(False), "error_message": F.lit("boom")})
    done = stages.deliver(good.unionByName(bad), lambda df: df.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")))
    assert sorted((r.ok, r.error or "") for r in done.collect()) == [(False, "boom"), (True, "")]
    both = stages.deliver(good.unionByName(bad), lambda df: df.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error")), failed="deliver")
    assert both.filter("ok").count() == 2


def test_ingestor_interface(spark):
    def ingestor(spark, options):
        return text_items(texts(spark, options["text"]), as_of=AS_OF)

    got = stages.ingest(spark, ingestor, text="hello")
    assert got.columns == schema.ITEM_COLUMNS and got.first().content == "hello"


def test_union_keeps_the_input_name(spark):
    got = filters.union_inputs({"a": spark.range(1), "b": spark.range(1).withColumn("x", F.lit(1))})
    assert sorted((r.input_name, r.x) for r in got.collect()) == [("a", None), ("b", 1)]
    assert got.columns == ["id", "input_name", "x"]


def test_undated_rows_pass_the_lookback(spark):
    df = spark.createDataFrame([(None,), ("2024-01-24 00:00:00",), ("2024-01-23 23:59:59",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("d"))
    assert filters.within_lookback(df, "d", AS_OF).count() == 2


# --- prompts -----------------------------------------------------------------------------------


def one(spark, column, ddl="x int", row=(1,)):
    return spark.createDataFrame([row], ddl).select(column.alias("v")).first().v


def test_prompt_variables(spark):
    meta = F.create_map(F.lit("title"), F.lit("T {lang}"), F.lit("lang"), F.lit("de"), F.lit("gap"), F.lit(None))
    fill = lambda t, names: one(spark, P.fill_prompt(t, F.lit("C"), meta, names))
    assert fill("{title}|{content}|{gap}|{other}", ("title", "content", "gap", "other")) == "T {lang}|C|None|{other}"
    assert fill("{title} {lang}", ("title", "lang")) == "T de de"  # one after the other
    assert fill("{title}", ()) == "{title}"
    override = F.create_map(F.lit("content"), F.lit("from metadata"))
    assert one(spark, P.fill_prompt("{content}", F.lit("C"), override)) == "from metadata"
    assert one(spark, P.fill_prompt("{content}", F.lit(None).cast("string"))) == "None"


def test_messages_without_system(spark):
    assert [m.role for m in one(spark, P.prompt_messages(F.lit("p")))] == ["user"]
    assert [m.role for m in one(spark, P.prompt_messages(F.lit("p"), "s"))] == ["system", "user"]
    assert [m.role for m in one(spark, P.prompt_messages(F.lit("p"), ""))] == ["user"]


def test_responses(spark):
    def parse(body):
        return tuple(one(spark, P.parse_response(F.lit(json.dumps(body) if body is not None else "{broken"))))

    choice = [{"message": {"content": "hi"}}]
    assert parse({"choices": choice, "usage": {"prompt_tokens": 3, "completion_tokens": 4}, "model": "a/b"}) == (True, "hi", 3, 4, "a", None)
    assert parse({"choices": choice, "model": "local"}) == (True, "hi", 0, 0, "local", None)
    assert parse({"choices": choice})[4] == ""
    for bad in ({}, {"choices": []}, {"error": "x"}, None):
        assert parse(bad) == (False, None, None, None, None, V.BAD_RESPONSE)


def test_corrections(spark):
    def parse(text):
        return tuple(one(spark, P.parse_correction(F.lit(text), F.lit("raw"))))

    assert parse("CORRECTED TRANSCRIPT:\n better \n\nCHANGES MADE:\n- x ") == ("better", "- x")
    assert parse("CORRECTED TRANSCRIPT:\nbetter") == ("raw", V.CORRECTION_FORMAT_ERROR)
    assert parse("a\nCHANGES MADE:b\nCHANGES MADE:c") == ("raw", V.CORRECTION_FORMAT_ERROR)


def test_prompt_fields_are_filled_in_one_pass(spark):
    got = one(spark, P.domain_prompt(F.lit("{sample}"), F.lit("x" * 5000)))
    assert "Title: {sample}\n" in got and got.count("x" * 4000) == 1 and "x" * 4001 not in got


# --- models ------------------------------------------------------------------------------------

TWO = [M.Model("a", "v/a"), M.Model("b", "v/b", "Say {content}", "sys")]


def counting(path):
    def make():
        def complete(messages, params):
            with open(path, "a") as log:
                log.write(params["model"] + "\n")
            if "fail" in messages[-1]["content"]:
                raise RuntimeError("no")
            return {"choices": [{"message": {"content": messages[-1]["content"].upper()}}], "model": params["model"]}

        return complete

    return make


def model_items(spark, *contents):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "k int, c string")
    return make_items(df, content=F.col("c"), source="s", natural_key=F.col("k"), metadata={"model": F.lit("old")}, timestamp=F.lit(AS_OF))


def test_calls_are_made_once_and_failures_are_rows(spark, tmp_path):
    log = str(tmp_path / "calls")
    requests = M.with_prompts(M.fan_out(model_items(spark, "x", "x", "fail"), TWO), TWO)
    options = {"retries": 3, "retry_seconds": 0.0}
    M.complete(requests, counting(log), **options).write.parquet(str(tmp_path / "answers"))
    assert len(open(log).readlines()) == 2 + 3 * 2  # two distinct good calls, two failing ones tried three times
    answers = spark.read.parquet(str(tmp_path / "answers"))
    rows = M.with_answers(requests, answers).orderBy("id", "model_ord").collect()
    assert len(rows) == 6
    for r in rows:
        if r.content == "fail":
            assert (r.success, r.error_message, r.result_metrics.call_count, r.result_metrics.errors) == (False, "LLM error: no", 3, 1)
            assert r.metadata == {"model": "old"}
        else:
            assert r.success and r.metadata == {"model": r.model_id, "model_provider": "v"}
            assert r.content == ("SAY X" if r.model_ord == 2 else "PLEASE PROCESS THE FOLLOWING CONTENT:\n\nX")
    totals = Observation("run")
    M.observed(M.with_answers(requests, answers), totals).write.format("noop").mode("overwrite").save()
    assert totals.get["rows"] == 6 and totals.get["failures"] == 2 and totals.get["call_count"] == 4 + 6
    again = M.complete(requests, counting(log), answered=answers.filter("response IS NOT NULL"), **options)
    assert again.count() == 2  # only what failed is asked again


def test_catalogue():
    assert [m.name for m in M.catalogue()] == ["gpt4o", "claude", "o3mini", "deepseek"]
    deepseek = M.catalogue("deepseek")[0]
    assert deepseek.params["max_tokens"] == 2000 and deepseek.params["temperature"] == 0.7


def test_combination_is_in_configured_order(spark):
    rows = spark.createDataFrame(
        [("1", 2, "b", "", "B", 20.5, False), ("1", 1, "a", "m", "A", 10.25, True), ("2", 1, "a", None, None, 1.0, False)],
        "id string, model_ord int, name string, model_name string, content string, execution_time_ms double, success boolean",
    )
    got = {r.id: r for r in M.combine(rows).collect()}
    assert got["1"].success and got["1"].content == (
        "# Combined Results\n\n## a (m)\n\nA\n\n*Processed in 10.25ms*\n\n---\n\n## b\n\nB\n\n*Processed in 20.50ms*\n\n---\n\n"
    )
    assert not got["2"].success and "## a\n\nNone\n\n" in got["2"].content
    text = {r.id: r.content for r in M.combine(rows, "text").collect()}
    assert text["1"] == "A\n\nB"
    first = {r.id: r.name for r in M.first_success(rows, ["name"]).collect()}
    assert first == {"1": "a", "2": "a"}
