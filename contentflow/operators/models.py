"""Models: fan-out of items, batch application through a pluggable completer, recombination."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from contentflow import schema
from contentflow import values as V
from contentflow.functions.prompts import fill_prompt, parse_response, prompt_messages
from contentflow.operators.known import unseen
from contentflow.operators.state import State

# messages and model parameters in, chat completion out
Completer = Callable[[list[dict[str, str]], Mapping[str, Any]], Mapping[str, Any]]


@dataclass(frozen=True)
class Model:
    name: str
    model_id: str
    template: str = V.DEFAULT_PROMPT
    system_message: str | None = None
    variables: tuple[str, ...] = ("content",)
    params: Mapping[str, Any] = field(default_factory=dict)


def catalogue(*names: str) -> list[Model]:
    """The named models with their prompts and parameters, in the order asked for."""
    known = {}
    for name, model_id, preset, changed in V.MODEL_CATALOGUE:
        template, system = V.PROMPT_PRESETS[preset]
        params = {**V.COMMON_MODEL_PARAMS, **changed}
        known[name] = Model(name, model_id, template, system, params=params)
    return [known[name] for name in (names or known)]


def fan_out(items: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Every item once per model, in the configured order.

    The models are configuration, so they travel inside the plan: no join and no shuffle.
    """
    if not models:
        raise ValueError("no models")
    rows = [
        F.struct(
            F.lit(order).alias("model_ord"), F.lit(m.name).alias("name"), F.lit(m.model_id).alias("model_id"),
            F.to_json(F.from_json(F.lit(json.dumps(dict(m.params))), "map<string,string>")).alias("params"),
        )
        for order, m in enumerate(models, start=1)
    ]
    return items.withColumn("model", F.explode(F.array(*rows))).select(*items.columns, "model.*")


def with_prompts(fanned: DataFrame, models: Sequence[Model]) -> DataFrame:
    """The chat messages of each (item, model) row."""
    messages = F.lit(None).cast("array<struct<role:string,content:string>>")
    metadata = F.col("metadata") if "metadata" in fanned.columns else None
    for order, m in enumerate(models, start=1):
        prompt = fill_prompt(m.template, F.col("content"), metadata, m.variables)
        built = prompt_messages(prompt, m.system_message)
        messages = F.when(F.col("model_ord") == order, built).otherwise(messages)
    return fanned.withColumn("messages", messages)


def prompt_key() -> Column:
    """Identifies what the prompts of an item are made of: items with the same key have the same calls."""
    return F.sha2(F.to_json(F.struct("content", "metadata"), {"ignoreNullFields": "false"}), 256)


def call_key() -> Column:
    """Identifies a call: the same messages to the same model with the same parameters are one call."""
    return F.sha2(F.concat_ws("\x1f", "model_id", "params", F.to_json("messages")), 256)


def _caller(
    make_completer: Callable[[], Completer], retries: int, retry_seconds: float
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def attempt(completer, messages, params):
        for number in range(1, retries + 1):
            try:
                return json.dumps(dict(completer(messages, params))), None, number
            except Exception as problem:  # a failed call is a failed row, never a failed job
                if number == retries:
                    return None, f"LLM error: {problem}", number
                time.sleep(retry_seconds * number)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        completer = make_completer()
        made: set[str] = set()
        for batch in batches:
            fresh = ~(batch["call_key"].isin(made) | batch["call_key"].duplicated())
            batch = batch[fresh]
            made.update(batch["call_key"])
            if batch.empty:
                continue
            answers = []
            for messages, model_id, params in zip(batch["messages"], batch["model_id"], batch["params"]):
                started = time.perf_counter()
                chat = [{"role": m["role"], "content": m["content"]} for m in messages]
                answer = attempt(completer, chat, {**json.loads(params or "{}"), "model": model_id})
                answers.append((*answer, (time.perf_counter() - started) * 1000))
            columns = ["response", "call_error", "calls", "elapsed_ms"]
            yield pd.concat(
                [batch[["call_key"]].reset_index(drop=True), pd.DataFrame(answers, columns=columns)], axis=1
            )

    return call


_ANSWER = "call_key string, response string, call_error string, calls int, elapsed_ms double"
#: Calls of a task that are not stored yet, in expectation.
CALLS_PER_TASK = 200


def complete(
    requests: DataFrame,
    make_completer: Callable[[], Completer],
    *,
    retries: int = V.MODEL_RETRIES,
    retry_seconds: float = V.MODEL_RETRY_SECONDS,
    concurrency: int = V.MODEL_CONCURRENCY,
    answered: DataFrame | None = None,
) -> DataFrame:
    """Call the models for rows with (messages, model_id, params); one row per distinct call.

    Each task makes one client. `concurrency` is the number of tasks, and so of calls in flight: calls wait on the
    network, so their number says more than the bytes of their prompts. A task has all rows of its calls and
    makes each once. Calls that are already in `answered` are not made again. Write the result before using it twice:
    whatever is recomputed is called again.
    """
    calls = requests.select(call_key().alias("call_key"), "messages", "model_id", "params")
    if answered is not None:
        calls = unseen(calls, answered, "call_key")
    calls = calls.repartition(concurrency, "call_key")
    return calls.mapInPandas(_caller(make_completer, retries, retry_seconds), _ANSWER)


def _storing_caller(
    make_completer: Callable[[], Completer], retries: int, retry_seconds: float, folder: str, portion: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Calls as `_caller` does, and stores the answers of each `portion` of calls as a file before the next are asked."""
    call = _caller(make_completer, retries, retry_seconds)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        mine, attempt = f"part-{task.partitionId():05d}-", task.taskAttemptId()
        text, kinds = pa.string(), (("calls", pa.int32()), ("elapsed_ms", pa.float64()))
        form = pa.schema([(n, text) for n in ("call_key", "response", "call_error")] + list(kinds))
        made: set[str] = set()
        # What a lost attempt of this task has stored as a good answer is not asked for again.
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith(mine):
                with files.open_input_file(info.path) as source:
                    known = pq.read_table(source, columns=["call_key", "response"])
                made.update(k for k, r in zip(*(c.to_pylist() for c in known.columns)) if r is not None)

        def portions() -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch[~(batch["call_key"].isin(made) | batch["call_key"].duplicated())]
                made.update(batch["call_key"])
                for start in range(0, len(batch), portion):
                    yield batch.iloc[start : start + portion]

        for number, answers in enumerate(call(portions())):
            name = f"{mine}{attempt}-{number:05d}.parquet"
            with files.open_output_stream(f"{root}/.{name}") as out:
                pq.write_table(pa.Table.from_pandas(answers, form, preserve_index=False), out)
            files.move(f"{root}/.{name}", f"{root}/{name}")
            yield pd.DataFrame({"stored": [len(answers)]})

    return store


def complete_in_waves(
    state: State,
    step: str,
    requests: DataFrame,
    make_completer: Callable[[], Completer],
    *,
    retries: int = V.MODEL_RETRIES,
    retry_seconds: float = V.MODEL_RETRY_SECONDS,
    concurrency: int = V.MODEL_CONCURRENCY,
    limits: Mapping[str, int] | None = None,
    calls_per_task: int = CALLS_PER_TASK,
) -> DataFrame:
    """Answers to all requests, one row per distinct call. Each task asks its calls in waves that are stored one after the other.

    A wave holds at most `calls_per_task` calls of a task, and its answers are stored under their call keys before the task
    asks its next. No task waits for another, and prompts are shuffled once and not stored. A lost task asks its part of one
    wave again, and so does each task of a lost driver: what is stored as a good answer, by this run or an earlier one, is
    never asked for again. `limits` says how many tasks may call a model (by model id) at a time; the models without a limit
    share `concurrency` tasks.
    """
    answers = f"{_ANSWER}, run_id string"
    stored = state._read(f"{state.root}/{step}", answers)
    columns = ["call_key", "response", "call_error", "calls", "elapsed_ms"]
    good = stored.filter(F.col("response").isNotNull())
    # Each start of a run has a folder of its own, so that it never overwrites stored answers.
    mine = stored.filter(F.startswith("run_id", F.lit(f"{state.run_id}.start"))).select("run_id").distinct().collect()
    start = 1 + max((int(r["run_id"].rsplit(".start", 1)[1].split(".")[0]) for r in mine), default=0)

    limits = dict(limits or {})
    sizes = [*limits.values(), concurrency]
    first = [sum(sizes[:i]) for i in range(len(sizes))]
    spread = F.xxhash64(F.lit(5), "call_key")
    task = F.lit(first[-1]) + F.pmod(spread, F.lit(concurrency))
    for (model, tasks), at in zip(limits.items(), first):
        task = F.when(F.col("model_id") == model, F.lit(at) + F.pmod(spread, F.lit(tasks))).otherwise(task)

    calls = requests.select(call_key().alias("call_key"), "messages", "model_id", "params")
    open_calls = True
    if not good.isEmpty():
        # The open calls are found by their keys alone: prompts move only if some are left.
        left = state.keep(f"{step}_open", unseen(calls.select("call_key").distinct(), good, "call_key"))
        open_calls = not left.isEmpty()
        calls = calls.join(left, "call_key", "left_semi")
    run_id = f"{state.run_id}.start{start}"
    if open_calls:
        store = _storing_caller(make_completer, retries, retry_seconds, f"{state.root}/{step}/run_id={run_id}", calls_per_task)
        dealt = calls.withColumn("task", task.cast("int")).repartitionById(sum(sizes), F.col("task"))
        asked = dealt.select("call_key", "messages", "model_id", "params").mapInPandas(store, "stored bigint")
        asked.write.format("noop").mode("overwrite").save()
    now = state._read(f"{state.root}/{step}", answers)
    now = now.filter((F.col("run_id") == run_id) | F.startswith("run_id", F.lit(f"{run_id}.")) | F.col("response").isNotNull())
    # Two attempts of one task may have stored the same call: a good answer goes first.
    one = now.groupBy("call_key").agg(F.min_by(F.struct(*columns[1:]), F.struct(F.col("response").isNull(), "run_id")).alias("one"))
    return one.select("call_key", "one.*")


def with_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Result rows: the requests with content, success, error and metrics of their call.

    A failed row keeps the input content. `model` and `model_provider` join the metadata of good rows.
    """
    # The answers of a partition are hashed: the requests, which hold whole texts, are not sorted.
    joined = requests.withColumn("call_key", call_key()).join(answers.hint("shuffle_hash"), "call_key", "left")
    return _results(joined).drop("call_key")


def with_item_answers(items: DataFrame, models: Sequence[Model], requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows of `with_answers`, for requests that are `prompt_key`ed items once per model.

    Texts are shuffled once for an item and not once for each model: the answers of its models are brought together first.
    """
    told = requests.select("prompt_key", "model_ord", call_key().alias("call_key")).distinct().join(answers, "call_key")
    columns = ["response", "call_error", "calls", "elapsed_ms"]
    told = told.groupBy("prompt_key").agg(F.collect_list(F.struct("model_ord", *columns)).alias("told"))
    rows = fan_out(items.join(told.hint("shuffle_hash"), "prompt_key", "left").drop("prompt_key"), models)
    own = F.get(F.filter("told", lambda t: t["model_ord"] == F.col("model_ord")), F.lit(0))
    picked = rows.withColumn("own", own).drop("told")
    return _results(picked.withColumns({c: F.col("own")[c] for c in columns}).drop("own"))


def _results(joined: DataFrame) -> DataFrame:
    joined = joined.withColumn("parsed", parse_response(F.col("response")))
    success = F.coalesce(F.col("parsed.success"), F.lit(False))
    told = F.create_map(
        F.lit("model"), F.col("model_id"), F.lit("model_provider"), F.coalesce("parsed.provider", F.lit(""))
    )
    kept = F.map_filter("metadata", lambda k, _: ~k.isin("model", "model_provider"))
    metrics = F.struct(
        F.coalesce("elapsed_ms", F.lit(0.0)).alias("execution_time_ms"),
        F.col("parsed.tokens_in").alias("tokens_in"),
        F.col("parsed.tokens_out").alias("tokens_out"),
        F.coalesce("calls", F.lit(0)).alias("call_count"),
        F.when(success, 0).otherwise(1).alias("errors"),
    ).cast(schema.METRICS)
    return joined.withColumns(
        {
            "success": success,
            "error_message": F.when(~success, F.coalesce("call_error", "parsed.error_message")),
            "content": F.when(success, F.coalesce("parsed.content", "content")).otherwise(F.col("content")),
            "content_type": F.lit("text"),
            "metadata": F.when(success, F.map_concat(kept, told)).otherwise(F.col("metadata")),
            "result_metrics": metrics,
        }
    ).drop("parsed", "response", "call_error", "calls", "elapsed_ms", "messages", "params")


def _in_order(fields: Mapping[str, Column]) -> Column:
    """The rows of a group in model order. A group is one item, so it has one row per configured model."""
    columns = [c.alias(name) for name, c in fields.items()]
    return F.array_sort(F.collect_list(F.struct(F.col("model_ord").alias("ord"), *columns)))


def combine(results: DataFrame, style: str = "markdown", *, key: str = "id") -> DataFrame:
    """One row per item with the answers of all models in configured order; good if any model was."""
    rows = results.groupBy(key).agg(
        _in_order(
            {
                "name": F.col("name"), "model": F.col("model_name"), "content": F.col("content"),
                "ms": F.col("execution_time_ms"),
            }
        ).alias("rows"),
        F.bool_or("success").alias("success"),
    )
    if style == "markdown":
        def section(r: Column) -> Column:
            title = F.when(
                F.coalesce(r["model"], F.lit("")) != "", F.concat(r["name"], F.lit(" ("), r["model"], F.lit(")"))
            ).otherwise(r["name"])
            return F.concat(
                F.lit("## "), title, F.lit("\n\n"), F.coalesce(r["content"], F.lit("None")),
                F.lit("\n\n*Processed in "), F.format_string("%.2f", r["ms"]), F.lit("ms*\n\n---\n\n"),
            )

        text = F.concat(F.lit("# Combined Results\n\n"), F.array_join(F.transform("rows", section), ""))
    elif style == "text":
        text = F.array_join(F.transform("rows", lambda r: F.coalesce(r["content"], F.lit("None"))), "\n\n")
    else:
        raise ValueError(f"unknown combination style {style!r}")
    return rows.select(key, text.alias("content"), "success")


def first_success(results: DataFrame, columns: Sequence[str], *, key: str = "id") -> DataFrame:
    """Per item the first good answer in configured order, else the first answer."""
    order = F.struct((~F.coalesce("success", F.lit(False))).alias("bad"), F.col("model_ord"))
    picked = results.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("picked"))
    return picked.select(key, "picked.*")


def first_success_of(items: DataFrame, results: DataFrame, *, key: str = "id") -> DataFrame:
    """All items: the picked answer, or a failed row with the input when no model answered at all."""
    picked = first_success(results, ["content", "success", "error_message"], key=key)
    answers = picked.select(
        key, F.col("content").alias("answer"), F.col("success").alias("answered_well"), F.col("error_message")
    )
    joined = items.select(key, "content").join(answers, key, "left")
    none = F.col("answered_well").isNull()
    return joined.select(
        key,
        F.when(none, F.col("content")).otherwise(F.col("answer")).alias("content"),
        F.coalesce("answered_well", F.lit(False)).alias("success"),
        F.when(none, F.lit(V.NO_RESULTS)).otherwise(F.col("error_message")).alias("error_message"),
    )


def observed(results: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; whoever consumes them gets the run's totals in the observation, without another pass."""
    m = F.col("result_metrics")
    return results.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"),
        F.coalesce(F.sum(m["call_count"]), F.lit(0)).alias("call_count"),
        F.coalesce(F.sum(m["tokens_in"]), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(m["tokens_out"]), F.lit(0)).alias("tokens_out"),
    )


def usage(results: DataFrame, *by: str) -> DataFrame:
    """Calls, errors, tokens and time per step."""
    m = F.col("result_metrics")
    return results.groupBy(*by).agg(
        F.sum(m["call_count"]).alias("call_count"),
        F.sum(m["errors"]).alias("errors"),
        F.coalesce(F.sum(m["tokens_in"]), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(m["tokens_out"]), F.lit(0)).alias("tokens_out"),
        F.sum(m["execution_time_ms"]).alias("execution_time_ms"),
    )
