"""Numbers of a run, gathered by the writes that the run does anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from contentflow.operators.models import observed
from contentflow.operators.state import State

_NUMBERS = ("rows", "failures", "call_count", "tokens_in", "tokens_out")
_METRICS = ", ".join(f"{name} bigint" for name in _NUMBERS)


def store_measured(state: State, step: str, table: str, rows: DataFrame, ddl: str | None = None) -> DataFrame:
    """Append the rows as `state.append` does, and store how many they are, and for results their calls, failures and tokens.

    The numbers come from an observation of the write: there is no other pass over the rows.
    """
    observation = Observation()
    if "result_metrics" in rows.columns:
        watched = observed(rows, observation)
    else:
        watched = rows.observe(observation, F.count(F.lit(1)).alias("rows"))
    written = state.append(table, watched, ddl)
    found = {name: observation.get.get(name, 0) for name in _NUMBERS}
    line = state.spark.createDataFrame([tuple(found.values())], _METRICS)
    state.append(f"metrics/step={step}", line.coalesce(1), _METRICS)
    return written


def run_metrics(state: State) -> DataFrame:
    """(run_id, step, rows, failures, call_count, tokens_in, tokens_out) of every run and step of a state root."""
    return state._read(f"{state.root}/metrics", f"{_METRICS}, step string, run_id string").select("run_id", "step", *_NUMBERS)
