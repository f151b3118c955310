"""Tool calls: dispatch by name, and outputs as text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dispatch(calls: DataFrame, tools: DataFrame, name: str = "name") -> DataFrame:
    """Adds success and error to each call: a tool that isn't in ``tools`` (one row a tool, a registry) fails the call
    instead of the job."""
    known = F.broadcast(tools.select(name).distinct().withColumn("__known", F.lit(True)))
    out = calls.join(known, name, "left").withColumn("success", F.coalesce("__known", F.lit(False)))
    return out.withColumn("error", F.when(~F.col("success"), F.concat(F.lit("unknown tool: "), F.col(name)))).drop("__known")


#: A tool takes the arguments of many calls and gives a response each, or an exception in its place.
Tool = Callable[[list[dict]], list]


def run_tools(calls: DataFrame, tools: dict[str, Tool], name: str = "name", arguments: str = "arguments") -> DataFrame:
    """Adds ``response``, ``success`` and ``error`` to each call (its arguments as a JSON object). The calls of a batch are grouped
    by tool and each tool is run once a batch. A call of an unknown tool, with arguments that are no JSON object, or whose tool fails, keeps its row with
    the error; if a tool fails as a whole, its calls are tried one by one, so that only those at fault have no response."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields) + ", response string, success boolean, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = [(None, False, None)] * len(pdf)
            of: dict[str, list[tuple[int, dict]]] = {}
            for i, (n, a) in enumerate(zip(pdf[name], pdf[arguments], strict=True)):
                try:
                    if n not in tools:
                        raise LookupError(f"unknown tool: {n}")
                    args = json.loads(a) if a is not None else {}
                    if not isinstance(args, dict):
                        raise ValueError("arguments are no object")
                    of.setdefault(n, []).append((i, args))
                except (LookupError, ValueError) as e:
                    out[i] = (None, False, f"{type(e).__name__}: {e}")
            for n, own in of.items():
                for (i, _), r in zip(own, _responses(tools[n], [a for _, a in own]), strict=True):
                    out[i] = (None, False, f"{type(r).__name__}: {r}") if isinstance(r, Exception) else (None if r is None else str(r), True, None)
            yield pdf.assign(response=[r for r, _, _ in out], success=[s for _, s, _ in out], error=[e for _, _, e in out])

    return calls.mapInPandas(run, schema)


def _responses(tool: Tool, arguments: list[dict]) -> list:
    try:
        got = list(tool(arguments))
        if len(got) != len(arguments):
            raise ValueError(f"{len(got)} responses to {len(arguments)} calls")
        return got
    except Exception as e:  # noqa: BLE001
        return [e] if len(arguments) == 1 else [r for a in arguments for r in _responses(tool, [a])]


def outputs_to_text(outputs: Column | str) -> Column:
    """Responses of the successful outputs (array<struct<success, response>>), tagged, a line each."""
    good = F.filter(outputs, lambda o: o["success"])
    return F.array_join(F.transform(good, lambda o: F.concat(F.lit("<tool_call>"), o["response"], F.lit("</tool_call>"))), "\n")
