"""Plug-in surfaces: reward functions, datasets, tool parsers by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import ship


class Names:
    """A registry.  Another object under a name that is taken is an error, names
    are case-sensitive, an unknown name is an error."""

    def __init__(self, what: str) -> None:
        self.what, self.found = what, {}

    def add(self, name: str) -> Callable:
        def put(x):
            if self.found.setdefault(name, x) is not x:
                raise ValueError(f"{self.what} {name} is registered already")
            return x

        return put

    def get(self, name: str):
        if name not in self.found:
            raise ValueError(f"no {self.what} is called {name}: {sorted(self.found)}")
        return self.found[name]


REWARDS, DATASETS, TOOL_PARSERS = Names("reward"), Names("dataset"), Names("tool parser")


#: Tools: (arguments as a dict) to (what the model reads, a reward).  Interactions:
#: (messages as dicts) to (whether it is over, the reply, a score).
TOOLS, INTERACTIONS = Names("tool"), Names("interaction")
RESULT = "array<struct<name string, response string, reward double>>"
REPLY = "struct<done boolean, reply string, score double>"


def called(calls: Column, names: Iterable[str], limit: int | None = None) -> Column:
    """Results of tool calls (``name``, ``arguments`` as JSON text), in order, by
    registered tools; at most ``limit`` of them.  A call of an unknown tool, one with
    arguments that are no object, and one that fails give an error as the response
    and no reward."""
    tools = {n: TOOLS.get(n) for n in names}

    def one(call) -> dict:
        name, text = call["name"], call["arguments"]
        try:
            arguments = json.loads(text)
            if not isinstance(arguments, dict):
                raise TypeError("the arguments are no object")
            response, reward = tools[name](arguments)
            return {"name": name, "response": str(response), "reward": float(reward)}
        except Exception as e:  # noqa: BLE001  a tool may fail in any way; the model reads that it did
            return {"name": name, "response": f"Error: {type(e).__name__}", "reward": 0.0}

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda row: [] if row is None else [one(c) for c in list(row)[:limit]])

    return F.pandas_udf(run, RESULT)(calls)


def replied(messages: Column, name: str) -> Column:
    """What a registered interaction says to messages (``role``, ``content``)."""
    act = INTERACTIONS.get(name)

    def run(column: pd.Series) -> pd.DataFrame:
        said = [act([dict(m) for m in row]) for row in column]
        return pd.DataFrame({"done": [bool(x[0]) for x in said], "reply": [x[1] for x in said], "score": [float(x[2]) for x in said]})

    return F.pandas_udf(run, REPLY)(messages)


def python_reward(f: Callable[[str, str, str], float], on_error: float = 0.0) -> Callable[..., Column]:
    """A Python scorer of (source, text, gold) as an Arrow-batched UDF.  A row for
    which it fails scores ``on_error``."""

    def run(source: pd.Series, text: pd.Series, gold: pd.Series) -> pd.Series:
        def one(s, t, g) -> float:
            try:
                return float(f(s, t, g))
            except Exception:  # noqa: BLE001  a scorer may fail in any way; the row then scores on_error
                return on_error

        return pd.Series([one(*x) for x in zip(source, text, gold, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def timed_reward(f: Callable[[str, str, str], float], seconds: float, processes: int = 2, on_error: float = 0.0) -> Callable[..., Column]:
    """A Python scorer of (source, text, gold) with a time limit for each row, in
    ``processes`` children of the task's worker.  A row that takes longer has its
    child killed and scores ``on_error``, as does one for which the scorer fails or
    ends its process; the other rows keep their scores."""
    spark = SparkSession.getActiveSession()
    if spark:
        ship(spark)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from quillon.functions.timed import Children

        with Children(f, processes) as children:
            for columns in batches:
                yield pd.Series(children.scores(list(zip(*columns, strict=True)), seconds, on_error), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def rewarded(df: DataFrame, score: Column, length: str, max_len: int | None = None, buffer: int = 0, factor: float = 1.0) -> DataFrame:
    """``reward``: scores that are there already (column ``rm_scores``) as they
    are, else the scorer's, null as 0; with ``max_len`` less a penalty that grows
    over the last ``buffer`` tokens."""
    out = F.coalesce(score, F.lit(0.0))
    if max_len is not None:
        out = out + F.least(-(F.col(length) - (max_len - buffer)) / buffer * factor, F.lit(0.0))
    return df.withColumn("reward", F.coalesce(F.col("rm_scores"), out) if "rm_scores" in df.columns else out)


def combined(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for x in frames:
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out
