"""Scorers and metrics that users register by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Scorers: gold and predicted column to a column of scores. Metrics: score column to named aggregates.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"exact": X.score_exact, "token_f1": X.score_token_f1, "normalised": X.score_normalised}
METRICS: dict[str, Callable[[Column], dict[str, Column]]] = {"summary": lambda s: {"mean_score": F.avg(s), "max_score": F.max(s).cast("double"), "num_tasks": F.count(s)}}


def register_scorer(name: str, fn: Callable[[Column, Column], Column] | None = None) -> Callable:
    """Registers ``fn(gold, pred) -> Column`` (columns in, a column out; an Arrow function will do) under a name; without it, a decorator. A later one takes the name over."""
    if fn is None:
        return lambda f: register_scorer(name, f)
    SCORERS[name] = fn
    return fn


def register_metric(name: str, fn: Callable[[Column], dict[str, Column]] | None = None) -> Callable:
    """Registers ``fn(score) -> {name: aggregate}`` under a name; without it, a decorator."""
    if fn is None:
        return lambda f: register_metric(name, f)
    METRICS[name] = fn
    return fn


def named(registry: dict, name: str, kind: str) -> Callable:
    if name not in registry:
        raise ValueError(f"no {kind} named {name!r}; there are {', '.join(sorted(registry))}")
    return registry[name]


def score_by(df: DataFrame, gold: Column, pred: Column, *names: str) -> DataFrame:
    """Adds a column of scores for each named scorer; an unknown name is an error."""
    return df.withColumns({n: named(SCORERS, n, "scorer")(gold, pred) for n in names})


def summarise(df: DataFrame, score: str, *names: str, by: tuple = ()) -> DataFrame:
    """The aggregates of the named metrics over a score column, by groups if given; an unknown name is an error."""
    aggregates = {k: c for n in names for k, c in named(METRICS, n, "metric")(F.col(score)).items()}
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in aggregates.items()))
