"""Plug points: functions by name, for rerankers, variants, models, extractors and templates."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


class Registry:
    """Functions by name. A name is registered once."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def add(self, name: str, function: Callable[..., Any]) -> Callable[..., Any]:
        if name in self.known:
            raise ValueError(f"{self.what} {name} is there already")
        self.known[name] = function
        return function

    def __getitem__(self, name: str) -> Callable[..., Any]:
        if name not in self.known:
            raise KeyError(f"unknown {self.what}: {name}")
        return self.known[name]


RERANKERS, VARIANTS, EXTRACTORS, TEMPLATES = Registry("reranker"), Registry("variant"), Registry("extractor"), Registry("template")


def chained(df: DataFrame, *steps: Callable[[DataFrame], DataFrame | None]) -> DataFrame | None:
    """df through steps in order; a step that gives None ends the chain."""
    for step in steps:
        if df is None:
            break
        df = step(df)
    return df


def with_fallback(main: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """main's plan, or fallback's where main's cannot be analysed."""
    from pyspark.errors import AnalysisException

    try:
        out = main()
        out.schema  # noqa: B018  analysis happens here
        return out
    except AnalysisException:
        return fallback()
