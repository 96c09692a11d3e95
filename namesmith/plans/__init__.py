"""Registered queries: each area pairs its Spark plan with the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one area, each with its reference SQL (None: rows only)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def all_areas() -> list[Registry]:
    from namesmith.plans import (
        audits, candidates, cleaning, corpora, dialogues, evaluations, flagship, graphs, lookups, quality, questions,
        segments, sources, vectors,
    )

    areas = (
        flagship, sources, corpora, cleaning, segments, lookups, graphs, candidates, vectors, quality, questions,
        audits, dialogues, evaluations,
    )
    return [area.AREA for area in areas]
