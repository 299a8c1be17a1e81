"""Registration of queries and their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..scale import gather_texts
from ..sources.readers import spread_few_files
from .views import BASE_TABLES, TEXT_TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: For benches on one machine, whose text tables are single files.
SPREAD_FILES = False


class Tables:
    """The driver tables and the views over them, loaded on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._loaded = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE_TABLES):
            raise AttributeError(name)
        if name not in self._loaded:
            self._loaded[name] = self._load(name)
        return self._loaded[name]

    def over(self, documents: DataFrame) -> Tables:
        """The tables and views with other ``documents``."""
        other = Tables(self.spark, self.folder)
        other._loaded["documents"] = documents
        return other

    def by_document(self, min_bytes: int | None = None) -> list[tuple[Tables, bool]]:
        """(tables, gathered): the views over documents dealt to tasks by their id, and, if there
        are documents of ``min_bytes`` and more, the same views over these as they lie."""
        small, large = gather_texts(self.documents, "doc_id", "text", min_bytes)
        return [(self.over(small), True)] + ([] if large is None else [(self.over(large), False)])

    def _load(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread_few_files(table) if SPREAD_FILES and name in TEXT_TABLES else table
        sql = VIEWS[name]["spark"]
        inputs = {used: getattr(self, used) for used in _names(sql)}
        return self.spark.sql(sql, **inputs)


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def _with_views(sql: str) -> str:
    """Put the views a statement uses in front of it as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(VIEWS[name]["duck"])
                if name not in order:
                    order.append(name)

    need(sql)
    parts = []
    for name in order:
        body = VIEWS[name]["duck"]
        body = body.format(**{n: n for n in _names(body)})
        parts.append(f"{name} as ({body})")
    head = ",\n".join(parts)
    text = sql.strip()
    if not head:
        return text
    match = re.match(r"with\s+(recursive\s+)?", text, re.IGNORECASE)
    if match:
        return f"with {match.group(1) or ''}{head},\n{text[match.end():]}"
    return f"with {head}\n{text}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is its DuckDB oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _with_views(sql)
        return fn

    return register
