"""Query registry: a name, a builder ``(spark, sf_dir) -> DataFrame`` and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
        """Decorator that registers a builder under its function name."""

        def register(builder: Builder) -> Builder:
            key = name or builder.__name__
            if key in self.builders:
                raise ValueError(f"query {key} is registered twice")
            self.builders[key] = builder
            if sql is not None:
                self.sql[key] = sql
            return builder

        return register


#: The library's own queries; the modules of ``basaltiq.queries`` fill it when they are imported.
CORE = Registry()


def load_core() -> Registry:
    package = importlib.import_module("basaltiq.queries")
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"basaltiq.queries.{module.name}")
    return CORE
