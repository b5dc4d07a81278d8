"""Every operator as a query over the test tables, with an independent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


class Registry(dict[str, Entry]):
    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(run: Query) -> Query:
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Entry(run, sql)
            return run

        return register


REGISTRY = Registry()


def load() -> Registry:
    """All registered queries; importing the modules registers them."""
    from isoreach.registry import analysis, coordinates, core, edges, preparation, spatial  # noqa: F401

    return REGISTRY
