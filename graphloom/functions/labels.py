"""Node labels: named, typed, partial maps from node id to value, as tables (id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Labels:
    """A registry of label tables by name and type (a Spark type name such as int, string, boolean)."""

    def __init__(self, tables: dict[tuple[str, str], DataFrame] | None = None):
        self.tables = dict(tables or {})

    def add(self, name: str, table: DataFrame) -> Labels:
        kind = dict(table.dtypes)["value"]
        return Labels(self.tables | {(name, kind): table.select("id", "value")})

    def get(self, name: str, kind: str) -> DataFrame | None:
        """None if the name is unknown or has another type."""
        return self.tables.get((name, kind))

    def without(self, name: str) -> Labels:
        return Labels({k: v for k, v in self.tables.items() if k[0] != name})

    def names(self) -> list[tuple[str, str]]:
        return sorted(self.tables)


def put(table: DataFrame, changes: DataFrame) -> DataFrame:
    """A label table after new values (id, value)."""
    return table.join(changes.select("id"), "id", "left_anti").unionByName(changes.select("id", "value"))


def removed(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def flag(ids: DataFrame) -> DataFrame:
    """A flag label: present means true."""
    return ids.select("id", F.lit(True).alias("value"))


def attached(vertices: DataFrame, table: DataFrame, name: str, default=None) -> DataFrame:
    """``vertices`` with a label as a column: null where it has no value, or ``default`` (a dense label)."""
    out = vertices.join(table.select("id", F.col("value").alias(name)), "id", "left")
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))
