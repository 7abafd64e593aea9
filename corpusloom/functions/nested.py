"""Walks over nested records: one table of what their leaves mean gives their paths and values, and rewrites them in place.

A pattern names a leaf by its fields; elements of arrays and values of maps stand under the name of the array or map:
``beats.state_changes.entity`` is the entity of each state change of each beat. Everything is one expression on the row,
built from the schema: no explode, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = "array<struct<path:string,kind:string,value:string>>"


@dataclass(frozen=True)
class Leaf:
    """The kind of a leaf, and what its path is shown as where that isn't the way to it."""

    kind: str
    shown: str | None = None


@dataclass(frozen=True)
class Walk:
    """``leaves``: pattern to meaning. ``labels``: of an array of records, the field that tells its elements apart in paths."""

    leaves: dict[str, Leaf]
    labels: dict[str, str]

    def found(self, schema: T.StructType, *kinds: str) -> Column:
        """Array of (path, kind, value) of the leaves of these kinds that hold something, in the order of the schema.

        Null records, arrays and maps have no leaves, nor have null and empty values. An element without its label is
        shown as ``None``.
        """
        parts = [self._leaves(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(f.name), kinds) for f in schema if self._under(f.name, kinds)]
        every = F.concat(*parts) if parts else F.array().cast(LEAF)
        return F.filter(every, lambda x: F.coalesce(x.value, F.lit("")) != "")

    def rewritten(self, df: DataFrame, change: Callable[[Column], Column], *kinds: str) -> DataFrame:
        """``df`` with ``change`` applied to each leaf of these kinds, wherever it stands; all else is as it was."""
        return df.withColumns({f.name: self._changed(F.col(f"`{f.name}`"), f.dataType, f.name, change, kinds) for f in df.schema if self._under(f.name, kinds)})

    def _under(self, pattern: str, kinds: tuple[str, ...]) -> bool:
        return any(x.kind in kinds and (p == pattern or p.startswith(pattern + ".")) for p, x in self.leaves.items())

    def _leaves(self, value: Column, kind: T.DataType, pattern: str, path: Column, kinds: tuple[str, ...]) -> Column:
        if isinstance(kind, T.StructType):
            inner = [(f, f"{pattern}.{f.name}") for f in kind if self._under(f"{pattern}.{f.name}", kinds)]
            return F.concat(*(self._leaves(value.getField(f.name), f.dataType, p, F.concat(path, F.lit(f".{f.name}")), kinds) for f, p in inner))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            items, of = (F.map_values(value), kind.valueType) if isinstance(kind, T.MapType) else (value, kind.elementType)
            label = self.labels.get(pattern)

            def each(x: Column) -> Column:
                return self._leaves(x, of, pattern, path if label is None else F.concat(path, F.lit("["), F.coalesce(x.getField(label).cast("string"), F.lit("None")), F.lit("]")), kinds)

            return F.coalesce(F.flatten(F.transform(items, each)), F.array().cast(LEAF))
        leaf = self.leaves[pattern]
        return F.array(F.struct((path if leaf.shown is None else F.lit(leaf.shown)).alias("path"), F.lit(leaf.kind).alias("kind"), value.cast("string").alias("value")))

    def _changed(self, value: Column, kind: T.DataType, pattern: str, change: Callable[[Column], Column], kinds: tuple[str, ...]) -> Column:
        if not self._under(pattern, kinds):
            return value
        if isinstance(kind, T.StructType):
            inner = F.struct(*(self._changed(value.getField(f.name), f.dataType, f"{pattern}.{f.name}", change, kinds).alias(f.name) for f in kind))
            return F.when(value.isNotNull(), inner)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: self._changed(x, kind.elementType, pattern, change, kinds))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: self._changed(x, kind.valueType, pattern, change, kinds))
        return change(value)


def built(kind: T.StructType, **values: Column) -> Column:
    """A record of this type from the values given; fields without one are null, or empty where they are arrays or maps."""

    def one(f: T.StructField) -> Column:
        if f.name in values:
            return values[f.name].cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            return F.array().cast(f.dataType)
        return F.create_map().cast(f.dataType) if isinstance(f.dataType, T.MapType) else F.lit(None).cast(f.dataType)

    return F.struct(*(one(f).alias(f.name) for f in kind))
