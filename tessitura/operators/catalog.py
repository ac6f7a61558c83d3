"""Catalogs: which identifiers and source functions a predicate may use, and the columns behind them.

An identifier that is always there and single (`1..1`), or there at most once and never unreadable (`0..1`), may be a
plain column. Any other is an array: NULL is absent, a null element is an occurrence that can't be read. An empty
array counts as absent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.convert import NARROW, NUMERIC
from ..plans.diagnostics import closest


COMPARED = ("tinyint", "smallint", "int", "bigint", "double")


@dataclass(frozen=True)
class Identifier:
    name: str
    type: str  # string, number, bytecount, duration, boolean or blob
    column: Column
    required: bool = True
    several: bool = False
    bag: bool = False  # the column is an array
    unreadable: bool = True  # an occurrence may be unusable
    opens: bool = False  # reading it opens the file
    spark_type: str = ""  # of a plain column, or of a bag's elements, where known


@dataclass(frozen=True)
class Rejected:
    """A source function's argument that it doesn't take."""

    index: int
    reason: str
    instead: str | None = None


@dataclass(frozen=True)
class SourceFunction:
    name: str
    type: str
    several: bool
    least: int
    most: int
    resolve: Callable[[tuple[str, ...]], "Identifier | Rejected"]


@dataclass(frozen=True)
class Unknown:
    code: str
    message: str
    instead: str | None = None


class Catalog:
    """Identifiers by source and name; a source of None holds the names written alone."""

    def __init__(self, identifiers: dict[tuple[str | None, str], Identifier], functions: dict[tuple[str, str], SourceFunction] | None = None):
        self.identifiers = {(s and s.lower(), n.lower()): i for (s, n), i in identifiers.items()}
        self.functions = {(s.lower(), n.lower()): f for (s, n), f in (functions or {}).items()}
        self.sources = list(dict.fromkeys(s for s, _ in [*self.identifiers, *self.functions] if s))

    def names(self, source: str | None) -> list[str]:
        return [n for s, n in self.identifiers if s == source]

    def lookup(self, source: str | None, name: str) -> Identifier | Unknown:
        s, n = source and source.lower(), name.lower()
        if s and s not in self.sources:
            return Unknown("unknown-source", f"no source is named {source}", closest(source, self.sources))
        if found := self.identifiers.get((s, n)):
            return found
        if (s, n) in self.functions:
            return Unknown("source-function-needs-arguments", f"{name} takes arguments")
        if not s:
            if owner := next((o for o in self.sources if (o, n) in self.identifiers), None):
                if not self.names(None) or owner == "file":
                    return Unknown("needs-source", f"{name} is written with its source", f"{owner}::{name}")
            if any(f == n for _, f in self.functions):
                return Unknown("needs-source", f"{name} is written with its source")
        return Unknown("unknown-identifier", f"nothing is named {name}", closest(name, self.names(s)))

    def function(self, source: str, name: str) -> SourceFunction | Unknown:
        s, n = source.lower(), name.lower()
        if s not in self.sources:
            return Unknown("unknown-source", f"no source is named {source}", closest(source, self.sources))
        if found := self.functions.get((s, n)):
            return found
        return Unknown("unknown-function", f"{source} has no function {name}", closest(name, [f for o, f in self.functions if o == s]))


def present(bag: Column) -> Column:
    """An array, or NULL where it is empty."""
    return F.when(F.size(bag) > 0, bag)


def as_bag(c: Column, kind: str, element: T.DataType) -> Column:
    """Numbers keep a type in which Spark compares them exactly; any other becomes a narrow decimal."""
    if kind in NUMERIC and element.simpleString() not in (NARROW, *COMPARED):
        c = F.transform(c, lambda x: x.cast(NARROW))
    return present(c)


def frame_catalog(df: DataFrame, declared: dict[str, tuple]) -> Catalog:
    """A catalog over a frame's columns: name -> (type, bounds, column or its name), bounds one of 1..1, 0..1, 0..n, 1..n.

    A name may carry its source, as in "file::path". Array columns are bags; others must be 1..1 or 0..1.
    """
    columns = {n: F.col(d[2]) if len(d) > 2 and isinstance(d[2], str) else d[2] if len(d) > 2 else F.col(n.rpartition(":")[2]) for n, d in declared.items()}
    schema = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns.values()))).schema
    out = {}
    for (name, d), field in zip(declared.items(), schema.fields):
        source, _, own = name.rpartition("::")
        kind, bounds = d[0], d[1]
        c, bag = columns[name], isinstance(field.dataType, T.ArrayType)
        if not bag and bounds not in ("1..1", "0..1"):
            raise ValueError(f"{name} may hold several values, so its column must be an array")
        c = as_bag(c, kind, field.dataType.elementType) if bag else c
        held = (field.dataType.elementType if bag else field.dataType).simpleString()
        held = NARROW if bag and kind in NUMERIC and held not in COMPARED else held
        out[source or None, own] = Identifier(name, kind, c, bounds[0] == "1", bounds[-1] != "1", bag, bag or bounds == "1..1", False, held)
    return Catalog(out)
