"""Typed expression trees and their lowering.

A factor is a tree over the columns of a panel. Lowering materialises each level
of window functions in one projection, so that nodes of one level share a window
pass, equal sub-trees are one column, and the row set never changes: an expression
over one panel needs no join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.nulls import clean, to_double
from panelkit.functions.rolling import Frame


class Node:
    """A value for each row of a panel."""

    def parts(self) -> tuple[Node, ...]:
        return ()

    @property
    def level(self) -> int:
        return max((p.level for p in self.parts()), default=0)


@dataclass(frozen=True)
class Field(Node):
    """A column of the panel."""

    name: str


@dataclass(frozen=True)
class Const(Node):
    value: float | None


@dataclass(frozen=True)
class Scalar(Node):
    """A function of the values of the same row; ``key`` names the function and its parameters."""

    key: tuple
    make: Callable[..., Column]
    args: tuple[Node, ...]

    def parts(self) -> tuple[Node, ...]:
        return self.args

    def __eq__(self, other: object) -> bool:
        return isinstance(other, type(self)) and (self.key, self.args) == (other.key, other.args)

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.key, self.args))


@dataclass(frozen=True, eq=False)
class Windowed(Scalar):
    """A window function; its arguments are materialised below it."""

    @property
    def level(self) -> int:
        return super().level + 1

    def __eq__(self, other: object) -> bool:
        return isinstance(other, type(self)) and (self.key, self.args) == (other.key, other.args)

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.key, self.args))


def compile_nodes(df: DataFrame, frame: Frame, keys: tuple[str, ...], wanted: dict[str, Node]) -> DataFrame:
    """``keys`` and a column for each wanted node."""
    names: dict[Node, str] = {}
    frame = replace(frame, pulled={})

    def column(node: Node) -> Column:
        if node in names:
            return F.col(names[node])
        if isinstance(node, Field):
            return to_double(F.col(f"`{node.name}`"))
        if isinstance(node, Const):
            return F.lit(node.value).cast("double")
        if isinstance(node, Windowed):
            return clean(node.make(frame, *map(column, node.args)))
        return clean(node.make(*map(column, node.args)))

    levels: dict[int, dict[Node, None]] = {}

    def visit(node: Node) -> None:
        for part in node.parts():
            visit(part)
        if isinstance(node, Windowed):
            levels.setdefault(node.level, {})[node] = None

    for node in wanted.values():
        visit(node)
    used = dict.fromkeys(keys) | dict.fromkeys((*frame.order, frame.symbol))
    fields: dict[str, None] = {}

    def collect(node: Node) -> None:
        if isinstance(node, Field):
            fields[node.name] = None
        for part in node.parts():
            collect(part)

    for node in wanted.values():
        collect(node)
    # Fields are cleaned once, under names of their own.
    out = df.select(*(F.col(f"`{c}`") for c in used), *(to_double(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(fields)))
    names |= {Field(c): f"_f{i}" for i, c in enumerate(fields)}
    for level in sorted(levels):
        below = {}
        for node in levels[level]:
            for part in node.args:
                if part not in names and not isinstance(part, Const):
                    below.setdefault(part, f"_n{len(names) + len(below)}")
        out = out.withColumns({n: column(p) for p, n in below.items()})
        names |= below
        made = {node: f"_n{len(names) + i}" for i, node in enumerate(levels[level])}
        before = len(frame.pulled)
        columns = {n: column(p) for p, n in made.items()}
        out = out.withColumns(dict(list(frame.pulled.values())[before:])).withColumns(columns)
        names |= made
    return out.select(*(F.col(f"`{k}`") for k in keys), *(column(node).alias(name) for name, node in wanted.items()))
