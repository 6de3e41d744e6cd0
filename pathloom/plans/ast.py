"""Syntax trees: expressions, patterns and statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    """An expression: ``op`` names its form, ``args`` are its parts (expressions, names or constants)."""

    op: str
    args: tuple = ()

    def walk(self):
        """This expression and all below it."""
        yield self
        stack = list(self.args)
        while stack:
            x = stack.pop()
            if isinstance(x, Expr):
                yield from x.walk()
            elif isinstance(x, (tuple, list)):
                stack.extend(x)
            elif isinstance(x, Pattern):
                for n in x.nodes:
                    stack.extend(n.props.values())


@dataclass(frozen=True)
class Column:
    """A yielded expression with its name."""

    expr: Expr
    alias: str


@dataclass
class Node:
    alias: str | None
    labels: list[str]
    props: dict[str, Expr]


@dataclass
class Edge:
    alias: str | None
    types: list[str]
    direction: str
    least: int | None
    most: int | None
    props: dict[str, Expr]

    @property
    def variable(self) -> bool:
        return self.least is not None


@dataclass
class Pattern:
    nodes: list[Node]
    edges: list[Edge]
    alias: str | None = None
    shortest: str | None = None  # single or all


@dataclass
class Statement:
    """A statement: ``kind`` and its clauses."""

    kind: str
    parts: dict = field(default_factory=dict)

    def __getitem__(self, key):
        return self.parts.get(key)
