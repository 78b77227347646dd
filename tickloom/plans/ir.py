"""Expression trees, their text and JSON forms."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Node:
    """One operation; equal trees are equal, so shared parts are built once."""


@dataclass(frozen=True)
class Literal(Node):
    value: float | bool | str


@dataclass(frozen=True)
class SourceRef(Node):
    """A field, of the bars or of a side source."""

    name: str
    source: str = "ohlcv"


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    kwargs: tuple[tuple[str, Any], ...] = ()
    output: str | None = None


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Filter(Node):
    series: Node
    condition: Node


@dataclass(frozen=True)
class Aggregate(Node):
    op: str
    series: Node


@dataclass(frozen=True)
class TimeShift(Node):
    """``change``, ``change_pct`` or ``ago`` by a number of bars."""

    op: str
    series: Node
    bars: int


@dataclass(frozen=True)
class Source(Node):
    """A whole side source, before a field is taken of it."""

    name: str


_KINDS = {c.__name__: c for c in (Literal, SourceRef, Call, Binary, Unary, Filter, Aggregate, TimeShift, Source)}


def to_dict(n: Any) -> Any:
    if isinstance(n, Node):
        return {"node": type(n).__name__} | {f.name: to_dict(getattr(n, f.name)) for f in fields(n)}
    if isinstance(n, tuple):
        return [to_dict(x) for x in n]
    return n


def from_dict(d: Any) -> Any:
    if isinstance(d, dict):
        return _KINDS[d["node"]](**{k: from_dict(v) for k, v in d.items() if k != "node"})
    if isinstance(d, list):
        return tuple(from_dict(x) for x in d)
    return d


def dumps(n: Node) -> str:
    return json.dumps(to_dict(n))


def loads(s: str) -> Node:
    return from_dict(json.loads(s))


def children(n: Node) -> list[Node]:
    out: list[Node] = []
    for f in fields(n):
        v = getattr(n, f.name)
        items = v if isinstance(v, tuple) else (v,)
        for x in items:
            if isinstance(x, Node):
                out.append(x)
            elif isinstance(x, tuple) and len(x) == 2 and isinstance(x[1], Node):
                out.append(x[1])
    return out


@dataclass
class Graph:
    """The distinct nodes of a tree in the order they can be computed."""

    nodes: list[Node] = field(default_factory=list)

    @classmethod
    def of(cls, root: Node) -> Graph:
        g, seen = cls(), set()

        def visit(n: Node) -> None:
            if n in seen:
                return
            seen.add(n)
            for c in children(n):
                visit(c)
            g.nodes.append(n)

        visit(root)
        return g

    def to_dot(self) -> str:
        at = {n: i for i, n in enumerate(self.nodes)}
        label = lambda n: type(n).__name__ + " " + str(getattr(n, "op", getattr(n, "name", getattr(n, "value", ""))))
        lines = [f'  n{i} [label="{label(n)}"];' for n, i in at.items()]
        lines += [f"  n{at[c]} -> n{i};" for n, i in at.items() for c in children(n)]
        return "\n".join(["digraph {", *lines, "}"])
