"""Parsers of request parameters, and the errors that they raise."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcweave.schema import NODE_TYPES


class GraphError(Exception):
    """Base of all errors of a request."""


class InvalidArgument(GraphError):
    """The request itself is wrong."""


class NotFound(GraphError):
    """What the request asks for isn't in the graph."""


class MissingProperty(GraphError):
    """A property was asked for that the graph doesn't hold."""


def http_status(error: Exception, checking: bool = True) -> int:
    """Status of a web response: 400 for identifiers that are wrong or unknown and for other bad parameters, else 503.

    checking: the error came up while the request was checked, not while it ran.
    """
    return 400 if checking and isinstance(error, (InvalidArgument, NotFound)) else 503


@dataclass(frozen=True, order=True)
class Swhid:
    """A parsed identifier; ordered by type, then hash, as its text is."""

    node_type: str
    hash: str

    @classmethod
    def parse(cls, text: str) -> Swhid:
        if not text:
            raise InvalidArgument("empty identifier")
        parts = text.split(":")
        if len(parts) != 4:
            raise InvalidArgument(f"{text}: an identifier has four parts")
        namespace, version, node_type, digest = parts
        if namespace != "swh":
            raise InvalidArgument(f"{text}: unknown namespace {namespace}")
        if version != "1":
            raise InvalidArgument(f"{text}: unknown version {version}")
        if len(digest) != 40:
            raise InvalidArgument(f"{text}: the hash has {len(digest)} digits, not 40")
        if node_type not in NODE_TYPES:
            raise InvalidArgument(f"{text}: unknown type {node_type}")
        if not re.fullmatch("[0-9a-fA-F]{40}", digest):
            raise InvalidArgument(f"{text}: the hash isn't hexadecimal")
        return cls(node_type, digest.lower())

    def __str__(self) -> str:
        return f"swh:1:{self.node_type}:{self.hash}"


def node_types(text: str) -> frozenset[str] | None:
    """None for all ("*"), else the types of a comma list; repeated ones count once."""
    if text == "*":
        return None
    found = frozenset(text.split(",")) if text else frozenset()
    if unknown := sorted(found - set(NODE_TYPES)):
        raise InvalidArgument(f"unknown node types: {', '.join(unknown)}")
    return None if found == frozenset(NODE_TYPES) else found


def show_types(types: frozenset[str] | None) -> str:
    return "*" if types is None else ",".join(sorted(types))


Arcs = frozenset[tuple[str, str]]


def edges(text: str) -> Arcs | None:
    """None for all ("*"), else pairs of types in the direction of traversal; "" is none at all."""
    if text == "*":
        return None
    out = set()
    for one in text.split(",") if text else ():
        if one.count(":") != 1:
            raise InvalidArgument(f"{one}: an edge restriction is two types with a colon between")
        ends = []
        for end in one.split(":"):
            if end != "*" and end not in NODE_TYPES:
                raise InvalidArgument(f"{one}: unknown node type {end}")
            ends.append(NODE_TYPES if end == "*" else (end,))
        out |= {(a, b) for a in ends[0] for b in ends[1]}
    return frozenset(out)


def reverse_edges(text: str) -> str:
    return text if text == "*" else ",".join(":".join(reversed(e.split(":"))) for e in text.split(",")) if text else ""


def edge_predicate(arcs: Arcs | None) -> Column | None:
    """On src_type and dst_type; None where nothing is restricted."""
    if arcs is None:
        return None
    by_src: dict[frozenset, list] = {}
    for a in {a for a, _ in arcs}:
        by_src.setdefault(frozenset(b for x, b in arcs if x == a), []).append(a)
    out = F.lit(False)
    for dst, src in sorted(by_src.items(), key=str):
        out = out | (F.col("src_type").isin(*sorted(src)) & F.col("dst_type").isin(*sorted(dst)))
    return out


def natural(value: int | None, name: str) -> int | None:
    if value is not None and value < 0:
        raise InvalidArgument(f"{name} must be a positive integer")
    return value


def steps(text: str, names: list[str]) -> list[str]:
    """Steps of a pipeline from a list of names, numbers and ranges such as 3-9, 6- or a name to a name."""
    def place(x: str, default: int) -> int:
        if not x:
            return default
        if x.isdigit():
            if not 1 <= int(x) <= len(names):
                raise InvalidArgument(f"no step {x}")
            return int(x) - 1
        if x.lower() not in names:
            raise InvalidArgument(f"no step {x}")
        return names.index(x.lower())

    chosen = set()
    for part in text.split(","):
        if part == "*":
            chosen |= set(range(len(names)))
            continue
        first, dash, last = part.partition("-")
        a = place(first, 0)
        chosen |= set(range(a, (place(last, len(names) - 1) if dash else a) + 1))
    return [names[i] for i in sorted(chosen)]
