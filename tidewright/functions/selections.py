"""Fields of operation texts with their place, read in one pass over the tokens of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'#[^\n]*|"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|\$\{[^}]*\}|\.\.\.|[$@]?[A-Za-z_]\w*|\((?:[^()"#$]|\$(?!\{))*\)|[{}():]')
# a pair of parentheses without texts, comments and parentheses is one token
FIELD = "at int, name string, alias string, depth int, scope string, trail array<string>"
SPREAD = "name string, depth int"


def read_fields(text: str) -> Iterator[tuple]:
    """(offset, name, alias, depth, scope, names above it within the scope) of every selected field.

    A scope is what the names above start from: ``query``, ``mutation`` or ``subscription``, or the type of the fragment the field
    stands in. Names of operations, variables, arguments, directives, spreads, comments and texts are no fields.
    """
    found: tuple[list, ...] = ([], [], [], [], [], [])
    scan_fields(text, *found)
    return zip(*found, strict=True)


def scan_fields(text: str, ats: list, names: list, aliases: list, depths: list, scopes: list, trails: list) -> None:
    """Adds the columns of :func:`read_fields` to the given lists."""
    tokens = [(m.start(), t) for m in _TOKEN.finditer(text) if (t := m[0])[0] not in '#"' and t[:2] != "${"]
    tokens.append((len(text), ""))
    frames, header, pending, alias, parens, i = [], [], None, None, 0, 0
    last = len(tokens) - 1
    while i < last:
        at, token = tokens[i]
        i += 1
        if token == "(" or token == ")":
            parens = max(0, parens + (1 if token == "(" else -1))
        elif parens or token[0] in ":(":
            continue
        elif token == "{":
            if frames:
                frames.append(pending or frames[-1])
            else:
                kind = header[0] if header else "query"
                frames.append((header[header.index("on") + 1] if kind == "fragment" and "on" in header[:-1] else kind, []))
            pending, header = None, []
        elif token == "}":
            frames, pending = frames[:-1], None
        elif token[0] in "@$":
            continue
        elif not frames:
            header.append(token)
        elif token == "...":
            following = tokens[i][1]
            pending = frames[-1]
            if following == "on" and i + 1 < last:
                start, kind = tokens[i + 1]
                if kind[0] == "(" and len(kind) > 1:  # no type stands here: the parentheses are read one by one
                    tokens[i + 1:i + 2] = [(start, "("), *((m.start(), m[0]) for m in _TOKEN.finditer(text, start + 1, start + len(kind)))]
                    last, kind = len(tokens) - 1, "("
                pending = (kind, [])
                i += 2
            elif following[:1].isalpha() or following[:1] == "_":
                i += 1
        elif tokens[i][1] == ":":
            alias = token
        else:
            scope, trail = frames[-1]
            ats.append(at)
            names.append(token)
            aliases.append(alias)
            depths.append(len(frames))
            scopes.append(scope)
            trails.append(trail)
            pending, alias = (scope, [*trail, token]), None


def field_arrays(texts: pa.Array) -> pa.Array:
    """The fields of each text as one Arrow array, made of whole columns; null for a null text."""
    columns: tuple[list, ...] = ([], [], [], [], [], [])
    ends = [0]
    for text in texts.to_pylist():
        if text is not None:
            scan_fields(text, *columns)
        ends.append(len(columns[0]))
    ats, names, aliases, depths, scopes, trails = columns
    steps = np.concatenate([[0], np.cumsum([len(t) for t in trails], dtype=np.int64)]).astype(np.int32)
    above = pa.ListArray.from_arrays(pa.array(steps), pa.array([n for t in trails for n in t], pa.string()))
    rows = pa.StructArray.from_arrays(
        [pa.array(ats, pa.int32()), pa.array(names, pa.string()), pa.array(aliases, pa.string()), pa.array(depths, pa.int32()), pa.array(scopes, pa.string()), above],
        ["at", "name", "alias", "depth", "scope", "trail"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=texts.is_null() if texts.null_count else None)


def fields(text: Column) -> Column:
    """Array of the selected fields of a text, see :func:`read_fields`; null for a null text."""
    def run(texts: pa.Array) -> pa.Array:
        return field_arrays(texts)

    return F.arrow_udf(run, f"array<struct<{FIELD}>>")(text)
