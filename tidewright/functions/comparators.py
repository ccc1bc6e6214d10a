"""Per-path comparators: Column builders ``(baseline, candidate) -> boolean``.

Inputs are the scalar texts of the two nodes with their JSON types, as the
aligned node rows carry them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Comparator = Callable[[Column, Column, Column, Column], Column]


def _exact(a, b, ta, tb):
    return a.eqNullSafe(b) & (ta == tb)


def _strings(ta, tb):
    return (ta == "string") & (tb == "string")


def _number(v, t):
    """JavaScript-style number: null and '' are 0, booleans are 0/1."""
    plain = F.trim(v)
    return (
        F.when(t == "null", 0.0).when((t == "boolean"), (v == "true").cast("double"))
        .when((t == "string") & (plain == ""), 0.0).otherwise(plain.try_cast("double"))
    )


def date_tolerance(ms: int = 60000) -> Comparator:
    def test(a, b, ta, tb):
        def millis(v, t):
            stamp = F.unix_millis(F.try_to_timestamp(v))
            return F.when(t == "number", v.try_cast("double").cast("bigint")).otherwise(stamp)

        x, y = millis(a, ta), millis(b, tb)
        both, one = (ta == "null") & (tb == "null"), (ta == "null") | (tb == "null")
        return F.when(both, True).when(one, False).when(x.isNull() | y.isNull(), _exact(a, b, ta, tb)).otherwise(
            F.abs(x - y) <= ms
        )

    return test


def case_insensitive() -> Comparator:
    return lambda a, b, ta, tb: F.when(_strings(ta, tb), F.lower(a) == F.lower(b)).otherwise(_exact(a, b, ta, tb))


def numeric_tolerance(tolerance: float = 0.01, relative: bool = False) -> Comparator:
    def test(a, b, ta, tb):
        x, y = _number(a, ta), _number(b, tb)
        gap, top = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
        close = F.when(top == 0, True).otherwise(gap / top <= tolerance) if relative else gap <= tolerance
        return F.when(x.isNull() | y.isNull(), _exact(a, b, ta, tb)).otherwise(close)

    return test


def _typed_items(v: Column) -> Column:
    """Items of a JSON list as JSON texts, so that 1 and "1" differ."""
    return F.transform(F.from_json(v, "array<variant>"), lambda x: F.to_json(x))


def array_unordered() -> Comparator:
    def test(a, b, ta, tb):
        x, y = _typed_items(a), _typed_items(b)
        same = (F.size(x) == F.size(y)) & (F.sort_array(x) == F.sort_array(y))
        return F.when((ta == "array") & (tb == "array"), same).otherwise(_exact(a, b, ta, tb))

    return test


def ignore_whitespace() -> Comparator:
    def fold(v):
        return F.trim(F.regexp_replace(v, r"\s+", " "))

    return lambda a, b, ta, tb: F.when(_strings(ta, tb), fold(a) == fold(b)).otherwise(_exact(a, b, ta, tb))


def type_coercion() -> Comparator:
    def test(a, b, ta, tb):
        null_a, null_b = ta == "null", tb == "null"
        num = ((ta == "string") & (tb == "number")) | ((ta == "number") & (tb == "string"))
        boo = ((ta == "string") & (tb == "boolean")) | ((ta == "boolean") & (tb == "string"))
        return (
            F.when(null_a & null_b, True).when(null_a | null_b, False)
            .when((ta == "number") & (tb == "number"), a.try_cast("double") == b.try_cast("double"))
            .when(_exact(a, b, ta, tb), True)
            .when(num, F.coalesce(_number(a, ta) == _number(b, tb), F.lit(False)))
            .when(boo, (a == b) & a.isin("true", "false"))
            .otherwise(False)
        )

    return test


NESTING = 8  # levels a partial comparison follows; what lies deeper must be equal


def _children(v: Column) -> Column:
    """Members of an object by name, items of a list by place, each as JSON text."""
    items = _typed_items(v)
    members = F.transform_values(F.from_json(v, "map<string,variant>"), lambda _, u: F.to_json(u))
    return F.when(v.startswith("{"), members).when(v.startswith("["), F.map_from_arrays(F.transform(items, lambda _, i: i.cast("string")), items))


def _inside(x: Column, y: Column, levels: int) -> Column:
    """Whether JSON text ``y`` is contained in ``x``: objects member by member, lists item by item from the front.

    Children are bound in a one-item list, so that each level's expression is written and computed once.
    """
    if not levels:
        return x == y
    pair = F.array(F.struct(_children(x).alias("xs"), _children(y).alias("ys")))

    def member(c, e):
        return F.struct(F.map_contains_key(c["xs"], e["key"]).alias("there"), F.element_at(c["xs"], e["key"]).alias("x"), e["value"].alias("y"))

    held = F.forall(pair, lambda c: F.forall(
        F.transform(F.map_entries(c["ys"]), lambda e: member(c, e)), lambda p: p["there"] & _inside(p["x"], p["y"], levels - 1)))
    return F.when(F.substring(x, 1, 1).isin("{", "[") & (F.substring(x, 1, 1) == F.substring(y, 1, 1)), held).otherwise(x == y)


def deep_partial() -> Comparator:
    """Candidate is contained in the baseline, nested objects and lists too."""
    def test(a, b, ta, tb):
        nested = ta.isin("object", "array") & (ta == tb)
        return F.when(nested, F.forall(F.array(F.struct(F.trim(a).alias("x"), F.trim(b).alias("y"))), lambda p: _inside(p["x"], p["y"], NESTING))).otherwise(_exact(a, b, ta, tb))

    return test


_REGISTRY: dict[str, Callable[..., Comparator]] = {
    "date-tolerance": date_tolerance,
    "case-insensitive": case_insensitive,
    "numeric-tolerance": numeric_tolerance,
    "array-unordered": array_unordered,
    "ignore-whitespace": ignore_whitespace,
    "type-coercion": type_coercion,
    "deep-partial": deep_partial,
}


def register(name: str, builder: Callable[..., Comparator]) -> None:
    if name in _REGISTRY:
        raise ValueError(f"comparator {name} is already registered")
    _REGISTRY[name] = builder


def build(name: str, **options) -> Comparator:
    if name not in _REGISTRY:
        raise KeyError(f"unknown comparator {name}")
    return _REGISTRY[name](**options)
