"""Column functions over operation texts, names and paths. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.selections import fields

# Anchors, markers, suffixes and stop lists.
GENERIC_FILE_NAMES = ("index", "queries", "graphql")
ACCESS_STOP_NAMES = ("profile", "entity", "console", "Object", "Array", "Math")
NAME_PATTERN = r"(query|mutation|subscription|fragment)\s+([A-Za-z_$][\w$]*)"
TOKEN_PATTERN = r"""(\$\{\.\.\.}|\s+|[{}()\[\],:]|\w+|"[^"]*"|'[^']*')"""


def none_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def op_kind(content: Column) -> Column:
    return (
        F.when(content.rlike(r"(?m)^\s*mutation\s+"), "mutation")
        .when(content.rlike(r"(?m)^\s*subscription\s+"), "subscription")
        .when(content.rlike(r"(?m)^\s*query\s+") | content.rlike(r"(?m)^\s*\{\s*"), "query")
    )


def op_kind_by_word(content: Column) -> Column:
    return (
        F.when(content.contains("mutation"), "mutation")
        .when(content.contains("subscription"), "subscription")
        .when(content.contains("fragment"), "fragment")
        .otherwise("query")
    )


def op_name(content: Column) -> Column:
    return none_if_empty(F.regexp_extract(content, NAME_PATTERN, 2))


def interpolations(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"\$\{([^}]+)\}"), F.lit(1))


def has_interpolation(content: Column) -> Column:
    return content.contains("${")


def uses_registry(content: Column, marker: str = "queryNames.") -> Column:
    return content.contains("${" + marker)


def collapse(content: Column) -> Column:
    return F.trim(F.regexp_replace(content, r"\s+", " "))


def normalize_text(content: Column, comments: bool = True, placeholder: str | None = "${...}") -> Column:
    """Drops ``#`` comments, masks ``${x}``, folds white space. Idempotent."""
    out = F.regexp_replace(content, r"(?m)#.*$", "") if comments else content
    if placeholder is not None:
        out = F.regexp_replace(out, r"\$\{[^}]+\}", placeholder.replace("$", r"\$"))
    return collapse(out)


def classify_endpoint(path: Column, content: Column, rules: Sequence[tuple[str, str, Sequence[str]]], default: str) -> Column:
    """First rule whose path marker or any text marker occurs names the endpoint.

    ``rules``: (endpoint, path marker, text markers).
    """
    out = F.lit(default)
    for name, marker, words in reversed(list(rules)):
        hit = reduce(lambda a, b: a | b, [content.contains(w) for w in words], path.contains(marker))
        out = F.when(hit, name).otherwise(out)
    return out


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def words_of(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def normalize_name(name: Column, style: str = "pascal") -> Column:
    words = words_of(name)
    caps = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    if style == "camel":
        rest = F.array_join(F.slice(caps, 2, F.greatest(F.size(caps) - 1, F.lit(0))), "")
        joined = F.concat(F.lower(F.element_at(words, 1)), rest)
    elif style == "pascal":
        joined = F.array_join(caps, "")
    else:
        raise ValueError(f"unknown naming style {style}")
    return F.when(F.size(words) == 0, name).otherwise(joined)


def rename_in_content(content: Column, old: Column, new: Column) -> Column:
    """Renames the operation where its name is followed by an argument list."""
    quoted = F.concat(F.lit(r"(query|mutation|subscription)\s+\Q"), old, F.lit(r"\E\s*\("))
    return F.regexp_replace(content, quoted, F.concat(F.lit("$1 "), F.replace(new, F.lit("$"), F.lit(r"\$")), F.lit("(")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def component_of(path: Column) -> Column:
    """Segment after ``components/``; null when the path has none."""
    return none_if_empty(F.regexp_extract(path, r"(?:^|/)components/([^/]+)", 1))


def infer_name(
    name: Column, content: Column, path: Column, kind: Column,
    function: Column | None = None, component: Column | None = None, export: Column | None = None,
) -> Column:
    """First usable of: own name, name in the text, function, component, export, file."""
    null = F.lit(None).cast("string")
    own = F.when((name != "") & ~name.startswith("$") & (name != "unnamed"), name)
    fn = null if function is None else F.concat(capitalize(function), capitalize(kind))
    comp = null if component is None else F.concat(capitalize(component), capitalize(kind))
    exp = null if export is None else F.when(export == F.upper(export), export).otherwise(
        F.concat(capitalize(export), capitalize(kind))
    )
    stem = file_stem(path)
    from_path = F.when(~F.lower(stem).isin(*GENERIC_FILE_NAMES), F.concat(capitalize(stem), capitalize(kind)))
    return F.coalesce(own, op_name(content), fn, comp, exp, from_path, name)


def hash_name(name: Column, content: Column) -> Column:
    return F.coalesce(none_if_empty(name), F.concat(F.lit("Query_"), F.substring(F.sha2(content, 256), 1, 10)))


def line_of(text: Column, pos: Column) -> Column:
    """1-based line of the 0-based character offset ``pos``."""
    head = F.substring(text, F.lit(1), pos)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def detect_version(name: Column) -> Column:
    return (
        F.when(name.contains("V3"), "V3").when(name.contains("V2"), "V2").when(name.contains("V1"), "V1")
        .when(name.contains("Latest"), "V3").otherwise("V1")
    )


def suggest_replacement(name: Column) -> Column:
    plain = ~name.rlike("V[0-9]")
    return (
        F.when(plain & name.contains("byId"), F.replace(name, F.lit("byId"), F.lit("byIdV2")))
        .when(plain & name.contains("getUser"), F.replace(name, F.lit("getUser"), F.lit("getUserV2")))
    )


def spread_refs(content: Column) -> Column:
    """Distinct ``...Name`` references in order of first use; inline ``... on`` is none."""
    refs = F.regexp_extract_all(content, F.lit(r"\.\.\.([A-Za-z_]\w*)"), F.lit(1))
    return F.array_distinct(F.filter(refs, lambda r: r != "on"))


def brace_depth(content: Column) -> Column:
    """Deepest nesting: the largest prefix sum of ``{`` = +1 and ``}`` = -1."""
    marks = F.regexp_extract_all(content, F.lit(r"([{}])"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))

    def step(acc, mark):
        at = acc["at"] + F.when(mark == "{", 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(acc["top"], at).alias("top"))

    return F.aggregate(marks, start, step, lambda acc: acc["top"])


def query_pattern(content: Column) -> Column:
    """A subscription, an operation that selects a ``...Connection`` at its root, or a nested query."""
    paged = F.exists(fields(content), lambda f: (f["depth"] == 1) & f["name"].endswith("Connection"))
    return (
        F.when(op_kind(content) == "subscription", "SUBSCRIPTION")
        .when(F.coalesce(paged, F.lit(False)), "PAGINATED_QUERY")
        .otherwise("NESTED_QUERY")
    )


def selection_names(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"(\w+)\s*[:{]"), F.lit(1))


def migration_pattern(old: Column, new: Column) -> Column:
    return (
        F.when(old.contains("edges") & new.contains("nodes"), "EDGE_TO_NODE_MIGRATION")
        .when(old.contains("pageInfo") & ~new.contains("pageInfo"), "PAGINATION_REMOVAL")
        .when(F.size(selection_names(old)) != F.size(selection_names(new)), "FIELD_SELECTION_CHANGE")
        .otherwise("UNKNOWN_PATTERN")
    )


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKEN_PATTERN), F.lit(1))


def return_shape(code: Column) -> Column:
    return (
        F.when(code.contains("return []") | code.contains("return[];"), "empty_array")
        .when(code.rlike(r"""return\s*\[\s*\{\s*type\s*:\s*["']none["']"""), "static_none")
        .when(code.rlike(r"return\s*\[\s*\{\s*\.\.\."), "spread_operator")
        .when(code.rlike(r"return.*?ventureId"), "venture_based")
        .otherwise("dynamic")
    )


def complexity(uses_join: Column, fields: Column, entities: Column, length: Column, conditional: Column) -> Column:
    """Struct of score, level and the factors that scored."""
    # Fixed values: (factor, points).
    tests = (
        ("uses_join_entities", 3, uses_join),
        ("many_fields", 2, fields > 10),
        ("multiple_entities", 2, entities > 1),
        ("long_code", 2, length > 1000),
        ("complex_conditions", 1, conditional),
    )
    score = reduce(lambda a, b: a + b, [F.when(t, p).otherwise(0) for _, p, t in tests])
    level = F.when(score <= 2, "simple").when(score <= 5, "medium").otherwise("complex")
    factors = F.array_compact(F.array(*[F.when(t, n) for n, _, t in tests]))
    return F.struct(score.alias("score"), level.alias("level"), factors.alias("factors"))


def light_complexity(code: Column) -> Column:
    # Fixed values: (word, points) and (length, points).
    words = (("joinEntities", 2), ("filter", 1), ("map", 1), ("find", 1), ("request.query", 1))
    lengths = ((500, 1), (1000, 2))
    score = reduce(
        lambda a, b: a + b,
        [F.when(code.contains(w), p).otherwise(0) for w, p in words]
        + [F.when(F.length(code) > n, p).otherwise(0) for n, p in lengths],
    )
    return F.when(score <= 2, "simple").when(score <= 5, "medium").otherwise("complex")


def construct_class(return_shape: Column, uses_join: Column, score: Column, conditional: Column) -> Column:
    return (
        F.when(return_shape.isin("empty_array", "static_none"), "static_return")
        .when(return_shape == "venture_based", "venture_based")
        .when(uses_join, "entity_join")
        .when(score >= 5, "complex_logic")
        .when(conditional, "conditional_return")
        .otherwise("simple_entity_filter")
    )
