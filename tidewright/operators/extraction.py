"""Mining operations and field accesses out of text tables.

Every scan reads its text once: the branches of a miner are arrays of structs
on the same row, exploded together, so no branch re-reads the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.functions.selections import fields
from tidewright.functions.rules import normalize_prefix
from tidewright.operators.ordered import rank_rows
from tidewright.session import checkpoint

# The access patterns. Variable-name hints are an argument.
# Java tries ``[\s\S]`` many times slower than a dot that takes line ends, and a word again from each of its letters unless told not to.
PICK = r"entityPick\s*\(\s*(\w+)\s*,\s*\[((?s:.*?))\]\s*\)"
QUOTED = r"""['"`]([^'"`]+)['"`]"""
REQUEST = r"profile\.request\.query\.(\w+)"
DIRECT = r"(\w+)\.([a-zA-Z0-9_.?]+)(?:\s*[=!<>]|\s*\?\?|\s*&&|\s*\|\||\s*\))"
DIRECT_ONCE = r"(?<!\w)(\w++)\.([a-zA-Z0-9_.?]+)\s*+(?:[=!<>)]|\?\?|&&|\|\|)"  # DIRECT, each word tried once
DESTRUCTURE = r"const\s*\{([^}]+)\}\s*=\s*(\w+)"
ENTITY_TYPE = r"""entity\.type\s*===\s*['"`](\w+)['"`]"""
AFTER_TYPE = ENTITY_TYPE + r"((?s:.*))"
ANY_TYPE = r"""(?<!\w)(\w++)\.type\s*===\s*['"`](\w+)['"`]"""
JOIN_CONDITION = r"joinEntities.*?\((.*?)\)\s*=>\s*\(((?s:.*?))\)"
JOIN_KEY = r"(\w+)\.(\w+)\s*===\s*(\w+)\.(\w+)"


def all_matches(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def extract_blocks(df: DataFrame, text: str, pattern: str, group: int = 1) -> DataFrame:
    """One row per tagged block of a text, numbered from 0 in text order."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(all_matches(F.col(text), pattern, group)).alias("block_no", "block"))


def merge_strategies(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of ``primary`` for the keys it has, rows of ``fallback`` for the rest."""
    return primary.unionByName(fallback.join(primary.select(key), key, "left_anti"))


def _entity_of(first: Column, rest: Column, checks: Column, var: Column, hints) -> Column:
    hinted = F.lit(None).cast("string")
    for word, entity in reversed(hints):
        hinted = F.when(F.lower(var).contains(word), entity).otherwise(hinted)
    on_var = F.get(F.filter(checks, lambda c: c["v"].endswith(var)), 0)["t"]
    return F.coalesce(F.when((first != "") & rest.contains(var), first), on_var, hinted, F.lit("unknown"))


def _type_checks(code: Column) -> Column:
    checks = F.when(code.contains(".type") | code.isNull(), all_matches(code, ANY_TYPE, 0)).otherwise(F.array().cast("array<string>"))
    return F.transform(
        checks,
        lambda m: F.struct(F.regexp_extract(m, ANY_TYPE, 1).alias("v"), F.regexp_extract(m, ANY_TYPE, 2).alias("t")),
    )


def infer_entity(code: Column, var: Column, hints: Sequence[tuple[str, str]] = ()) -> Column:
    """Type equality before the variable, then on it, then a name hint."""
    return _entity_of(F.regexp_extract(code, AFTER_TYPE, 1), F.regexp_extract(code, AFTER_TYPE, 2), _type_checks(code), var, hints)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns computed exactly once per row: the one-row generator keeps
    the optimizer from copying them into each later use."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(packed))


def mine_access(df: DataFrame, unit: str, text: str, prefix_map: Sequence[tuple[str, str]] = (), hints: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Field accesses of list-pick calls, dotted property use and destructuring."""
    code = F.col(text)
    group = F.regexp_extract

    def access(var, field, method):
        return F.struct(var.alias("var"), field.alias("field"), F.lit(method).alias("access_method"))

    picks = F.flatten(
        F.transform(
            F.transform(
                all_matches(code, PICK, 0),
                lambda m: F.struct(
                    group(m, PICK, 1).alias("v"),
                    F.regexp_extract_all(group(m, PICK, 2), F.lit(QUOTED), F.lit(1)).alias("fs"),
                ),
            ),
            lambda p: F.transform(p["fs"], lambda f: access(p["v"], f, "pick")),
        )
    )
    request = F.transform(
        all_matches(code, REQUEST), lambda f: access(F.lit("profile"), F.concat(F.lit("request.query."), f), "direct")
    )
    direct = F.filter(
        F.transform(
            all_matches(code, DIRECT_ONCE, 0),
            lambda m: access(group(m, DIRECT_ONCE, 1), F.replace(group(m, DIRECT_ONCE, 2), F.lit("?."), F.lit(".")), "direct"),
        ),
        lambda a: ~a["var"].isin(*T.ACCESS_STOP_NAMES),
    )
    opened = F.flatten(
        F.transform(
            all_matches(code, DESTRUCTURE, 0),
            lambda m: F.transform(
                F.filter(
                    F.transform(F.split(group(m, DESTRUCTURE, 1), ","), lambda p: F.trim(F.element_at(F.split(p, ":"), 1))),
                    lambda f: (f != "") & ~f.startswith("{"),
                ),
                lambda f: access(group(m, DESTRUCTURE, 2), f, "destructuring"),
            ),
        )
    )
    found = once(
        df.select(F.col(unit).alias("unit"), code),
        _hits=F.concat(picks, request, direct, opened), _first=group(code, AFTER_TYPE, 1),
        _rest=group(code, AFTER_TYPE, 2), _checks=_type_checks(code),
    )
    # One entity per distinct variable of a text; the text itself is not exploded.
    named = once(found.select("unit", "_hits", "_first", "_rest", "_checks"), _vars=F.array_distinct(F.col("_hits.var")))
    known = once(
        named,
        _entities=F.transform(
            "_vars", lambda v: _entity_of(F.col("_first"), F.col("_rest"), F.col("_checks"), v, hints)
        ),
    )
    rows = known.select("unit", "_vars", "_entities", F.inline("_hits"))
    entity = F.when(F.col("field").startswith("request.query."), "profile").otherwise(
        F.get("_entities", (F.array_position("_vars", F.col("var")) - 1).cast("int"))
    )
    return rows.select(
        "unit", "field", normalize_prefix(F.col("field"), prefix_map).alias("normalized"),
        entity.alias("entity_type"), "access_method",
    )


def mine_join_keys(df: DataFrame, unit: str, text: str) -> DataFrame:
    """``left, right`` key pairs of each text's first join condition."""
    cond = F.regexp_extract(F.col(text), JOIN_CONDITION, 2)
    pairs = F.arrays_zip(*[all_matches(cond, JOIN_KEY, i).alias(n) for i, n in enumerate(("lv", "lf", "rv", "rf"), 1)])
    rows = df.select(F.col(unit).alias("unit"), F.inline(pairs))
    return rows.select("unit", F.concat_ws(".", "lv", "lf").alias("left"), F.concat_ws(".", "rv", "rf").alias("right"))


def joined_entities(text: Column) -> Column:
    return all_matches(F.regexp_extract(text, JOIN_CONDITION, 2), ANY_TYPE, 2)


def entity_types(text: Column) -> Column:
    return F.array_distinct(all_matches(text, r"""type\s*===\s*['"`](\w+)['"`]"""))


def profile_snippets(df: DataFrame, unit: str, text: str) -> DataFrame:
    """Per text: distinct fields, entities, flags, return shape, complexity."""
    code = F.col(text)
    fields = mine_access(df, unit, text).groupBy("unit").agg(F.countDistinct("normalized").alias("fields"))
    base = df.select(
        F.col(unit).alias("unit"),
        F.size(entity_types(code)).alias("entities"),
        code.contains("joinEntities").alias("uses_join"),
        (code.contains("if") | code.contains("?")).alias("conditional"),
        code.contains("...").alias("uses_spread"),
        code.contains("?.").alias("optional_chaining"),
        F.length(code).alias("length"),
        T.return_shape(code).alias("return_shape"),
        T.light_complexity(code).alias("light_level"),
    )
    joined = base.join(fields, "unit", "left").withColumn("fields", F.coalesce("fields", F.lit(0)))
    scored = joined.withColumn(
        "c", T.complexity(F.col("uses_join"), F.col("fields"), F.col("entities"), F.col("length"), F.col("conditional"))
    )
    return scored.select(
        "*", F.col("c.score").alias("score"), F.col("c.level").alias("level"), F.col("c.factors").alias("factors"),
        T.construct_class(F.col("return_shape"), F.col("uses_join"), F.col("c.score"), F.col("conditional")).alias("construct"),
    ).drop("c")


def uniquify_names(df: DataFrame, name: str, body: str, order: str) -> DataFrame:
    """Same name, same body: name kept. Each further body gets ``_1, _2 …``.

    Bodies are folded to (name, fingerprint) with their first position, and the
    ranking is spread over ranges, so neither copies of one body nor the bodies
    of one name meet in a single task.
    """
    fp = F.md5(T.normalize_text(F.col(body), placeholder=None))
    keyed = df.withColumn("_fp", fp)
    bodies = checkpoint(keyed.filter(F.col(name) != "").groupBy(F.col(name).alias("_name"), "_fp").agg(F.min(order).alias("_first")))
    ranked = rank_rows(bodies, ["_name"], "_first").select("_name", "_fp", "_first", (F.col("rank") - 1).alias("_suffix"))
    given = bodies.select(F.col("_name").alias("_made")).distinct()
    fixed = ranked.filter("_suffix = 0").select("_name", "_fp", F.col("_name").alias("unique_name"))
    waiting, taken = checkpoint(ranked.filter("_suffix > 0").select("_name", "_fp", "_first", "_suffix")), given
    while not waiting.isEmpty():
        # a made name that is given, or made before for another name, moves on to the next number
        tried = waiting.withColumn("_made", F.concat("_name", F.lit("_"), F.col("_suffix").cast("string")))
        winner = tried.groupBy("_made").agg(F.min(F.struct("_first", "_name", "_fp")).alias("_w"))
        free = winner.join(taken, "_made", "left_anti").select(F.col("_made").alias("_free"), "_w")
        judged = checkpoint(tried.join(free, F.col("_made") == F.col("_free"), "left").withColumn(
            "_ok", F.coalesce((F.col("_w._name") == F.col("_name")) & (F.col("_w._fp") == F.col("_fp")), F.lit(False))))
        done = judged.filter("_ok").select("_name", "_fp", F.col("_made").alias("unique_name"))
        fixed, taken = fixed.unionByName(done), taken.union(done.select("unique_name"))
        top = judged.groupBy("_name").agg(F.max("_suffix").alias("_top"))
        left = judged.filter("NOT _ok").select("_name", "_fp", "_first").join(top, "_name")
        waiting = rank_rows(left, ["_name"], "_first").select("_name", "_fp", "_first", (F.col("_top") + F.col("rank")).alias("_suffix"))
    named = fixed.select(F.col("_name").alias("_n"), F.col("_fp").alias("_f"), "unique_name")
    joined = keyed.join(named, (F.col(name) == F.col("_n")) & (F.col("_fp") == F.col("_f")), "left")
    return joined.withColumn("unique_name", F.coalesce("unique_name", F.col(name))).drop("_fp", "_n", "_f")


def name_from_field(root: Column, kind: Column, stem: Column, significant: Column | None = None) -> Column:
    """Generated name: kind prefix and the main root field, else the file stem."""
    # Prefixes per kind, generic roots, file-name affixes.
    prefix = F.when(kind == "mutation", "Update").when(kind == "subscription", "Subscribe").otherwise("Get")

    def pascal(col):
        words = F.filter(F.split(col, r"[-_\s]+"), lambda w: w != "")
        return F.array_join(F.transform(words, T.capitalize), "")

    sub = F.lit(None).cast("string") if significant is None else significant
    base = (
        F.when(root.isin("user", "me", "viewer"), F.concat(F.lit("Get"), F.coalesce(pascal(sub), F.lit("User"))))
        .when(root.contains("By") | root.startswith("get") | root.startswith("find"), pascal(root))
        .otherwise(F.concat(F.lit("Get"), pascal(root)))
    )
    clean = F.regexp_replace(F.regexp_replace(stem, r"(?i)[-_]quer(y|ies?)$|(?i)[-_]graphql$", ""), r"(?i)^graphql[-_]", "")
    from_root = F.when(base.startswith(prefix), base).otherwise(F.concat(prefix, base))
    return F.when(root.isNotNull() & (root != ""), from_root).when(
        clean != "", F.concat(prefix, pascal(clean))
    ).otherwise(F.concat(prefix, F.lit("Operation")))


# Root fields that say nothing about an operation.
GENERIC_ROOTS = ("user", "me", "viewer")


def root_field(content: Column) -> Column:
    """The main root field: the last one that is not generic, else the last one."""
    roots = F.transform(F.filter(fields(content), lambda f: f["depth"] == 1), lambda f: f["name"])
    telling = F.filter(roots, lambda n: ~n.isin(*GENERIC_ROOTS))
    return F.coalesce(F.try_element_at(telling, F.lit(-1)), F.try_element_at(roots, F.lit(-1)))


def standardize(df: DataFrame, endpoint: str = "default") -> DataFrame:
    """Fixed public row with defaults for what is missing."""
    def col(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    content = F.col("content")
    name = T.hash_name(F.col("name"), content)
    return df.select(
        F.coalesce(F.col("id").cast("string"), name).alias("id"),
        name.alias("query_name"),
        content.alias("content"),
        col("file_path", "unknown.js").alias("file_path"),
        col("line", 1).alias("line_number"),
        F.coalesce(T.op_kind(content), F.lit("query")).alias("type"),
        col("endpoint", endpoint).alias("endpoint"),
        col("source", "ast").alias("source"),
        F.array_join(T.spread_refs(content), ",").alias("fragments"),
        content.rlike(r"\$[A-Za-z_]\w*\s*:").alias("has_variables"),
    )


def normalize_deep(df: DataFrame, field: str, exact: DataFrame) -> DataFrame:
    """Exact lookup ``field -> normalized`` with the field itself as fall-through."""
    return df.join(exact, field, "left").withColumn("normalized", F.coalesce("normalized", field))


def resolve_templates(df: DataFrame, id_col: str, body: str, bodies: DataFrame, max_rounds: int = 5) -> DataFrame:
    """Replaces ``${name}`` by its body and conditional spreads by their first
    known alternative until nothing changes or ``max_rounds`` is reached.

    ``bodies`` has ``name, text``. Each round joins the distinct names a text
    uses, so the dictionary is neither collected nor broadcast by force.
    """
    state = checkpoint(df.select(F.col(id_col).alias("_id"), F.col(body).alias("_t")))
    spread = r"\.\.\.\$\{\s*[^}?]*\?\s*'?\"?(\w+)'?\"?\s*:\s*'?\"?(\w+)'?\"?\s*\}"
    for _ in range(max_rounds):
        plain = F.transform(
            all_matches(F.col("_t"), r"\$\{(\w+)\}"),
            lambda n: F.struct(F.concat(F.lit("${"), n, F.lit("}")).alias("hole"), n.alias("name"), F.lit(0).alias("rank"), F.lit(False).alias("spread")),
        )
        either = F.flatten(
            F.transform(
                F.arrays_zip(
                    all_matches(F.col("_t"), f"({spread})", 1).alias("hole"),
                    all_matches(F.col("_t"), spread, 1).alias("a"),
                    all_matches(F.col("_t"), spread, 2).alias("b"),
                ),
                lambda m: F.array(
                    F.struct(m["hole"].alias("hole"), m["a"].alias("name"), F.lit(0).alias("rank"), F.lit(True).alias("spread")),
                    F.struct(m["hole"].alias("hole"), m["b"].alias("name"), F.lit(1).alias("rank"), F.lit(True).alias("spread")),
                ),
            )
        )
        holes = state.select("_id", F.inline(F.array_distinct(F.concat(plain, either))))
        known = holes.join(bodies.select("name", F.col("text").alias("_body")), "name", "left")
        chosen = known.groupBy("_id", "hole", "spread").agg(
            F.min_by(F.struct("name", "_body"), F.struct(F.col("_body").isNull(), F.col("rank"))).alias("pick")
        )
        value = F.when(F.col("spread"), F.concat(F.lit("..."), F.col("pick.name"))).otherwise(F.col("pick._body"))
        fills = (
            chosen.select("_id", "hole", value.alias("value"))
            .filter(F.col("value").isNotNull())
            .groupBy("_id")
            .agg(F.sort_array(F.collect_list(F.struct("hole", "value"))).alias("_fills"))
        )
        filled = F.aggregate(F.col("_fills"), F.col("_t"), lambda acc, f: F.replace(acc, f["hole"], f["value"]))
        new = F.coalesce(filled, F.col("_t"))
        step = checkpoint(
            state.join(fills, "_id", "left").select("_id", new.alias("_t"), (new != F.col("_t")).alias("_changed"))
        )
        state = step.select("_id", "_t")
        if step.filter("_changed").isEmpty():
            break
    return state.select(F.col("_id").alias(id_col), F.col("_t").alias(body))


# Probe values per contract type, as JSON text.
EDGE_VALUES = {
    "string": ('""', '"a"', "null"),
    "int": ("0", "1", "-1", "2147483647", "-2147483648", "null"),
    "float": ("0.0", "1.0", "-1.0", "0.00000001", "999999999.99", "null"),
    "boolean": ("true", "false", "null"),
    "id": ('"1"', '"0"', '"abc123"', '"ffffffff-ffff-ffff-ffff-ffffffffffff"', '""', "null"),
    "array": ("[]", '["item"]', '["item1","item2"]', "null"),
    "object": ("{}", '{"key":"value"}', "null"),
}


def edge_values(variables: DataFrame, name: str, dtype: str) -> DataFrame:
    """Each variable crossed with the probe values of its type."""
    t = F.lower(F.col(dtype))
    t = F.when(t == "integer", "int").when(t == "number", "float").otherwise(t)
    values = F.lit(None).cast("array<string>")
    for kind, probes in EDGE_VALUES.items():
        probes = list(probes)
        if kind == "string":
            probes.insert(2, '"' + "A very long string that might cause issues in some systems" * 10 + '"')
        if kind == "array":
            probes.insert(3, "[" + ",".join(['"item"'] * 100) + "]")
        values = F.when(t == kind, F.array(*[F.lit(p) for p in probes])).otherwise(values)
    return variables.select(
        name, dtype, F.posexplode(F.coalesce(values, F.array(F.lit("null")))).alias("probe_no", "probe")
    )


def common_keys(examples: DataFrame, id_col: str, payload: str, share: float = 0.5) -> DataFrame:
    """Keys of JSON objects seen in at least ``share`` of the rows, with the JSON types of their values."""
    total = examples.agg(F.count(F.lit(1)).alias("_n"))
    members = F.explode(F.from_json(payload, "map<string,variant>")).alias("key", "_v")
    typed = examples.select(F.col(id_col).alias("_id"), members).withColumn("_t", F.schema_of_variant("_v"))
    kind = (
        F.when(F.col("_t") == "STRING", "string").when(F.col("_t") == "BOOLEAN", "boolean")
        .when(F.col("_t").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number").when(F.col("_t").startswith("ARRAY"), "array").otherwise("object")
    )
    pairs = typed.withColumn("value", F.variant_get("_v", "$", "string"))
    keys = pairs.groupBy("key").agg(
        F.count(F.lit(1)).alias("examples"),
        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("types"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("_id"))).alias("sample"),
    )
    return keys.join(total, how="inner").filter(F.col("examples") >= F.col("_n") * share).drop("_n")


def dedupe_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """First row per key in ``order``; the fold combines on the map side."""
    cols = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def duplicate_groups(df: DataFrame, fp: Column, id_col: str) -> DataFrame:
    """Groups of equal fingerprints: size and first member, members as rows apart."""
    return (
        df.groupBy(fp.alias("fingerprint"))
        .agg(F.count(F.lit(1)).alias("members"), F.min(id_col).alias("first_id"))
        .filter(F.col("members") > 1)
    )


def duplicate_members(df: DataFrame, fp: Column, id_col: str) -> DataFrame:
    groups = duplicate_groups(df, fp, id_col)
    return df.select(F.col(id_col), fp.alias("fingerprint")).join(groups, "fingerprint")
