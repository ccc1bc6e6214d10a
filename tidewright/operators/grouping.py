"""Operation groups, set similarity, closure, reconciliation and variants."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators.extraction import once
from tidewright.session import checkpoint, setting


FLOORS = (0.8, 0.5, 0.125, 0.03125)  # similarities at which the top pairs are looked for in turn, where that is cheap
CHEAP = 8  # a floor is tried if its join makes this many times fewer rows than counting all pairs
POSTINGS = 4096  # units in one row of an item's list


def group_items(ops: DataFrame, item: str = "selections") -> DataFrame:
    """Items of each (name, kind) group: ``common`` when every variant has them."""
    sizes = ops.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("_size"))
    items = (
        ops.select("name", "kind", F.explode(F.array_distinct(item)).alias("item"))
        .groupBy("name", "kind", "item").agg(F.count(F.lit(1)).alias("variants"))
    )
    status = F.when(F.col("variants") == F.col("_size"), "common").otherwise("differing")
    return items.join(sizes, ["name", "kind"]).select("name", "kind", "item", "variants", status.alias("status"))


def group_operations(ops: DataFrame, item: str = "selections") -> DataFrame:
    """One row per (name, kind): variants, common and differing item counts."""
    sizes = ops.groupBy("name", "kind").agg(
        F.count(F.lit(1)).alias("variants"), F.countDistinct("file_path").alias("files")
    )
    items = group_items(ops, item).groupBy("name", "kind").agg(
        F.count_if(F.col("status") == "common").alias("common"), F.count_if(F.col("status") == "differing").alias("differing")
    )
    return sizes.join(items, ["name", "kind"], "left").na.fill(0, ["common", "differing"])


def operation_report(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.sum("variants").alias("total"), F.count(F.lit(1)).alias("unique_groups"),
        *[F.count_if(F.col("kind") == k).alias(f"{k}_groups") for k in ("query", "mutation", "subscription")],
        F.count_if(F.col("variants") > 1).alias("duplicate_groups"),
        F.count_if(F.col("name").startswith("unnamed_")).alias("unnamed_groups"),
        ((F.sum("variants") - F.count(F.lit(1))) / F.sum("variants")).alias("duplicate_rate"),
    )


def reference_usage(ops: DataFrame, refs: str) -> DataFrame:
    """Distinct group names that use each reference, most used first."""
    rows = ops.select("name", F.explode(refs).alias("reference")).distinct()
    return rows.groupBy("reference").agg(F.count(F.lit(1)).alias("usage")).orderBy(F.desc("usage"), "reference")


def suggested_name(selections: Column) -> Column:
    """``Get`` + capitalised heads of the first three plain selections."""
    plain = F.slice(F.filter(selections, lambda s: ~s.startswith("...")), 1, 3)
    heads = F.transform(plain, lambda s: T.capitalize(F.element_at(F.split(s, r"\."), 1)))
    return F.when(F.size(plain) > 0, F.concat(F.lit("Get"), F.array_join(heads, "")))


def _ranked_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct sets with tokens ordered rare first; adds ``n`` and ``_toks``.

    Copies of one set are folded to their smallest id before any join.
    """
    keys = list(keys)
    distinct = sets.withColumn("items", F.sort_array(F.array_distinct("items"))).groupBy(*keys, "items").agg(F.min("id").alias("id"))
    tokens = distinct.select(*keys, "id", F.explode("items").alias("token"))
    freq = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(freq, [*keys, "token"]).groupBy(*keys, "id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda s: s["token"]).alias("_toks")
    )
    return ranked.withColumn("n", F.size("_toks"))


def similar_pairs(ranked: DataFrame, keys: Sequence[str], threshold: float, min_common: int = 1) -> DataFrame:
    """All pairs (a < b) of distinct sets with Jaccard >= threshold, exactly.

    Copies are folded before (``_ranked_sets``). Only prefixes of rare tokens are
    joined, and only between sets of the same or the next size band, the only
    ones whose sizes can reach the threshold, so a token most sets hold is
    rarely joined at all. Full sets are fetched for surviving candidates alone.
    """
    keys = list(keys)
    n = F.col("n")
    bound = max(threshold - 1e-12, 1e-12)
    t = F.lit(bound)
    need = F.greatest(F.ceil(n * t).cast("int"), F.lit(max(min_common, 1)))
    prefix = F.greatest(n - need + 1, F.lit(0))
    band = F.floor(F.log(n.cast("double")) / F.lit(max(-math.log(bound), 1e-9)) + 1e-9).cast("bigint")
    rows = ranked.filter(n >= min_common).select(
        *keys, "id", n, band.alias("_band"), F.posexplode(F.slice("_toks", 1, prefix)).alias("_pos", "token")
    )
    left_after = n - F.col("_pos") - 1
    small = rows.select(*keys, "token", "_band", F.col("id").alias("_x"), n.alias("_nx"), left_after.alias("_rx"))
    bands = F.explode(F.array(F.col("_band"), F.col("_band") - 1))
    large = rows.select(*keys, "token", bands.alias("_band"), F.col("id").alias("_y"), n.alias("_ny"), left_after.alias("_ry"))
    fits = (F.col("_nx") >= F.col("_ny") * t) & (
        (F.col("_nx") < F.col("_ny")) | ((F.col("_nx") == F.col("_ny")) & (F.col("_x") < F.col("_y")))
    )
    on = [*keys, "token", "_band"]
    pair = [*keys, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")]
    similarity = lambda common, nx, ny: common / (nx + ny - common)
    hits = small.join(large, on).filter(fits).groupBy(*keys, "_x", "_y", "_nx", "_ny").agg(
        F.count(F.lit(1)).alias("common"), F.min("_rx").alias("_rx"), F.min("_ry").alias("_ry")
    )
    # Shared prefix tokens plus what can still match after the last of them
    # bounds the overlap; pairs that cannot reach the threshold end here.
    reach = F.greatest(F.ceil((F.col("_nx") + F.col("_ny")) * F.lit(bound / (1 + bound)) - 1e-9), F.lit(max(min_common, 1)))
    cand = hits.filter(F.col("common") + F.least("_rx", "_ry") >= reach).select(*keys, "_x", "_y", "_nx", "_ny")
    left = ranked.select(*keys, F.col("id").alias("_x"), F.col("_toks").alias("_tx"))
    right = ranked.select(*keys, F.col("id").alias("_y"), F.col("_toks").alias("_ty"))
    both = once(cand.join(left, [*keys, "_x"]).join(right, [*keys, "_y"]), common=F.size(F.array_intersect("_tx", "_ty")))
    out = both.select(*pair, F.col("common").cast("bigint").alias("common"), similarity(F.col("common"), F.col("_nx"), F.col("_ny")).alias("similarity"))
    return out.filter((F.col("similarity") >= t) & (F.col("common") >= min_common))


def _prefix_costs(ranked: DataFrame, floors: Sequence[float], min_common: int) -> list[int]:
    """Rows that the join of :func:`similar_pairs` at each floor makes, without its other bounds, and last those of all items."""
    n, least = F.col("n"), F.lit(max(min_common, 1))
    rows = ranked.filter(n >= min_common).select("n", F.posexplode("_toks").alias("_pos", "token"))
    held = [F.count_if(F.col("_pos") <= n - F.greatest(F.ceil(n * F.lit(f - 1e-12)), least)).cast("double") for f in floors]
    counts = rows.groupBy("token").agg(*[h.alias(f"_c{i}") for i, h in enumerate([*held, F.count(F.lit(1)).cast("double")])])
    found = counts.agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in counts.columns if c != "token"]).first()
    return [x or 0 for x in found]


def counted_pairs(ranked: DataFrame, min_common: int = 1) -> DataFrame:
    """All pairs (a < b) of sets with at least ``min_common`` shared items, counted over all items: no candidate is fetched to be verified.

    An item's units are lists of at most about ``POSTINGS``. A unit's later partners leave the item's task as one array, and are counted where the unit
    is, so that neither single meetings nor sets are shuffled.
    """
    tokens = ranked.filter(F.col("id").isNotNull() & (F.col("n") >= min_common)).select("id", F.explode(F.array_distinct("_toks")).alias("token"))
    often = tokens.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / POSTINGS).alias("_parts")).filter("_parts > 1")
    salt = F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1)))
    lists = checkpoint(tokens.join(often, "token", "left").groupBy("token", salt.alias("_salt")).agg(F.collect_list("id").alias("ids")).select("token", "ids"))
    met = lists.join(lists.select("token", F.col("ids").alias("_others")), "token").select(F.explode("ids").alias("a"), "_others")
    later = once(met, _later=F.filter("_others", lambda o: o > F.col("a"))).select("a", "_later")
    found = later.repartition("a").select("a", F.explode("_later").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    size = lambda k: ranked.select(F.col("id").alias(k), F.col("n").alias(f"_n{k}"))
    both = found.filter(F.col("common") >= max(min_common, 1)).join(size("a"), "a").join(size("b"), "b")
    return both.select("a", "b", "common", (F.col("common") / (F.col("_na") + F.col("_nb") - F.col("common"))).alias("similarity"))


def pairwise_overlap(sets: DataFrame, min_common: int = 3, top: int = 20) -> DataFrame:
    """The ``top`` most similar unit pairs with at least ``min_common`` shared items.

    ``sets``: id, items. Pairs of units with equal sets come first. For the rest the exact join runs at a high similarity first
    and at the next lower one only while fewer than ``top`` pairs are found: what is above a floor is complete, so
    the top pairs are final as soon as there are enough. Floors whose join would make about as many rows as counting all pairs are
    left out, and where no floor gives enough pairs all are counted.
    """
    full = checkpoint(sets.select("id", F.sort_array(F.array_distinct("items")).alias("items")).filter(F.size("items") > 0))
    # Equal sets: within a group of copies the first ids give enough top pairs.
    w = Window.partitionBy("items").orderBy("id")
    firsts = full.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top + 1)
    same = firsts.filter(F.size("items") >= min_common).alias("l").join(firsts.alias("r"), "items").filter("l.id < r.id").select(
        F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.size("items").cast("bigint").alias("common"), F.lit(1.0).alias("similarity")
    )
    ranked = checkpoint(_ranked_sets(full, []))
    # A pair of representatives comes before all pairs of their copies, so the first ``top`` of them lead to the first ``top`` of all.
    first = lambda pairs: checkpoint(pairs.orderBy(F.desc("similarity"), "a", "b").limit(top))
    *costs, whole = _prefix_costs(ranked, FLOORS, min_common)
    for floor, cost in zip(FLOORS, costs, strict=True):
        if cost * CHEAP <= whole:
            rest = first(similar_pairs(ranked, [], floor, min_common))
            if rest.count() >= top:
                break
    else:
        rest = first(counted_pairs(ranked, min_common))
    # Members of equal-set groups stand in for their representative.
    rep = full.groupBy("items").agg(F.min("id").alias("_rep"))
    members = firsts.join(rep, "items").select(F.col("_rep"), F.col("id").alias("_m"))
    spread = (
        rest.join(members.select(F.col("_rep").alias("a"), F.col("_m").alias("_ma")), "a")
        .join(members.select(F.col("_rep").alias("b"), F.col("_m").alias("_mb")), "b")
        .select(F.least("_ma", "_mb").alias("a"), F.greatest("_ma", "_mb").alias("b"), "common", "similarity")
    )
    return same.unionByName(spread).orderBy(F.desc("similarity"), "a", "b").limit(top)


def group_similar(ops: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Greedy leader groups in id order, per kind: ``id, kind, leader``.

    An op joins the first leader at Jaccard >= threshold, else it leads. Equal
    sets share their first op's fate, so only distinct sets are compared. Leaders
    settle in rounds: an op leads once no earlier neighbour can still lead.
    """
    sets = ops.select("id", "kind", F.sort_array(F.array_distinct("items")).alias("items"))
    folded = checkpoint(sets.groupBy("kind", "items").agg(F.min("id").alias("rep")))
    nonempty = folded.filter(F.size("items") > 0).select("kind", F.col("rep").alias("id"), "items")
    edges = checkpoint(similar_pairs(_ranked_sets(nonempty, ["kind"]), ["kind"], threshold).select("kind", "a", "b"))
    state = checkpoint(folded.select("kind", F.col("rep").alias("id"), F.lit("open").alias("state")))
    while not state.filter("state = 'open'").isEmpty():
        earlier = edges.join(state.select("kind", F.col("id").alias("a"), F.col("state").alias("_s")), ["kind", "a"]).groupBy(
            "kind", F.col("b").alias("id")
        ).agg(F.count_if(F.col("_s") == "leader").alias("_lead"), F.count_if(F.col("_s") == "open").alias("_open"))
        s = F.col("state")
        nxt = (
            F.when(s != "open", s).when(F.coalesce("_lead", F.lit(0)) > 0, "member")
            .when(F.coalesce("_open", F.lit(0)) == 0, "leader").otherwise("open")
        )
        state = checkpoint(state.join(earlier, ["kind", "id"], "left").select("kind", "id", nxt.alias("state")))
    leaders = state.filter("state = 'leader'").select("kind", F.col("id").alias("a"))
    joined = edges.join(leaders, ["kind", "a"]).groupBy("kind", F.col("b").alias("id")).agg(F.min("a").alias("_l"))
    of = state.join(joined, ["kind", "id"], "left").select(
        "kind", F.col("id").alias("rep"), F.when(F.col("state") == "leader", F.col("id")).otherwise(F.col("_l")).alias("leader")
    )
    return sets.join(folded, ["kind", "items"]).join(of, ["kind", "rep"]).select("id", "kind", "leader")


# Frames that lie by a key keep to it when they are stored and joined: adaptive plans do not tell where their rows lie.
IN_PLACE = {"spark_sql_adaptive_enabled": "false", "spark_sql_requireAllClusterKeysForCoPartition": "false"}


def reference_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node``: everything reachable from each root, cycles included once.

    Rounds go on until one finds nothing new. A round stores only what it found. Edges lie by source and finds by node, in as many parts, and
    both stay there: a find is shuffled once, to where it is compared with earlier finds and meets its edges in the next round.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, **IN_PLACE):
        edges = checkpoint(edges.select("src", "dst").filter("src IS NOT NULL").repartition(parts, "src").distinct())
        frontier = checkpoint(roots.select(F.col("node").alias("root"), "node").repartition(parts, "node").distinct())
        found = [frontier]
        while True:
            step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).repartition(parts, "node").distinct()
            for earlier in found:
                step = step.join(earlier, ["node", "root"], "left_anti")
            frontier = checkpoint(step.select("root", "node"))
            if frontier.isEmpty():
                return reduce(DataFrame.unionByName, found)
            found.append(frontier)


def missing_references(closure: DataFrame, names: DataFrame) -> DataFrame:
    return closure.join(names.select("node").distinct(), "node", "left_anti").select("root", "node")


def inline_references(ops: DataFrame, fragments: DataFrame, mode: str = "append") -> DataFrame:
    """Bodies of every reference an operation reaches, appended or in place.

    ``ops``: id, content. ``fragments``: seq, name, type_name, body, content.
    """
    refs = T.spread_refs
    edges = fragments.select(F.col("name").alias("src"), F.explode(refs(F.col("content"))).alias("dst"))
    if mode == "append":
        direct = ops.select("id", F.explode(refs(F.col("content"))).alias("name"))
        used = direct.select(F.col("name").alias("node")).distinct()
        reach = reference_closure(edges, used)
        bodies = (
            direct.join(reach, direct["name"] == reach["root"]).select("id", "node").distinct()
            .join(fragments.select(F.col("name").alias("node"), "seq", "content"), "node")
            .groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda s: s["content"]).alias("_b"))
        )
        text = F.concat(F.col("content"), F.coalesce(F.concat(F.lit("\n\n"), F.array_join("_b", "\n\n")), F.lit("")))
        return ops.join(bodies, "id", "left").select("id", text.alias("content"))
    if mode != "inline":
        raise ValueError(f"unknown mode {mode}")
    # A spread inside an inlined body carries the names it is inside of, between two control characters; one that names any of
    # them is part of a cycle and stays. Directives of a spread go before the braces.
    mark = "(?:\x01([^\x02]*)\x02)?"
    spread = rf"\.\.\.([A-Za-z_]\w*){mark}"
    body = F.replace(F.replace(F.col("body"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    known = fragments.select("name", "type_name", body.alias("_body"))
    state = checkpoint(ops.select("id", "content"))
    while True:
        found = F.transform(F.regexp_extract_all("content", F.lit(spread), F.lit(0)), lambda m: F.struct(
            F.regexp_extract(m, spread, 1).alias("name"), F.regexp_extract(m, spread, 2).alias("inside")))
        open_ = F.filter(F.array_distinct(found), lambda m: (m["name"] != "on") & ~F.array_contains(F.split(m["inside"], ","), m["name"]))
        path = F.concat_ws(",", F.when(F.col("inside") != "", F.col("inside")), "name")
        inner = F.regexp_replace("_body", r"\.\.\.(?!on\b)([A-Za-z_]\w*)", F.concat(F.lit("...$1\x01"), path, F.lit("\x02")))
        fills = state.select("id", F.inline(open_)).join(known, "name").select(
            "id", F.struct("name", "inside", F.concat(F.lit("... on "), "type_name", F.lit("$1 { "), inner, F.lit(" }")).alias("value")).alias("_v")
        ).groupBy("id").agg(F.sort_array(F.collect_list("_v")).alias("_f"))

        def swap(acc, f):
            tag = F.when(f["inside"] == "", F.lit("(?!\x01)")).otherwise(F.concat(F.lit("\x01"), f["inside"], F.lit("\x02")))
            directives = r"((?:\s*@\w+(?:\([^)]*\))?)*)"
            return F.regexp_replace(acc, F.concat(F.lit(r"\.\.\."), f["name"], F.lit(r"(?![A-Za-z0-9_])"), tag, F.lit(directives)), f["value"])

        step = checkpoint(state.join(fills, "id", "left").select(
            "id", F.coalesce(F.aggregate("_f", F.col("content"), swap), "content").alias("content"), F.col("_f").isNotNull().alias("_more")))
        state = step.drop("_more")
        if step.filter("_more").isEmpty():
            return state.select("id", F.regexp_replace("content", "\x01[^\x02]*\x02", "").alias("content"))


def reconcile(before: DataFrame, after: DataFrame, strict: bool = False) -> DataFrame:
    """Issues between two operation sets: ``key, type, severity``.

    Both have ``key`` (fingerprint or ``path:name``), name, content, kind and
    optionally has_interpolation on the after side.
    """
    side = lambda df, p: df.select("key", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "key"], F.lit(True).alias(f"_{p}"))
    both = side(before, "b").join(side(after, "a"), "key", "full_outer")
    plain = lambda c: T.normalize_text(c, comments=False)
    soft = "error" if strict else "warning"
    matched = F.col("_b").isNotNull() & F.col("_a").isNotNull()

    def issue(test, kind, level):
        return F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity")))

    issues = [
        issue(F.col("_a").isNull(), "missing", "error"),
        issue(F.col("_b").isNull(), "extra", "warning"),
        issue(matched & ~F.col("b_name").eqNullSafe(F.col("a_name")), "naming", soft),
        issue(matched & (plain(F.col("b_content")) != plain(F.col("a_content"))), "structural", soft),
        issue(matched & ~F.col("b_kind").eqNullSafe(F.col("a_kind")), "kind", "error"),
    ]
    if "has_interpolation" in after.columns:
        issues.append(issue(matched & (T.has_interpolation(F.col("b_content")) != F.col("a_has_interpolation")), "interpolation", "warning"))
    return both.select("key", F.inline(F.array_compact(F.array(*issues))))


def reconcile_status(issues: DataFrame) -> DataFrame:
    counts = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    status = F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed")
    return counts.withColumn("status", status)


def expand_variants(ops: DataFrame, switches: DataFrame) -> DataFrame:
    """Every combination of an operation's switch values, with the text filled.

    ``switches``: id, seq, variable, choices. Combination i picks the digits of
    i in mixed radix; the last switch turns fastest.
    """
    usable = switches.filter(F.size("choices") > 0)
    per_op = usable.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "variable", "choices"))).alias("_s"))
    total = F.aggregate("_s", F.lit(1).cast("bigint"), lambda acc, s: acc * F.size(s["choices"]))
    # Numbers are dealt out by their high part first: no row holds all combinations, and no task has to make them.
    block = F.lit(1 << 12).cast("bigint")
    high = ops.join(per_op, "id").withColumn("_total", total).withColumn("_high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_total") - 1) / block))))
    low = F.sequence(F.col("_high") * block, F.least(F.col("_total"), (F.col("_high") + 1) * block) - 1)
    rows = high.repartition("id", "_high").withColumn("variant_no", F.explode(low)).drop("_total", "_high")
    empty = F.array().cast("array<struct<variable:string,value:string>>")

    def digit(acc, s):
        pick = F.struct(s["variable"].alias("variable"), F.get(s["choices"], (acc["rest"] % F.size(s["choices"])).cast("int")).alias("value"))
        return F.struct(
            F.call_function("div", acc["rest"], F.size(s["choices"])).alias("rest"),
            F.concat(F.array(pick), acc["picked"]).alias("picked"),
        )

    start = F.struct(F.col("variant_no").alias("rest"), empty.alias("picked"))
    rows = rows.withColumn("_picked", F.aggregate(F.reverse("_s"), start, digit, lambda acc: acc["picked"]))

    def fill(acc, p):
        either = F.concat(F.lit(r"\$\{\s*"), p["variable"], F.lit(r"\s*\?\s*'([^']*)'\s*:\s*'([^']*)'\s*\}"))
        chosen = F.when(p["value"] == "true", F.lit("$1")).otherwise(F.lit("$2"))
        return F.replace(F.regexp_replace(acc, either, chosen), F.concat(F.lit("${"), p["variable"], F.lit("}")), p["value"])

    return rows.select(
        "id", "variant_no",
        F.array_join(F.transform("_picked", lambda p: F.concat(p["variable"], F.lit("="), p["value"])), ", ").alias("condition"),
        F.aggregate("_picked", F.col("content"), fill).alias("content"),
    )


def variant_report(switches: DataFrame) -> DataFrame:
    """Ids with variants and the sum of their combination counts."""
    per_op = switches.filter(F.size("choices") > 0).groupBy("id").agg(
        F.aggregate(F.collect_list(F.size("choices")), F.lit(1).cast("bigint"), lambda acc, n: acc * n).alias("combinations")
    )
    return per_op.agg(F.count(F.lit(1)).alias("ids_with_variants"), F.sum("combinations").alias("combinations"))


def condition_usage(switches: DataFrame) -> DataFrame:
    return switches.groupBy("variable").agg(
        F.countDistinct("id").alias("ids"), F.max(F.size("choices")).alias("choices")
    )
