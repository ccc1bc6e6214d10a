"""Field-usage analytics over one access fact.

``access`` has the columns ``unit, field, normalized, entity_type,
access_method``. Every report first folds it to counts per key with a map-side
combine, so a field that holds a third of all rows adds one partial row per
task to the shuffle. Lists whose length grows with the data (the users of a
field) are kept as rows, never collected into one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpoint


def field_counts(access: DataFrame, *keys: str) -> DataFrame:
    """Uses per key, of single accesses or of folded ones."""
    uses = F.sum("uses") if "uses" in access.columns else F.count(F.lit(1))
    return access.groupBy(*keys).agg(uses.alias("uses"))


def top_fields(access: DataFrame, k: int = 20) -> DataFrame:
    counts = field_counts(access, "normalized")
    return counts.orderBy(F.desc("uses"), "normalized").limit(k)


def top_fields_per_entity(access: DataFrame, k: int = 10) -> DataFrame:
    counts = field_counts(access, "entity_type", "normalized")
    order = Window.partitionBy("entity_type").orderBy(F.desc("uses"), "normalized")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def method_counts(access: DataFrame) -> DataFrame:
    return field_counts(access, "access_method")


def variations(access: DataFrame, mapped: Column | None = None) -> DataFrame:
    """Raw spellings per normalised field; the pairs are made distinct first."""
    rows = access if mapped is None else access.filter(mapped)
    pairs = rows.select("normalized", "field").distinct()
    return pairs.groupBy("normalized").agg(
        F.count(F.lit(1)).alias("variation_count"),
        F.array_join(F.sort_array(F.collect_list("field")), ",").alias("spellings"),
    )


def folded(access: DataFrame, *extra: str) -> DataFrame:
    """The fact folded once to distinct shapes with their ``uses``, stored for the branches of a report."""
    keys = ["normalized", "field", "entity_type", "access_method", *extra]
    return checkpoint(access.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses")))


def usage_report(access: DataFrame, k_fields: int = 20, k_entity: int = 10) -> DataFrame:
    """The report as one long table: section, group, item, value. The fact is read once."""
    access = folded(access)
    fields = top_fields(access, k_fields).select(
        F.lit("top_fields").alias("section"), F.lit("").alias("grp"), F.col("normalized").alias("item"), "uses"
    )
    entity = top_fields_per_entity(access, k_entity).select(
        F.lit("entity_fields").alias("section"), F.col("entity_type").alias("grp"), F.col("normalized").alias("item"), "uses"
    )
    methods = method_counts(access).select(
        F.lit("access_methods").alias("section"), F.lit("").alias("grp"), F.col("access_method").alias("item"), "uses"
    )
    spell = variations(access).select(
        F.lit("variations").alias("section"), F.lit("").alias("grp"), F.col("normalized").alias("item"),
        F.col("variation_count").alias("uses"),
    )
    return fields.unionByName(entity).unionByName(methods).unionByName(spell)


def category_report(access: DataFrame, category: Column, k: int = 5) -> DataFrame:
    """Per category: field count, uses, mean uses and its top fields."""
    counts = field_counts(access, "normalized").withColumn("category", category)
    order = Window.partitionBy("category").orderBy(F.desc("uses"), "normalized")
    totals = counts.groupBy("category").agg(
        F.count(F.lit(1)).alias("fields"), F.sum("uses").alias("total_uses"),
        F.round(F.sum("uses") / F.count(F.lit(1)), 6).alias("mean_uses"),
    )
    # Only the first k of a category are ranked; the filter is applied map side.
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("category").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "normalized"))), lambda s: s["normalized"]), ","
        ).alias("top_fields")
    )
    return totals.join(top, "category")


def usage_pivot(access: DataFrame, entities: list[str], top: int = 30) -> DataFrame:
    """Fields by entity; ``-`` marks a pair that never occurs."""
    counts = field_counts(access, "normalized", "entity_type")
    wide = counts.groupBy("normalized").pivot("entity_type", entities).agg(F.sum("uses"))
    total = sum((F.coalesce(F.col(e), F.lit(0)) for e in entities[1:]), F.coalesce(F.col(entities[0]), F.lit(0)))
    cells = [F.coalesce(F.col(e).cast("string"), F.lit("-")).alias(f"n_{e.lower()}") for e in entities]
    return wide.select("normalized", total.alias("total"), *cells).orderBy(F.desc("total"), "normalized").limit(top)


def access_share(access: DataFrame, category: Column) -> DataFrame:
    """Share of each field in all accesses, per category."""
    counts = field_counts(access, "normalized").withColumn("category", category)
    totals = counts.agg(F.sum("uses").alias("all_uses"))
    return counts.join(totals, how="inner").select(
        "category", "normalized", "uses", F.round(F.col("uses") * 100.0 / F.col("all_uses"), 4).alias("share_pct")
    )


def data_dictionary(access: DataFrame, category: Column) -> DataFrame:
    """One row per field; the user list itself is ``dictionary_users``. The fact is read once."""
    access = folded(access, "unit")
    users = units_per_field(access)
    shapes = access.groupBy("normalized").agg(
        F.sort_array(F.collect_set("entity_type")).alias("entities"), F.sort_array(F.collect_set("access_method")).alias("methods"),
        (F.min("field") != F.max("field")).alias("has_variations"),
    )
    merged = users.withColumnRenamed("units", "used_by").join(shapes, "normalized")
    return merged.select(
        "normalized",
        category.alias("category"),
        "used_by",
        F.array_join("entities", ",").alias("entities"),
        F.array_join("methods", ",").alias("methods"),
        "has_variations",
    )


def dictionary_users(access: DataFrame) -> DataFrame:
    return access.select("normalized", "unit").distinct()


def unique_fields(access: DataFrame, category: Column, sub: Column, dtype: Column, top: int = 20) -> DataFrame:
    """The ``top`` fields by units, with the first three spellings. The fact is read once."""
    access = folded(access, "unit")
    users = dictionary_users(access).groupBy("normalized").agg(F.count(F.lit(1)).alias("units"))
    entities = access.groupBy("normalized").agg(F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("entities"))
    spellings = access.select("normalized", "field").distinct()
    counts = spellings.groupBy("normalized").agg(F.count(F.lit(1)).alias("variation_count"))
    rank = F.row_number().over(Window.partitionBy("normalized").orderBy("field"))
    firsts = spellings.withColumn("_r", rank).filter("_r <= 3").groupBy("normalized").agg(F.array_join(F.sort_array(F.collect_list("field")), ",").alias("examples"))
    return (
        users.join(entities, "normalized").join(counts, "normalized").join(firsts, "normalized")
        .select(
            "normalized", category.alias("category"), sub.alias("subcategory"), dtype.alias("dtype"), "units",
            "variation_count", "examples", "entities",
        )
        .orderBy(F.desc("units"), "normalized")
        .limit(top)
    )


def units_per_field(access: DataFrame) -> DataFrame:
    return dictionary_users(access).groupBy("normalized").agg(F.count(F.lit(1)).alias("units"))


def usage_bands(access: DataFrame) -> DataFrame:
    n = F.col("units")
    band = (
        F.when(n >= 20, "20+").when(n >= 10, "10-19").when(n >= 5, "5-9").when(n >= 2, "2-4").otherwise("1")
    )
    return units_per_field(access).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("fields"))


def field_flags(access: DataFrame, critical_share: float = 0.5, shared_min: int = 10, spread: int = 2) -> DataFrame:
    """critical: over half of the units; shared: >=10; rare: one; inconsistent: >2 spellings. The fact is read once."""
    access = folded(access, "unit")
    users = units_per_field(access)
    spell = access.select("normalized", "field").distinct().groupBy("normalized").agg(
        F.count(F.lit(1)).alias("spellings")
    )
    unit_count = access.agg(F.countDistinct("unit").alias("all_units"))
    n = F.col("units")
    return (
        users.join(spell, "normalized")
        .join(unit_count, how="inner")
        .select(
            "normalized", "units", "spellings",
            (n > F.col("all_units") * critical_share).alias("critical"),
            (n >= shared_min).alias("shared"),
            (n == 1).alias("rare"),
            (F.col("spellings") > spread).alias("inconsistent"),
        )
    )


def most_inconsistent(access: DataFrame, spread: int = 2, k: int = 5) -> DataFrame:
    spell = variations(access).filter(F.col("variation_count") > spread)
    return spell.orderBy(F.desc("variation_count"), "normalized").limit(k)


def advice(access: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row of findings: inconsistent fields, complex units, static returns."""
    bad = variations(access).agg(
        F.count_if(F.col("variation_count") > 1).alias("varied_fields"),
        F.count_if(F.col("variation_count") > 2).alias("inconsistent_fields"),
    )
    units = profiles.agg(
        F.count_if(F.col("level") == "complex").alias("complex_units"),
        F.count_if(F.col("return_shape").isin("empty_array", "static_none")).alias("static_units"),
    )
    return bad.join(units, how="inner").select(
        "*",
        (F.col("inconsistent_fields") > 0).alias("standardize_fields"),
        (F.col("complex_units") > 5).alias("simplify_units"),
        (F.col("static_units") > 10).alias("review_static"),
    )


def match_patterns(access: DataFrame, patterns: DataFrame) -> DataFrame:
    """Relational division: units whose fields include every field of a pattern.

    ``patterns`` has ``pattern, field``.
    """
    need = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("need"))
    have = access.select("unit", F.col("normalized").alias("field")).distinct()
    hits = have.join(patterns, "field").groupBy("pattern", "unit").agg(F.count(F.lit(1)).alias("have"))
    return hits.join(need, "pattern").filter(F.col("have") == F.col("need")).select("pattern", "unit")


def relationship_edges(df: DataFrame, id_col: str, entities: str) -> DataFrame:
    """Distinct consecutive pairs of an ordered entity list."""
    pairs = F.arrays_zip(
        F.slice(F.col(entities), 1, F.greatest(F.size(entities) - 1, F.lit(0))).alias("src"),
        F.slice(F.col(entities), 2, F.greatest(F.size(entities) - 1, F.lit(0))).alias("dst"),
    )
    return df.select(id_col, F.inline(pairs)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
