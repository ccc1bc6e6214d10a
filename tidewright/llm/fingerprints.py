"""One-permutation MinHash fingerprints of documents, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.prefix import range_ordered

BINS, BITS, WORDS = 128, 8, 5
_PRIME = 131  # the first prime not below the number of bins
_SHIFT = 64 - 7  # the top 7 bits of a hash name its bin


def add_fingerprint(df: DataFrame, text_col: str, out: str, words: int = WORDS) -> DataFrame:
    """``df`` with ``out``: for each of the bins the low-order byte of its minimum, an array of 128; empty for texts without words.

    A text's set is its runs of ``words`` words (anything but ASCII white space, A-Z in lower case); a shorter text is one run. Each
    run is hashed once: the hash's top bits choose the bin, the rest is the value whose minimum the bin keeps. An empty bin takes
    the minimum of another bin, the first non-empty one in a random order of its own (optimal densification), so that two
    texts' bins agree with a probability equal to the Jaccard similarity of their sets. Null texts count as empty.
    """
    w, s, m, g, lo, hi = (f"_{out}_{k}" for k in ("words", "runs", "minima", "bytes", "low", "high"))
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn(w, F.transform(F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    runs = F.transform(F.col(w), lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, words))))
    df = df.withColumn(s, F.sort_array(F.slice(runs, F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))))

    def bin_of(h: Column) -> Column:
        return F.shiftright(h, _SHIFT) + 64

    # sorted hashes hold each bin's in one stretch, the minimum first
    df = df.withColumn(m, F.filter(F.col(s), lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(s), i - 1)))))
    df = df.withColumn(g, F.transform(F.col(m), lambda h: (bin_of(h) * 256 + h.bitwiseAND(F.lit(255).cast("bigint"))).cast("int")))
    one = F.lit(1).cast("bigint")

    def occupied(first: int) -> Column:
        half = F.filter(F.transform(F.col(g), lambda x: F.shiftright(x, 8) - first), lambda j: (j >= 0) & (j < 64))
        return F.aggregate(half, F.lit(0).cast("bigint"), lambda acc, j: acc.bitwiseOR(F.call_function("shiftleft", one, j)))

    df = df.withColumns({lo: occupied(0), hi: occupied(64)})

    def before(mask: str, j: Column) -> Column:
        return F.bit_count(F.col(mask).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", -one, j))))

    def taken(j: Column) -> Column:
        half = F.when(j < 64, F.col(lo)).otherwise(F.col(hi))
        place = F.when(j < 64, before(lo, j)).otherwise(F.bit_count(F.col(lo)) + before(hi, j - 64))
        there = F.call_function("shiftright", half, j % 64).bitwiseAND(one) == 1
        turn = lambda x: (F.shiftright(x, 8) * (j * 37 % (_PRIME - 1) + 1) + j * 53) % _PRIME
        donor = F.array_min(F.transform(F.col(g), lambda x: turn(x) * 256 + x.bitwiseAND(F.lit(255))))
        return F.when(there, F.get(F.col(g), place)).otherwise(donor).bitwiseAND(F.lit(255)).cast("short")

    filled = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), taken)
    empty = F.array().cast("array<short>")
    return df.withColumn(out, F.when(F.size(g) == 0, empty).otherwise(filled)).drop(w, s, m, g, lo, hi)


def packed(fingerprint: Column) -> Column:
    """The bytes of a fingerprint as hexadecimal text; the empty text for the empty set."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 2, "0")), "")


def unpacked(text: Column) -> Column:
    """The fingerprint of a :func:`packed` text."""
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("short"))


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Low-order bits of different minima agree by chance once in 2^BITS; the share of agreeing bins is corrected for that. Two empty
    sets are alike, an empty and a filled one are not.
    """
    chance = 2.0 ** -BITS
    same = F.aggregate(F.zip_with(one, other, lambda a, b: (a == b).cast("int")), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) / F.lit(float(BINS))
    corrected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))
    return F.when((F.size(one) == 0) & (F.size(other) == 0), 1.0).when((F.size(one) == 0) | (F.size(other) == 0), 0.0).otherwise(corrected)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (packed) of every whole text. A column of that name is replaced."""
    base = docs.drop("fingerprint").withColumn("_fp_text", F.col(f"`{text_col}`"))
    return add_fingerprint(base, "_fp_text", "_fp").withColumn("fingerprint", packed(F.col("_fp"))).drop("_fp", "_fp_text")


def next_documents(docs: DataFrame) -> DataFrame:
    """For rows (_id, _key, _dup, n_chars): the row before each in descending order of id, the last one before the first.

    Returns (_nkey, _ndup, _tid, _tkey, _tdup, _tchars): row (_nkey, _ndup) is the next document of row (_tkey, _tdup). Only ids
    are sorted, over ranges; the ranges' last rows (one per range) carry the order across their borders.
    """
    order = [F.col("_id").desc(), F.col("_dup")]
    names = ("_id", "_key", "_dup", "n_chars")
    ranged = range_ordered(docs.select(*names), *order)
    last = ranged.groupBy("_part").agg(F.min(F.struct("_id", (-F.col("_dup")).alias("_neg"), "_key", "_dup", "n_chars")).alias("_last"))
    parts, everything = Window.orderBy("_part"), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    border = last.select(F.col("_part").alias("_border"), F.coalesce(F.lag("_last").over(parts), F.last("_last").over(everything)).alias("_before"))
    inside = ranged.withColumn("_lag", F.lag(F.struct(*names)).over(Window.partitionBy("_part").orderBy(*order)))
    joined = inside.join(border, F.col("_part") == F.col("_border"), "left")
    pick = [F.when(F.col("_lag").isNull(), F.col(f"_before.{k}")).otherwise(F.col(f"_lag.{k}")).alias(n) for k, n in zip(names, ("_tid", "_tkey", "_tdup", "_tchars"), strict=True)]
    return joined.select(F.col("_key").alias("_nkey"), F.col("_dup").alias("_ndup"), *pick)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness: the operator's own measure of how it answers edits.

    The edited text of a document replaces its last floor(n_chars / 2) code points by the first as many (or all) of the next document
    in descending order of id, the first after the last. Null texts count as empty. Repeated ids are told apart by their
    text's hash, equal rows follow each other; a null id comes last; a single document is its own next; an empty table gives
    an empty result. Texts are shuffled once by id, and once more only as far as the neighbour's half needs them.
    """
    ident = F.col(f"`{id_col}`")
    key = F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit(""))  # never null, so that joins keep its partitioning
    base = docs.select(ident.alias("_id"), key.alias("_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    same_id = Window.partitionBy("_key").orderBy("_hash")
    n_chars = F.char_length("_text").cast("bigint")

    narrow = base.select("_id", "_key", F.xxhash64("_text").alias("_hash"), n_chars.alias("n_chars")).withColumn("_dup", F.row_number().over(same_id) - 1)
    order = next_documents(narrow)
    # both uses read the same three columns, so that one shuffle of the texts serves both
    full = add_fingerprint(base.select("_key", "_text"), "_text", "_fp").repartition("_key")
    full = full.withColumn("_hash", F.xxhash64("_text")).withColumn("_dup", F.row_number().over(same_id) - 1)
    mine = (F.col("_key") == F.col("_nkey")) & ((F.col("_dup") - F.col("_ndup")) == 0)
    heads = full.join(order, mine).select(
        "_tid", "_tkey", "_tdup", F.substring(F.col("_text"), F.lit(1), F.floor(F.col("_tchars") / 2).cast("int")).alias("_head"), F.col("_fp").alias("_next_fp"))
    theirs = (F.col("_key") == F.col("_tkey")) & ((F.col("_dup") - F.col("_tdup")) == 0)
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 2)
    joined = full.join(heads, theirs).withColumn("n_chars", n_chars)
    joined = joined.select("_tid", "n_chars", "_fp", "_next_fp", F.concat(F.substring(F.col("_text"), F.lit(1), kept.cast("int")), F.col("_head")).alias("_edited"))
    scored = add_fingerprint(joined, "_edited", "_edited_fp")
    return scored.select(
        F.col("_tid").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        packed(F.col("_fp")).alias("fingerprint"), packed(F.col("_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"),
    )
