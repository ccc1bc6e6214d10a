"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewright.llm.textarrays import U, mix, slices

DIM, GRAM = 1024, 3
LANGUAGES = 4096  # profiles are held in memory: 4 096 of them are 32 MB
UNDETERMINED = "und"
STEP = 1 << 18  # characters one step bundles


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, one space for each run of anything else, a space at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    padded = np.concatenate([[32], points, [32]]).astype(np.uint32)
    return padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]


def _letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random vector of -1 and 1 for each code point, the same everywhere: bits of a hash of the code point and the word's number."""
    with np.errstate(over="ignore"):
        seeds = mix((points.astype(U)[:, None] << U(8)) * U(0x9E3779B97F4A7C15) + np.arange(DIM // 64, dtype=U)[None, :] + U(1))
    return np.unpackbits(seeds.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _gram_vectors(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each n-gram's letters, permuted by their place (a cyclic shift), bound by multiplication; ``places`` index ``points``."""
    letters = _letter_vectors(points)
    bound = letters[places[-1]]
    for k, at in enumerate(places[:-1]):
        bound = bound * np.roll(letters, GRAM - 1 - k, axis=1)[at]
    return bound.astype(np.float32)


def _step(pieces: list[np.ndarray], rows: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Adds the weighted bundles of code-point pieces to their rows of ``out``."""
    codes, sizes = np.concatenate(pieces), np.array([len(p) for p in pieces])
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    points = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[points] = np.arange(len(points))
    letters, owner = number[codes], np.repeat(np.arange(len(pieces)), sizes)
    grams = functools.reduce(lambda a, b: a * len(points) + b, [letters[k:len(letters) - GRAM + 1 + k] for k in range(GRAM)])
    inside = owner[:-GRAM + 1] == owner[GRAM - 1:]
    grams, owner = grams[inside], owner[:-GRAM + 1][inside]
    if len(points) ** GRAM <= 1 << 22:  # a small alphabet numbers its n-grams by table, a large one by sorting: equal results
        there = np.bincount(grams, minlength=1) > 0
        distinct, where = np.flatnonzero(there), (np.cumsum(there) - 1)[grams]
    else:
        distinct, where = np.unique(grams, return_inverse=True)
    lines, line = np.unique(rows, return_inverse=True)
    for at in range(0, len(distinct), 8192):  # a wide alphabet does not widen the step
        some = distinct[at:at + 8192]
        mine = slice(None) if len(distinct) <= 8192 else (where >= at) & (where < at + 8192)
        cell = line[owner[mine]] * len(some) + where[mine] - at
        counts = np.bincount(cell, weights=weights[owner[mine]], minlength=len(lines) * len(some)).reshape(len(lines), -1)
        places = np.stack([some // len(points) ** (GRAM - 1 - k) % len(points) for k in range(GRAM)])
        out[lines] += counts.astype(np.float32) @ _gram_vectors(points, places)


def bundles(texts: list[str | None], rows: np.ndarray, height: int) -> np.ndarray:
    """Row r of the result bundles the n-gram vectors of the texts whose ``rows`` is r, each text weighing 1; zeros without letters."""
    out = np.zeros((height, DIM))
    pieces, owners, weights, held = [], [], [], 0
    for text, row in zip(texts, rows, strict=True):
        codes = _codes(text) if text else np.zeros(0, np.uint32)
        for at in range(0, max(0, len(codes) - GRAM + 1), STEP):
            piece = codes[at:at + STEP + GRAM - 1]
            if pieces and (held + len(piece) > STEP or len(pieces) >= 256):
                _step(pieces, np.array(owners), np.array(weights), out)
                pieces, owners, weights, held = [], [], [], 0
            pieces.append(piece)
            owners.append(row)
            weights.append(1.0 / (len(codes) - GRAM + 1))
            held += len(piece)
    if pieces:
        _step(pieces, np.array(owners), np.array(weights), out)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A prototype per language: the bundle of its texts, each weighing the same, at length one.

    Null texts, null languages and texts without letters teach nothing. Each task sums its texts, so what is shuffled is one
    vector per language and task; the result holds one vector per language, at most ``LANGUAGES`` of them (else an error).
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            langs, rows_of = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            for lang, total in zip(langs, bundles(part.column("text").to_pylist(), rows_of, len(langs)), strict=True):
                held[lang] = held.get(lang, 0) + total
        for lang, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(total)], ["lang", "place", "value"])

    parts = rows.mapInArrow(sums, "lang string, place int, value double")
    # sums of doubles depend on their order; whole millionths keep reruns equal
    whole = parts.groupBy("lang", "place").agg(F.sum(F.round(F.col("value") * 1e6).cast("bigint")).alias("value"))
    found = whole.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("pairs")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    vectors = {r["lang"]: np.array([p["value"] for p in r["pairs"]], float)[None, :] for r in sorted(found, key=lambda r: r["lang"])}
    return {lang: _unit(v)[0] for lang, v in vectors.items() if v.any()}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) with ``lang_pred`` and ``score``: the prototype of the largest cosine with the text's profile, and that cosine
    (0 where it is negative).

    Ties go to the first language by code point. A null text, a text without letters and an empty set of prototypes give
    ``und`` and 0. Columns of the two result names are replaced.
    """
    names = sorted(prototypes)
    base = docs.drop("lang_pred", "score")
    kept = [c for c in base.columns if keep is None or c in keep]
    held = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIM)))
    schema = StructType([*base.select(kept).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            unit = _unit(bundles(part.column(text_col).to_pylist(), np.arange(part.num_rows), part.num_rows))
            known = unit.any(axis=1) if names else np.zeros(len(unit), bool)
            cosines = unit @ held.value.T if names else np.zeros((len(unit), 1))
            best = cosines.argmax(axis=1)
            score = np.where(known, np.clip(cosines[np.arange(len(unit)), best], 0.0, 1.0), 0.0)
            pred = [names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return base.select([*kept, *([] if text_col in kept else [text_col])]).mapInArrow(predict, schema)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with ``held_out``, ``lang_pred`` and ``score``; learns from the rows that are not held out."""
    learned = learn_profiles(docs.filter(~held_out(id_col, 4, 2)), text_col, lang_col)
    return predict_language(docs, learned, text_col, keep).withColumn("held_out", held_out(id_col, 4, 2))
