"""Toxicity scores from a hashed linear classifier with a counterfactual penalty."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewright.llm.textarrays import U, mix, raw, slices, word_hashes, words

BITS = 18
HEADS = (4, 6)  # heads of longer words, in bytes: inflected and compound forms share them
SAMPLE = 20_000
# Groups of terms that may stand for one another in a sentence; matched as lower-case words.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
)


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row and the ends between the rows: hashed words without edge punctuation, and heads of long words."""
    low, starts, stops, counts = words(data, ends)
    owner = np.searchsorted(ends, starts, side="right") - 1
    plain = np.zeros(256, bool)
    plain[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    at = np.arange(len(low))
    following = np.minimum.accumulate(np.where(plain[low], at, len(low))[::-1])[::-1] if len(low) else at
    previous = np.maximum.accumulate(np.where(plain[low], at, -1)) if len(low) else at
    starts = following[starts]
    stops = np.maximum(previous[stops - 1] + 1, starts)
    some = stops > starts
    starts, stops, owner = starts[some], stops[some], owner[some]
    parts = [word_hashes(low, starts, stops)]
    owners = [owner]
    for n in HEADS:
        long = stops - starts > n
        parts.append(mix(word_hashes(low, starts[long], starts[long] + n) + U(n)))
        owners.append(owner[long])
    cells = np.unique((np.concatenate(owners).astype(U) << U(BITS)) | (np.concatenate(parts) >> U(64 - BITS)))
    return (cells & U((1 << BITS) - 1)).astype(np.int32), np.searchsorted(cells >> U(BITS), np.arange(len(ends)).astype(U))


def _swaps(terms: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {a: group[(i + 1) % len(group)] for group in terms for i, a in enumerate(group)}


def counterfactual(text: str, swaps: dict[str, str]) -> str | None:
    """The text with every identity term replaced by the next of its group; None if it names none."""
    found = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, swaps), key=len, reverse=True))})(?!\w)", re.IGNORECASE) if swaps else None
    changed, n = found.subn(lambda m: swaps[m[0].lower()], text) if found else (text, 0)
    return changed if n else None


def sample_features(texts: DataFrame, terms: tuple[tuple[str, ...], ...]) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """(label, features, features of the counterfactual text) of a training sample of (label, text) rows.

    A text's features are at most 2^BITS numbers, so what reaches the driver is bounded by the sample.
    """
    swaps = _swaps(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            cells, ends = features(*raw(part.column("text")))
            swapped = [counterfactual(t or "", swaps) for t in part.column("text").to_pylist()]
            others, bounds = features(*raw(pa.array(swapped, pa.string())))
            yield pa.RecordBatch.from_arrays([
                part.column("label"), pa.array([cells[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                pa.array([None if s is None else others[a:b].tobytes() for s, a, b in zip(swapped, bounds, bounds[1:], strict=False)], pa.binary()),
            ], ["label", "own", "other"])

    rows = texts.select("label", "text").mapInArrow(run, "label int, own binary, other binary").collect()
    found = [(r["label"], np.frombuffer(r["own"], np.int32), None if r["other"] is None else np.frombuffer(r["other"], np.int32)) for r in rows]
    return sorted(found, key=lambda r: (r[1].tobytes(), r[0]))  # the order in which rows arrive does not matter


def screened(rows: list[tuple[int, np.ndarray, np.ndarray | None]], labels: np.ndarray, least: float) -> np.ndarray:
    """For each feature whether it depends on the label: chi-square of presence against label at least ``least``."""
    n, n1 = len(rows), labels.sum()
    there, with1 = (np.bincount(np.concatenate([r[1] for r in rows if not only or r[0] > 0]), minlength=1 << BITS).astype(float) for only in (False, True))
    expected = there * n1 / n
    spread = expected * (1 - there / n) * (1 - n1 / n)
    return np.divide((with1 - expected) ** 2, spread, out=np.zeros(1 << BITS), where=spread > 0) >= least


def fit(rows: list[tuple[int, np.ndarray, np.ndarray | None]], penalty: float = 1.0, decay: float = 3e-4, rounds: int = 40, screen: float = 16.0, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic model over present features, averaged over the last half of the rounds.

    Features that are not :func:`screened` stay at weight 0. The loss is the class-balanced cross entropy plus ``penalty`` times the squared change of the linear score between a row and
    its counterfactual, plus a quadratic decay. Without rows of both classes every weight is 0 and every score 0.5.
    """
    weights = np.zeros((1 << BITS) + 1)
    labels = np.array([r[0] for r in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return weights
    share = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    chosen = screened(rows, labels, screen)
    rows = [(y, own[chosen[own]], None if other is None else other[chosen[other]]) for y, own, other in rows]
    random, grown, mean = np.random.default_rng(seed), np.full(len(weights), 1e-6), np.zeros(len(weights))

    def line(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(cells) if cells else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        return flat, owner, np.bincount(owner, weights=weights[flat], minlength=len(cells)) + weights[-1]

    for turn in range(rounds):
        order = random.permutation(len(rows))
        for at in range(0, len(rows), 512):
            mine = order[at:at + 512]
            flat, owner, score = line([rows[i][1] for i in mine])
            push = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[mine]) * share[mine] / len(mine)
            twins = [k for k, i in enumerate(mine) if rows[i][2] is not None]
            swapped, owner_swapped, other = line([rows[mine[k]][2] for k in twins])
            gap = penalty * 2 * (score[twins] - other) / len(mine)
            np.add.at(push, twins, gap)
            step = np.zeros(len(weights))
            step += np.bincount(flat, weights=push[owner], minlength=len(weights))
            step -= np.bincount(swapped, weights=gap[owner_swapped], minlength=len(weights))
            step[-1] = push.sum() - gap.sum()
            step[:-1] += decay * weights[:-1]
            grown += step * step
            weights -= 0.2 * step / np.sqrt(grown)
        if turn >= rounds // 2:
            mean += weights
    return mean / (rounds - rounds // 2)


def score_toxicity(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with ``score``: the probability of label 1 for the whole text.

    Null and empty texts are scored by the bias alone. A column named ``score`` is replaced.
    """
    kept = [c for c in docs.columns if c != "score" and (keep is None or c in keep)]
    schema = StructType([*docs.select(kept).schema.fields, StructField("score", DoubleType(), False)])
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            cells, ends = features(*raw(part.column(text_col)))
            sums = np.concatenate([[0.0], np.cumsum(held.value[cells])])
            line = sums[ends[1:]] - sums[ends[:-1]] + held.value[-1]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(1 / (1 + np.exp(-np.clip(line, -30, 30))))], [*kept, "score"])

    return docs.select([*kept, *([] if text_col in kept else [text_col])]).mapInArrow(run, schema)


def learn_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   sample: int = SAMPLE, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = 1.0) -> np.ndarray:
    """Weights learned from a sample of the label rows for which ``learnable`` (an expression of the id) holds.

    ``sample`` bounds the training rows: label rows are kept by a hash of their id at the rate that gives so many (all of them when
    there are fewer), so the choice is even over the table and the same in every run. A document with several label rows counts
    with each of them; null labels and ids, and ids without a document, teach nothing.
    """
    marks = labels.filter(learnable).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL")
    rate = sample / max(marks.count(), 1)
    drawn = marks.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 40)) < int(rate * (1 << 40)))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    return fit(sample_features(texts.join(F.broadcast(drawn), "_id"), terms), penalty)
