"""Document quality from overlapping heuristic labellers and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidewright.llm.textarrays import mix, raw, slices
from tidewright.llm.toxicity import BITS, features, fit

SAMPLE = 20_000
# Per labeller: below the first limit one vote, above the second the other, abstention between; True if small values are good.
LABELLERS = (("symbols", 0.04, 0.12, True), ("capitals", 0.15, 0.5, True), ("distinct words", 0.25, 0.5, False), ("distinct lines", 0.6, 0.9, False),
             ("digits", 0.05, 0.2, True), ("words", 4, 25, False), ("letters", 0.55, 0.7, False))


WINDOW, RUN = 400, 8  # words


def distinct_words(words: list[str]) -> float:
    """Share of distinct words, averaged over consecutive windows, so that it does not fall with the length; of more than one window the
    share of distinct runs of words where that is smaller, so that repetition from window to window counts."""
    share = sum(len(set(words[i:i + WINDOW])) for i in range(0, len(words), WINDOW)) / len(words)
    if len(words) <= WINDOW:
        return share
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    runs = np.zeros(len(words) - RUN + 1, np.uint64)
    for k in range(RUN):
        runs = mix(runs + codes[k:len(words) - RUN + 1 + k] + np.uint64(1))
    return min(share, len(np.unique(runs)) / len(runs))


def shape(text: str) -> np.ndarray:
    """The quantities the labellers look at; zeros for an empty text."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        return np.zeros(len(LABELLERS))
    n = sum(map(len, words))
    letters, digits, capitals = (sum(map(f, text)) for f in (str.isalpha, str.isdigit, str.isupper))
    return np.array([(n - letters - digits) / n, capitals / max(letters, 1), distinct_words(words), len(set(lines)) / max(len(lines), 1), digits / n, len(words), letters / n])


def votes(values: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 abstains, for each labeller; all abstain on an empty text but the counts of words and letters, which say bad."""
    out = np.full(values.shape, 2)
    for k, (_, low, high, small_is_good) in enumerate(LABELLERS):
        out[..., k] = np.where(values[..., k] <= low, int(small_is_good), np.where(values[..., k] >= high, int(not small_is_good), 2))
    return out


def estimate(patterns: np.ndarray, times: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: (chance of each vote given good, given bad, share of good).

    Labellers are taken as independent given the class. The start trusts every labeller alike, one pseudo-count keeps chances from 0.
    """
    share, start = 0.8, np.array([[0.1, 0.6, 0.3], [0.6, 0.1, 0.3]])
    chances = [np.tile(start[c], (len(LABELLERS), 1)) for c in (0, 1)]
    for _ in range(rounds):
        good = posterior(patterns, chances[0], chances[1], share)
        for c, weight in ((0, good * times), (1, (1 - good) * times)):
            chances[c] = np.stack([(np.bincount(patterns[:, k], weights=weight, minlength=3) + 1) / (weight.sum() + 3) for k in range(len(LABELLERS))])
        share = float(np.clip((good * times).sum() / max(times.sum(), 1), 1e-3, 1 - 1e-3))
    return chances[0], chances[1], share


def posterior(patterns: np.ndarray, good: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
    line = np.log(share) - np.log(1 - share) + sum(np.log(good[k][patterns[:, k]]) - np.log(bad[k][patterns[:, k]]) for k in range(len(LABELLERS)))
    return 1 / (1 + np.exp(-np.clip(line, -40, 40)))


def _pattern(text: str | None) -> int:
    return int((votes(shape(text or "")) * 3 ** np.arange(len(LABELLERS))).sum())


def _unfold(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, weak_label, score, kept) of every row of ``docs``.

    Votes of all documents are counted by pattern (at most 3^7 rows), EM estimates the labellers' accuracies from the counts,
    and the posterior of its pattern is a document's weak label. A linear scorer over hashed words is trained on at most about
    ``sample`` documents drawn evenly by a hash of the id, with weak labels as targets; ``score`` averages it with the weak label, and a
    document is kept from 0.5 on. Null texts count as empty; an empty table gives an empty result; rows may repeat.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([_pattern(t) for t in part.column("text").to_pylist()], pa.int64())], ["id", "pattern"])

    counted = rows.mapInArrow(vote, StructType([kind, StructField("pattern", LongType())])).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    codes, times = np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], float)
    good, bad, share = estimate(_unfold(codes), times)
    rate = min(1.0, sample / max(times.sum(), 1))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 40)) < int(rate * (1 << 40)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            cells, ends = features(*raw(part.column("text")))
            labels = posterior(_unfold(np.array([_pattern(t) for t in part.column("text").to_pylist()])), good, bad, share) >= 0.5
            yield pa.RecordBatch.from_arrays([pa.array(labels.astype(np.int32)), pa.array([cells[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["label", "own"])

    found = sorted((r["label"], r["own"]) for r in drawn.mapInArrow(learn, "label int, own binary").collect())
    held = docs.sparkSession.sparkContext.broadcast(fit([(y, np.frombuffer(x, np.int32), None) for y, x in found]) if found else np.zeros((1 << BITS) + 1))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            weak = posterior(_unfold(np.array([_pattern(t) for t in part.column("text").to_pylist()])), good, bad, share)
            cells, ends = features(*raw(part.column("text")))
            sums = np.concatenate([[0.0], np.cumsum(held.value[cells])])
            line = sums[ends[1:]] - sums[ends[:-1]] + held.value[-1]
            score = (weak + 1 / (1 + np.exp(-np.clip(line, -30, 30)))) / 2
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(weak), pa.array(score)], ["id", "weak_label", "score"])

    scored = rows.mapInArrow(judge, StructType([kind, StructField("weak_label", DoubleType()), StructField("score", DoubleType())]))
    return scored.select(F.col("id").alias(id_col), "weak_label", "score", (F.col("score") >= 0.5).alias("kept"))
