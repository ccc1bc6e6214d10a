"""Repetition rules: maximal repeated word sequences of each text from its suffix array, with the base counts of quality rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textarrays import U, WORD, mix, raw, repeated_words, slices, spread, stretches, windows, within, word_hashes, words

MIN_REPEAT = 6  # words of the shortest repeat that counts
MAX_COVERED = 30  # percent of a text's words that repeats may cover
MAX_REPEAT = 50  # words of the longest repeat a text may hold
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])  # bytes that begin a code point
FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "repeats array<struct<start:bigint,length:bigint,times:bigint>>, spans array<struct<start:bigint,length:bigint>>, covered_words bigint, longest_repeat bigint")


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``symbols`` and the length of the prefix each shares with the one before it.

    Windows of 1, 2, 4 ... symbols are numbered in order until all differ; the numbers of all widths then give the shared prefixes,
    from the widest down. The last symbol must occur once.
    """
    n = len(symbols)
    levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while n and levels[-1].max() < n - 1:
        rank = levels[-1]
        after = np.concatenate([rank[width:] + 1, np.zeros(min(width, n), np.int64)])
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(levels[-1])
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + (1 << level) <= n
        same = inside.copy()
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        a, b = a + (same << level), b + (same << level)
    shared[1:] = a - order[:-1]
    return order, shared


def maximal_repeats(symbols: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first place, length, times) of every sequence of ``least`` symbols or more that occurs twice or more and that no symbol, put
    before or behind all its occurrences, would lengthen.

    These are the intervals of suffixes whose shared prefixes are as long or longer, where the symbols before the suffixes differ.
    """
    order, shared = suffix_array(symbols)
    if not len(order):
        return []
    ahead = np.where(order > 0, symbols[order - 1], np.iinfo(np.int64).min)
    changes = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
    out: list[tuple[int, int, int]] = []
    # only stretches of suffixes that share enough with their neighbours are walked
    enough = np.append(shared >= least, False)
    begins = np.flatnonzero(enough[1:] & ~enough[:-1])
    ends = np.flatnonzero(~enough[1:] & enough[:-1]) + 1
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        places, lengths, change = order[begin:end].tolist(), shared[begin + 1:end].tolist(), changes[begin:end].tolist()
        open_: list[tuple[int, int, int]] = []  # (length, first suffix, lowest place)
        lowest = places[0]
        for i, length in enumerate([*lengths, 0]):
            left, low = i, places[i]
            while open_ and open_[-1][0] > length:
                long, left, lowest = open_.pop()
                low = min(lowest, low)
                if change[i] > change[left]:
                    out.append((low, long, i - left + 1))
            if length:
                if open_ and open_[-1][0] == length:
                    open_[-1] = (length, open_[-1][1], min(open_[-1][2], low))
                else:
                    open_.append((length, left, low))
    return out


def _lines(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """How many lines of each row hold a word and equal an earlier line of the row."""
    every = np.zeros(256, bool)
    every[[b for b in range(256) if b != 0x0A]] = True
    _, starts, stops, counted = words(data, ends, lower=False, member=every)
    total = np.concatenate([[0], np.cumsum(inside)])
    used = total[stops] > total[starts]
    at, keys = windows(word_hashes(data, starts, stops)[used], np.concatenate([[0], np.cumsum(used)])[counted], 1)
    again = np.ones(len(at), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return within(again, np.concatenate([[0], np.cumsum(used)])[counted])


def repetition(docs: DataFrame, least: int = MIN_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What repeats in every row of ``docs``: (id) and the columns of ``FIELDS``.

    Words are runs of anything but ASCII white space. ``repeats`` are the maximal repeated sequences of ``least`` words or more (first
    word's number, words, occurrences), longest first; ``spans`` is the union of all their occurrences, ``covered_words`` its size,
    ``longest_repeat`` the words of the longest. ``word_chars`` counts code points in words, ``n_symbols`` the characters
    ``#*$%&|<>``, ``n_dup_lines`` the lines with a word that equal an earlier line, ``n_repeat_words`` the words in 3-word windows
    that the text has twice or more.

    Words of no repeated window of ``least`` words are in no such repeat, so the suffix array holds only the stretches of the
    others, ended by walls. Words, lines and windows are told apart by 64-bit hashes. A task holds about one megabyte of text, or one row.

    Null, empty and blank texts have zeros and empty lists; rows may repeat, ids may be null or of any type; other columns are not
    carried; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, ends = raw(part.column("text"))
            data, starts, stops, counted = words(data, ends, lower=False)
            hashes, inside = word_hashes(data, starts, stops), WORD[data]
            chars, symbols = within(inside & _LEADS[data], ends), within(_SYMBOL[data], ends)
            mask = repeated_words(hashes, counted, least)
            heads, tails = stretches(mask, counted, least)
            row = np.searchsorted(counted, heads, side="right") - 1
            # texts are kept apart: the same word of two texts is two symbols, and each stretch ends in a wall of its own
            sizes = tails - heads + 1
            at, walls = spread(heads, sizes), np.cumsum(sizes) - 1
            inner = np.ones(len(at), bool)
            inner[walls] = False
            owner = np.repeat(row, sizes)
            text = np.empty(len(at), np.int64)
            with np.errstate(over="ignore"):
                salted = mix(hashes[at[inner]] + owner[inner].astype(U) * U(0x9E3779B97F4A7C15))
            text[inner] = np.unique(salted, return_inverse=True)[1] + len(walls)
            text[walls] = np.arange(len(walls))
            found = np.array(maximal_repeats(text, least), np.int64).reshape(-1, 3)
            of = owner[found[:, 0]]
            found[:, 0] = at[found[:, 0]] - counted[of]
            order = np.lexsort((found[:, 0], -found[:, 1], of))
            of, found = of[order], found[order]
            first = np.searchsorted(of, np.arange(part.num_rows + 1))
            longest = np.zeros(part.num_rows, np.int64)
            some = first[1:] > first[:-1]
            longest[some] = found[first[:-1][some], 1]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], ["start", "length", "times"]))
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(heads - counted[row]), pa.array(tails - heads)], ["start", "length"]))
            counts = [np.diff(counted), chars, symbols, _lines(data, ends, inside), np.diff(np.concatenate([[0], np.cumsum(repeated_words(hashes, counted, 3))])[counted])]
            covered = np.diff(np.concatenate([[0], np.cumsum(mask)])[counted])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(c) for c in counts), lists, spans, pa.array(covered), pa.array(longest)],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeats", "spans", "covered_words", "longest_repeat"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """Too few words, or too many of them in repeated 3-word windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def repeats_too_much(max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> Column:
    """Repeats cover more than ``max_covered`` percent of the words, or one has more than ``max_repeat`` words."""
    return (100 * F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
