"""Maximal periodic stretches of words: Lyndon roots of both orders from suffix-sorting groups, extended to runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textarrays import U, WORD, mix, raw, repeated_words, slices, spread, stretches, word_hashes, words

_BASE = 0x5851F42D4C957F2D  # odd, so that windows can be compared by multiplying
SPANS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the first phase of grouping suffix sorting.

    Suffixes are grouped by their first symbol. Groups are taken from the highest down; each member points to the nearest place
    before it that lies in a lower group. Places that the same number of members point to leave their group for a new one right
    above it, whose common prefix is longer by that many times the taken group's. What a taken group shares is the longest Lyndon
    prefix of its members. Every place moves at most once for each pointer to it, so the work is linear.
    """
    n = len(symbols)
    order = {s: g for g, s in enumerate(sorted(set(symbols)))}
    group = [order[s] for s in symbols]
    members: list[list[int]] = [[] for _ in order]
    for place, g in enumerate(group):
        members[g].append(place)
    size, above, below = [1] * len(order), [*range(1, len(order) + 1)], [*range(-1, len(order) - 1)]
    before, taken, out = [-1] * n, bytearray(n), [1] * n
    top = len(order) - 1
    while top >= 0:
        shared, last = size[top], -2
        pointed: list[list[int]] = []
        for i in members[top]:
            if group[i] != top:
                continue
            p = i - 1
            while p >= 0 and taken[p]:
                p = before[p]
            before[i], taken[i], out[i] = p, 1, shared
            if p == last:
                pointed[-1][1] += 1
            elif p >= 0:
                pointed.append([p, 1])
                last = p
        members[top] = []
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed:
            moved.setdefault((-times, group[p]), []).append(p)
        for (times, old), places in sorted(moved.items()):
            new = len(size)
            size.append(size[old] - times * shared)
            members.append(places)
            over = above[old]
            above.append(over)
            below.append(old)
            above[old] = new
            below[over] = new
            for p in places:
                group[p] = new
        top = below[top]
    return out


def _common(sums: np.ndarray, powers: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Longest common extension of the places a < b, forwards from them or backwards before them, by halving over window hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    shift = powers[b - a]
    while (low < high).any():
        mid = (low + high + 1) >> 1
        if back:
            one, other = sums[a] - sums[a - mid], sums[b] - sums[b - mid]
        else:
            one, other = sums[a + mid] - sums[a], sums[b + mid] - sums[b]
        with np.errstate(over="ignore"):
            same = one * shift == other
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _stretched(symbols: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """Start and length of the run of ``period`` through ``place``, symbol by symbol."""
    differs = symbols[:-period] != symbols[period:]
    after, ahead = np.flatnonzero(differs[place:]), np.flatnonzero(differs[:place])
    stop = place + int(after[0]) if len(after) else len(differs)
    start = int(ahead[-1]) + 1 if len(ahead) else 0
    return start, stop - start + period


def runs_of(symbols: np.ndarray, least: int) -> np.ndarray:
    """All (start, length, period) of ``symbols`` with length >= max(least, 2 * period), sorted by start, then period.

    A place whose symbol is negative is a wall that equals no other place. Every run has a root that is the longest Lyndon word at
    its start in one of the two orders of the symbols, so the Lyndon lengths of both are all the periods to be tried; a common
    extension to both sides gives the whole run. Extensions are found by window hashes and each run is then compared symbol by
    symbol.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    walls = symbols < 0
    count, top = int(walls.sum()), int(symbols.max(initial=0))
    text = symbols.copy()
    text[walls] = -1 - np.arange(count)  # each lower than all before it
    found = []
    hashed = mix(text.astype(U) + U(1))
    powers = np.ones(n + 1, U)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(n, _BASE, U))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(hashed * powers[:-1])])
    for turned in (False, True):
        ordered = np.where(walls, text, top - text) if turned else text
        period = np.array(lyndon_lengths(ordered.tolist()), np.int64)
        place = np.flatnonzero(~walls & (np.arange(n) + period < n))
        period = period[place]
        near = (text[place] == text[place + period]) | ((place > 0) & (text[place - 1] == text[place + period - 1]))
        place, period = place[near], period[near]
        other = place + period
        right = _common(sums, powers, place, other, n - other, back=False)
        left = _common(sums, powers, place, other, place.copy(), back=True)
        length = period + left + right
        long = length >= np.maximum(least, 2 * period)
        found.append(np.stack([place - left, length, period, place])[:, long])
    start, length, period, place = np.concatenate(found, axis=1)
    _, first, kind = np.unique(np.stack([start, period, length]), axis=1, return_index=True, return_inverse=True)
    out = set()
    for k, (s, m, q) in enumerate(zip(start[first].tolist(), length[first].tolist(), period[first].tolist(), strict=True)):
        whole = (text[s:s + m - q] == text[s + q:s + m]).all()
        if whole and not (s and text[s - 1] == text[s + q - 1]) and not (s + m < n and text[s + m] == text[s + m - q]):
            out.add((s, q, m))
        else:  # windows of equal hash that differ
            real = {_stretched(text, at, q) for at in place[kind.ravel() == k].tolist()}
            out |= {(s, q, m) for s, m in real if m >= max(least, 2 * q)}
    return np.array([(s, m, q) for s, q, m in sorted(out)], np.int64).reshape(-1, 3)


def _symbols(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A number for each word: equal words, byte by byte, have equal ones."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)


def _joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, kept: np.ndarray, counted: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    before = np.concatenate([[0], np.cumsum(kept)])[counted]
    size = (stops - starts)[kept] + 1
    room = np.concatenate([[0], np.cumsum(size)])
    out = np.full(room[-1], 0x20, np.uint8)
    out[spread(room[:-1], size - 1)] = data[spread(starts[kept], size - 1)]
    some = np.diff(before) > 0
    last = np.zeros(len(out), bool)
    last[room[before[1:][some]] - 1] = True  # no space after a row's last word
    ends = room[before] - np.concatenate([[0], np.cumsum(some)])
    return pa.StringArray.from_buffers(len(some), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out[~last])))


def word_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of ``docs``.

    Words are runs of anything but ASCII white space, numbered from 0. ``runs`` holds (start, length, period) of all stretches of
    ``length >= max(least, 2 * period)`` words whose smallest period is ``period`` and that no neighbouring word extends, by start, then
    period. ``collapsed`` are the words that no run holds beyond its first period, joined by one space.

    In a run of L words with period q at least ``least / 2`` words (and q) are found again q words on, so all its words lie in
    windows of ``ceil(least / 2)`` words that the text has twice. Only stretches of such words, kept apart by walls, are searched;
    the others cannot belong to a run. A task holds about one megabyte of text, or one row; no row leaves its task.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``; rows may repeat, ids may be null or of any type;
    other columns are not carried; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    width = max(1, (least + 1) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, starts, stops, counted = words(*raw(part.column("text")), lower=False, member=WORD)
            heads, tails = stretches(repeated_words(word_hashes(data, starts, stops), counted, width), counted, least)
            at = spread(heads, tails - heads + 1)  # one place more for the wall
            walls = np.cumsum(tails - heads + 1) - 1
            inner = np.ones(len(at), bool)
            inner[walls] = False
            symbols = np.full(len(at), -1, np.int64)
            symbols[inner] = _symbols(data.tobytes(), starts[at[inner]], stops[at[inner]])
            found = runs_of(symbols, least)
            first = at[found[:, 0]]
            row = np.searchsorted(counted, first, side="right") - 1
            steps = np.zeros(len(starts) + 1, np.int64)
            np.add.at(steps, first + found[:, 2], 1)
            np.add.at(steps, first + found[:, 1], -1)
            kept = np.cumsum(steps)[:-1] == 0
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (first - counted[row], found[:, 1], found[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(counted)), pa.ListArray.from_arrays(pa.array(ends), spans), _joined(data, starts, stops, kept, counted)],
                ["id", "n_words", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, runs {SPANS}, collapsed string").withColumnRenamed("id", id_col)
