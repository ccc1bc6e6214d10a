"""Numpy views of text batches inside Arrow tasks: bounded slices, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~_SPACE  # words [^\x20\x09-\x0D]+
TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])  # ASCII letters and digits, and all that is not ASCII
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_STEP = 0x2545F4914F6CDD1D  # odd, so powers never vanish


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, U), np.full(max(0, n - 1), _STEP, U)]))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices with at most ``limit`` bytes of text, or one row: what one step holds does not grow with the batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ends between its rows; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def words(data: np.ndarray, ends: np.ndarray, lower: bool = True, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z in lower case, unless ``lower`` is off), starts and stops of the maximal runs of ``member`` bytes, and the runs before each row."""
    low = _LOWER[data] if lower else data
    inside = member[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][(ends[:-1] < ends[1:])]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, stops, np.searchsorted(starts, ends)


def word_hashes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes and their places."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = stops - starts
    total = int(lengths.sum())
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(total) - np.repeat(before, lengths)
    with np.errstate(over="ignore"):
        terms = _BYTE[low[np.repeat(starts, lengths) + place]] * _powers(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, before) + lengths.astype(U))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; with fewer words, the whole sequence as one; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    keys = _powers(min(n, width) + 1)[1:]
    with np.errstate(over="ignore"):
        if n < width:
            return mix((hashes * keys).sum(dtype=U, keepdims=True) + U(n))
        total = np.zeros(n - width + 1, U)
        for k in range(width):
            total += hashes[k:n - width + 1 + k] * keys[k]
        return mix(total)


def windows(hashes: np.ndarray, counted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``width`` words that lie in one row; equal runs of different rows differ."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    owner = np.repeat(np.arange(len(counted) - 1, dtype=np.int64), np.diff(counted))
    at = np.flatnonzero(owner[:n] == owner[width - 1:])
    with np.errstate(over="ignore"):
        total = owner[at].astype(U) * U(0x9E3779B97F4A7C15)
        for k, key in enumerate(_powers(width + 1)[1:]):
            total += hashes[at + k] * key
    return at, mix(total)


def repeated_words(hashes: np.ndarray, counted: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a run of ``width`` words that its row has twice or more."""
    at, keys = windows(hashes, counted, width)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    steps = np.zeros(len(hashes) + 1, np.int64)
    steps[at[again]] += 1
    steps[at[again] + width] -= 1
    return np.cumsum(steps)[:-1] > 0


def stretches(mask: np.ndarray, counted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of set words inside one row with at least ``least`` words."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    heads = counted[:-1][counted[:-1] < counted[1:]]
    first[heads] = mask[heads]
    tails = counted[1:][counted[:-1] < counted[1:]] - 1
    last[tails] = mask[tails]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = stops - starts >= least
    return starts[long], stops[long]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of all spans, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def within(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends[1:]] - total[ends[:-1]]
