"""Runs, repeats: against brute force on short sequences, and on the shared edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewright.llm.queries import repeat_from
from tidewright.llm.repetition import maximal_repeats, repetition, suffix_array
from tidewright.llm.runs import lyndon_lengths, runs_of, word_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(s, least):
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and s[i] == s[i + q]:
                i += 1
            size = i - a + q
            w = s[a:a + size]
            if size >= max(least, 2 * q) and all(any(w[k] != w[k + r] for k in range(size - r)) for r in range(1, q)):
                out.add((a, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_repeats(s, least):
    n, places = len(s), {}
    for size in range(least, n):
        for i in range(n - size + 1):
            places.setdefault(tuple(s[i:i + size]), []).append(i)
    out = []
    for w, at in places.items():
        if len(at) > 1:
            left = {s[i - 1] if i else ("start",) for i in at}
            right = {s[i + len(w)] if i + len(w) < n else ("end",) for i in at}
            if len(left) > 1 and len(right) > 1:
                out.append((at[0], len(w), len(at)))
    return sorted(out)


def sequences(seed, count, most):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 4:
            p, a = rng.randint(1, 5), rng.randrange(n)
            s = [*s[:a], *(s[a + (i - a) % p] for i in range(a, n))]
        yield s


def test_lyndon_lengths_by_definition():
    for s in sequences(1, 400, 30):
        want = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]
        assert lyndon_lengths(s) == want


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_by_definition(least):
    for s in sequences(least, 400, 40):
        assert [tuple(r) for r in runs_of(np.array(s, np.int64), least).tolist()] == brute_runs(s, least)


def test_runs_stop_at_walls():
    assert runs_of(np.array([1, 1, 1, -1, 1, 1, 1, 1, -1]), 3).tolist() == [[0, 3, 1], [4, 4, 1]]


def test_extension_survives_equal_hashes(monkeypatch):
    from tidewright.llm import runs

    monkeypatch.setattr(runs, "mix", lambda x: x * 0)  # every window looks equal
    for s in sequences(7, 100, 30):
        assert [tuple(r) for r in runs_of(np.array(s, np.int64), 2).tolist()] == brute_runs(s, 2)


def test_suffix_array_and_repeats_by_definition():
    for s in sequences(3, 300, 30):
        text = np.array([x + 1 for x in s] + [0], np.int64)
        order, shared = suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for k in range(1, len(order)):
            a, b = text[order[k - 1]:].tolist(), text[order[k]:].tolist()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == same
        for least in (1, 2, 4):
            assert sorted(maximal_repeats(text, least)) == brute_repeats(s, least)


def rows_with_repeats():
    rng = random.Random(5)
    words = ["alpha", "beta", "Beta", "été", "#x", "a|b", "中文", "z"]
    out = []
    for i in range(120):
        n = rng.choice([0, 1, 5, 40, 90])
        s = [rng.choice(words[:rng.choice([1, 2, 8])]) for _ in range(n)]
        out.append((i, rng.choice([" ", "\n", " \t", "\r\n"]).join(s) + rng.choice(["", "\n", "\n\n"])))
    return [*out, (None, "a a a a a a a a a a a a a"), (7, None), (8, ""), (9, " \n ")]


def edited(doc_id, words):
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_word_runs_of_edited_texts(spark):
    rows = rows_with_repeats()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in word_runs(repeat_from(docs)).collect()), key=str)
    want = []
    for i, text in rows:
        words = edited(i, WORD.findall(text or ""))
        runs = brute_runs(words, 12)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((i, runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=str)


def test_op11_digests(spark, tmp_path):
    from tidewright.llm.queries import op11_periodic_runs

    rows = rows_with_repeats()
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in rows:
        words = edited(i, WORD.findall(text or ""))
        runs = brute_runs(words, 12)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for k, w in enumerate(words) if k not in gone))]
        want.append((i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *digests))
    assert got == sorted(want, key=str)


def test_repetition_by_definition(spark):
    rows = rows_with_repeats()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat,
                   sorted((x.length, x.times) for x in r.repeats), sum(x.length for x in r.spans)) for r in repetition(docs).collect()), key=str)
    want = []
    for i, text in rows:
        text = text or ""
        words = WORD.findall(text)

        def covered(k):
            grams = [tuple(words[j:j + k]) for j in range(len(words) - k + 1)]
            times = Counter(grams)
            return len({j + d for j, g in enumerate(grams) if times[g] > 1 for d in range(k)})

        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = brute_repeats(words, 6)
        want.append((i, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), covered(3), covered(6),
                     max((r[1] for r in repeats), default=0), sorted(r[1:] for r in repeats), covered(6)))
    assert got == sorted(want, key=str)


def test_edge_rows(edges, nothing):
    assert word_runs(edges).count() == repetition(edges).count() == edges.count()
    assert word_runs(nothing).count() == repetition(nothing).count() == 0
    long = word_runs(edges).filter("doc_id = 8").first()
    assert [tuple(r) for r in long.runs] == [(0, 40_000, 1)] and long.collapsed == "wordy"
    assert repetition(edges).filter("doc_id = 8").first().longest_repeat == 39_999
