"""Language ID, BPE, toxicity and the numpy text helpers."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm.bpe import Bpe, PrefixTable, decode_ids, encode_texts, round_trip_digests
from tidewright.llm.language import identify_languages, learn_profiles, predict_language
from tidewright.llm.textarrays import raw, shingles, slices, word_hashes, words
from tidewright.llm.toxicity import counterfactual, fit, learn_toxicity, score_toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return Bpe(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="ab é\n\t'sl 1²中😀\x1c\x85 _-"), st.text(alphabet="ing the", max_size=200)))
def test_words_and_bpe(bpe, reference, text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()
    low, starts, stops, counts = words(*raw(pa.array([text, None, text])))
    want = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    assert [low[a:b].tobytes() for a, b in zip(starts, stops)] == want * 2 and counts.tolist() == [0, len(want), len(want), 2 * len(want)]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.binary(max_size=20))
def test_appends_and_edits_are_exact(bpe, data, a, b, new):
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    joined = data[:a] + new + data[b:]
    assert PrefixTable(bpe, data).edit(a, b, new).tokens() == PrefixTable(bpe, joined).tokens() == [bpe.ranks[p] for p in bpe.merge(joined)]
    assert PrefixTable(bpe, data).append(new).last == PrefixTable(bpe, data + new).last


def test_bpe_tables(spark, edges, nothing, reference):
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in round_trip_digests(edges, PATH, PATTERN).collect()}
    want = set()
    for r in edges.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows == want
    back = decode_ids(encode_texts(edges, PATH, PATTERN), PATH).collect()
    assert len(back) == 12 and all(r["decoded"] == (r["text"] or "").encode() for r in back)
    assert round_trip_digests(nothing, PATH, PATTERN).collect() == []


def test_long_unbroken_piece(bpe, reference):
    text = "ab" * 20_000 + "é" * 500
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_hashes_tell_words_apart_and_slices_are_bounded():
    texts = ["a b", "ab", "b a", "a  b ", "a" * 50]
    low, starts, stops, counts = words(*raw(pa.array(texts)))
    h = word_hashes(low, starts, stops)
    assert len(set(h.tolist())) == 4
    sets = [set(shingles(h[a:b], 2).tolist()) for a, b in zip(counts, counts[1:])]
    assert sets[0] == sets[3] and len({tuple(s) for s in sets}) == 4
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 400] * 10 + [None])], ["text"])
    assert [b.num_rows for b in slices(iter([batch]), "text", 1000)] == [2, 2, 2, 2, 3]


def _speech(alphabet, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(30)) for _ in range(n)]


def test_language_accuracy(spark):
    kinds = {"aa": ["ka", "ro", "mi"], "bb": ["schu", "tzen", "lich"], "cc": ["été", "eaux", "que"], "dd": ["да", "ни", "ко"]}
    rows = [(i * 4 + k, t, lang) for k, (lang, a) in enumerate(kinds.items()) for i, t in enumerate(_speech(a, 60, k))]
    got = identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edges, nothing):
    got = identify_languages(edges).collect()
    assert len(got) == 12 and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5, 9)} == {"und"}
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0} and all(r["lang_pred"] in ("en", "de", "und") for r in got)
    assert identify_languages(nothing).collect() == []
    assert learn_profiles(nothing) == {} and {r["lang_pred"] for r in predict_language(edges, {}).collect()} == {"und"}


def test_one_letter_and_wide_alphabets(spark):
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    got = identify_languages(spark.createDataFrame([(0, "a", "xx"), (1, wide, "zh"), (3, "a", "xx"), (4, wide, "zh")], "doc_id bigint, text string, lang string")).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in got)


def _remarks(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = [rng.choice(["blue", "stone", "river", "table", "women", "muslims", "quiet", "letter"]) for _ in range(12)]
        bad = rng.random() < 0.3
        if bad:
            body[rng.randrange(12)] = rng.choice(["Rotter!", "rotters", "filth,"])
            body[rng.randrange(12)] = "women"
        out.append((i, " ".join(body), int(bad)))
    return out


def test_toxicity_held_out_and_counterfactuals(spark):
    rows = _remarks(600, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    weights = learn_toxicity(docs, labels, F.col("doc_id") < 450)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, weights).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 450]
    assert sum(held) >= 0.97 * len(held)
    swapped = spark.createDataFrame([(0, "the women read a letter"), (1, "the men read a letter")], "doc_id bigint, text string")
    a, b = (r["score"] for r in score_toxicity(swapped, weights).orderBy("doc_id").collect())
    assert abs(a - b) < 0.2 and max(a, b) < 0.5


def test_penalty_reduces_the_gap():
    swap = {"women": "men"}
    assert counterfactual("Women, and mwomen", swap) == "men, and mwomen" and counterfactual("none", swap) is None
    rng = np.random.default_rng(0)
    rows = [(int(y), np.array([1 if y or rng.random() < 0.2 else 2, 5 + int(rng.integers(3))], np.int32), np.array([3, 5], np.int32)) for y in rng.integers(0, 2, 400)]
    free, bound = fit(rows, penalty=0.0), fit(rows, penalty=5.0)
    assert abs(bound[1] - bound[3]) < abs(free[1] - free[3])


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, 0), (77, 1), (6, None)], "doc_id bigint, toxic int")
    weights = learn_toxicity(edges, labels, F.lit(True))
    got = score_toxicity(edges, weights).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in score_toxicity(edges, learn_toxicity(nothing, labels, F.lit(True))).collect()} == {0.5}
    assert score_toxicity(nothing, weights).collect() == []
