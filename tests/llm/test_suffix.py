"""Induced sorting against plain sorting, and removal of repeats against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import induced, suffix_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 3), st.booleans())
def test_induced_sorting(symbols, times, few):
    s = symbols * times
    kept, induced.FEW = induced.FEW, induced.FEW if few else 0
    try:
        order = induced.suffix_array(np.array(s, np.int64))
    finally:
        induced.FEW = kept
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    shared = induced.common_prefixes(np.array(s, np.int64), order)
    for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        n = 0
        while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
            n += 1
        assert shared[j] == n
    assert not len(s) or shared[order[0]] == 0


def plain(docs):
    texts = [(t or "").encode() for _, t in docs]
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 199):
            if counts[t[p : p + 200]] > 1:
                gone[p + 1 : p + 201] = True
        kept = bytes(b for k, b in enumerate(t) if not gone[k + 1])
        out.append((i, len(t), int(gone.sum()), int((~gone[:-1] & gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcdefgh éß\n", k=n))
    passage, line, long = noise(500), noise(120), noise(3000)
    docs = [(i, noise(rng.randrange(600))) for i in range(20)]
    docs += [(30 + i, noise(rng.randrange(300)) + passage[rng.randrange(200) :][: rng.randrange(150, 320)] + noise(40)) for i in range(25)]
    docs += [(60 + i, noise(150) + line + noise(150)) for i in range(40)]  # a common line too short to go
    docs += [(110 + i, long[:k] + "#" + long[k + 1 :]) for i, k in enumerate(range(0, 3000, 250))]
    docs += [(130, None), (131, ""), (132, "x" * 199), (133, "x" * 200), (134, "y" * 201), (135, "z" * 5000), (136, "ab" * 120), (137, long[:200]), (138, "é" * 100)]
    docs += [(139, passage + passage), (140, long), (140, long), (None, long), (141, noise(20) + "\0" * 230 + noise(20))]
    return docs


@pytest.mark.parametrize("group, shard, bits", [(2048, 1 << 19, 20), (4, 4000, 8), (1, 1, 20)])
def test_repeats(spark, monkeypatch, group, shard, bits):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1 << bits)
    docs = corpus(group)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, rid int, bytes string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.without_repeats(df).collect()), key=str)
    assert got == plain(docs)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.without_repeats(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert {tuple(r)[:4] for r in suffix_dedup.without_repeats(df).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}
