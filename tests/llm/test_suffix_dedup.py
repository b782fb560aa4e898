"""Repeated passages against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from sievelight.llm import queries, suffix_dedup  # noqa: E402
from tests.llm.test_small import ODD, documents, prose  # noqa: E402


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]])) if len(b) else 0), kept))
    return out


def random_texts(seed, n, alphabet, length):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 4 * length))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(2 * length)))]
        for _ in range(rnd.randrange(3)):
            b = rnd.choice(base)
            i = rnd.randrange(len(b))
            parts += [b[i : i + rnd.randrange(2 * length)], "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(length)))]
        out.append("".join(parts))
    return out


SMALL = {"suffixes": 40, "run_size": 13, "sampled": 2, "stretch": 29}


@pytest.mark.parametrize("seed,alphabet,length,sizes", [(1, "abcdefgh", 12, SMALL), (2, "ab", 9, SMALL), (3, "aé\x00", 16, SMALL | {"suffixes": 7}), (4, "".join(map(chr, range(200, 900))), 3, {}), (5, "abcdefghijklmnop", 24, {})])
def test_brute_force(spark, seed, alphabet, length, sizes):
    texts = [None, "", "a", *random_texts(seed, 90, alphabet, length), *["".join("abcdé"[i % 4] for i in range(3 * length))] * 20, "a" * 200]
    rows = documents(spark, texts).withColumnRenamed("n_chars", "N_Bytes").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(rows, length=length, **sizes).collect()}
    assert got == dict(enumerate(brute(texts, length)))
    assert any(0 < x[1] < x[0] for x in got.values())


def test_one_gram_in_all_texts_spans_ranges(spark):
    """A phrase with different neighbours everywhere, pairs of which agree far enough on either side."""
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefghijkl") for _ in range(n))
    texts = []
    for _ in range(120):
        a, b = word(20), word(20)
        texts += [a + "PHRASE" + b, word(10) + a[-rnd.randrange(12) :] + "PHRASE" + b[: rnd.randrange(12)] + word(10)]
    rows = documents(spark, texts)
    for suffixes in (30, 10**6):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(rows, length=16, suffixes=suffixes, run_size=50, sampled=1).collect()}
        assert got == dict(enumerate(brute(texts, 16)))


def test_rows_that_repeat_and_no_rows(spark):
    rows = spark.createDataFrame([(1, prose(1, 80)), (1, prose(1, 80)), (2, prose(2, 80)), (None, "x" * 199), (None, "x" * 199)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(rows).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (1, len(prose(1, 80)), 1), (1, len(prose(1, 80)), 1), (2, 0, 0)]
    assert suffix_dedup.without_repeats(rows.where("false")).count() == 0


def test_op11_with_long_texts(spark, tmp_path):
    long = prose(9, 60_000)
    texts = [*ODD, long, long[1000:90_000] + "!" + long[90_001:150_000], prose(12, 500) + long[77:400], "é" * 150, "é" * 99 + "x"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op11_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, m, k, hashlib.sha256(kept).hexdigest()) for i, (n, m, k, kept) in enumerate(brute(texts, 200))}


def test_loser_tree():
    rnd = random.Random(3)
    runs = []
    for _ in range(11):
        strings = sorted("".join(rnd.choice("ab\x00") for _ in range(rnd.randrange(12))).encode() for _ in range(rnd.randrange(1, 30)))
        runs.append((strings, suffix_dedup._common_with_last(strings).tolist()))
    order, common = suffix_dedup.merge(runs)
    merged = [runs[r][0][i] for r, i in order]
    assert merged == sorted(s for strings, _ in runs for s in strings)
    assert common[1:] == [suffix_dedup._common(a, b, 0) for a, b in zip(merged, merged[1:], strict=False)]


def test_equal_windows_have_anchors_at_equal_places():
    rnd = np.random.default_rng(4)
    data = rnd.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2600] = data[300:900]
    offsets = np.array([0, 1500, 1500, 3000])
    for stretch in (50, 1 << 12):
        chosen = {}
        for number, at, _, first, last in suffix_dedup.anchors(data, offsets, 40, stretch):
            for n, p, a, b in zip(number, at, first, last, strict=True):
                assert offsets[n] <= a and b + 40 <= offsets[n + 1]
                chosen |= {s: p - s for s in range(a, b + 1)}
        assert sorted(chosen) == [s for s in range(2961) if s + 40 <= 1500 or s >= 1500]
        assert all(chosen[s] == chosen[s + 1700] for s in range(300, 861))
