"""The pipeline's stages on a small table, each against what it should keep."""

from __future__ import annotations

import collections
import os
import struct
import zlib

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sievelight.llm.common import shared_dir  # noqa: E402
from sievelight.llm import order_minhash, ppm_language, quality  # noqa: E402
from tests.llm.test_small import DOCS, brute_lines, prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    base = [prose(i, 90) + "\n" + prose(1000 + i, 90) for i in range(24)]
    near = base[3].split()
    near[50] += "x"
    texts = [*base, base[0], " ".join(near), None, "", "few words", base[1].upper(), "$$ " * 80, prose(77, 100) + "\n" + base[5].split("\n")[0]]
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = dict(corpus_pipeline.STAGES)
    assert list(after) == ["quality rules", "language ID", "line dedup", "MinHash near-dedup", "best-fit packing"]

    first = after["quality rules"](spark, docs, folder)
    fine = {d for d, t in texts.items() if not any(eval(c, dict(zip(quality.MEASURES, quality.measure_text(t), strict=True))) for c in quality.RULES.values())}  # noqa: S307
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == fine

    second = after["language ID"](spark, first, folder)
    kept = {r.doc_id for r in second.collect()}
    assert second.columns == docs.columns and len(kept) > 0 and kept <= fine

    third = after["line dedup"](spark, first, folder)
    gone = brute_lines({d: texts[d] for d in fine})
    left = {d: "\n".join(x for i, x in enumerate(texts[d].split("\n")) if (d, i) not in gone) for d in fine}
    left = {d: t for d, t in left.items() if t.split()}
    assert third.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in third.collect()} == {d: (t, len(t)) for d, t in left.items()}

    fourth = after["MinHash near-dedup"](spark, first, folder)
    hashed = {d: order_minhash.shingles(texts[d]) for d in sorted(fine)}
    alone = {d for d in fine if not any(e < d and order_minhash.aligned_similarity(hashed[d], hashed[e]) >= 0.8 for e in fine)}
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == alone


def brute_run(rows):
    """What the stages keep one after the other: doc_id -> text."""
    kept = {d: t for d, t, _ in rows if not any(eval(c, dict(zip(quality.MEASURES, quality.measure_text(t), strict=True))) for c in quality.RULES.values())}  # noqa: S307
    by = collections.defaultdict(list)
    for d, t, lang in rows:
        if d in kept and lang:
            by[lang].append(t.encode())
    model = ppm_language.PpmModel({k: np.unique(ppm_language.windows(v)[0], return_counts=True) for k, v in by.items()})
    found = zip(kept, *model.predict(list(kept.values())), strict=True)
    kept = {d: kept[d] for d, language, score in found if language != "und" and score >= corpus_pipeline.LEAST_SCORE}
    gone = brute_lines(kept)
    kept = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in kept.items()}
    kept = {d: t for d, t in kept.items() if t.split()}
    hashed, parent = {d: order_minhash.shingles(t) for d, t in kept.items()}, {d: d for d in kept}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d in kept:
        for e in kept:
            if e < d and (kept[d] == kept[e] or order_minhash.aligned_similarity(hashed[d], hashed[e]) >= 0.8):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: t for d, t in kept.items() if root(d) == d}


def test_run(spark, folder):
    """The whole chain against brute force: the same documents, with the same texts, are packed."""
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want, tok = {}, Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for d, t in brute_run(rows).items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[at : at + (1024 if k else first)]
            want[d, k] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(n.rpartition("-")[0] for n in set(os.listdir(shared)) - before) == ["MinHash-near-dedup", "packed"]  # what the result reads, and the last stage's input
    assert 20 < len(want) == len(got) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    used = collections.Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 1


def test_clashing_columns_and_repeated_rows(spark):
    """A user's columns named like what operators add stay as they are; equal rows become one, others of one number stay."""
    texts = [prose(1, 90), prose(1, 90), prose(2, 90), prose(3, 90)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t), "mine", 7, "own") for d, t in zip([1, 1, 1, 4], texts, strict=True)], DOCS + ", N_Words string, failure_bits int, Lang_Pred string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and {(r.N_Words, r.failure_bits, r.Lang_Pred) for r in out.collect()} == {("mine", 7, "own")}
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted({(1, texts[0]), (1, texts[2]), (4, texts[3])})


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
