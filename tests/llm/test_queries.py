"""The registered corpus queries that SQL cannot express, whole, against the public libraries and brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import struct
import zlib

import pytest

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from sievelight.llm import queries  # noqa: E402
from tests.llm.test_small import DOCS, ODD, prose  # noqa: E402

SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "<|endoftext|>", "<|endoftext|̸>", prose(40, 1500) + " <|endoftext|> the end"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rnd = random.Random(11)
    texts = [*ODD, *SPECIAL, *(prose(60 + i, rnd.choice([5, 60, 300, 900])) for i in range(40)), *[prose(61, 60)] * 12]
    ids = rnd.sample(range(-5, 500), len(texts))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in zip(ids, texts, strict=True)], DOCS).repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path), dict(zip(ids, texts, strict=True))


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op3(spark, folder):
    path, texts = folder
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_byte_bpe(spark, path).collect()}
    want = {}
    for d, t in texts.items():
        ids = other.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def test_op8(spark, folder):
    from tokenizers import Tokenizer

    path, texts = folder
    other = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_bit_packed_ids(spark, path).collect()}
    want, start = {}, 0
    for d in sorted(texts):
        ids = [*other.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        want[d] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == want


def test_op10(spark, folder):
    from tokenizers import Tokenizer

    path, texts = folder
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows, seen = queries.op10_best_fit_packing(spark, path).collect(), collections.defaultdict(list)
    want = {}
    for d, t in texts.items():
        ids = [*other.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[at : at + (1024 if k else first)]
            want[d, k] = (at, len(part), crc(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        seen[r.sequence_id].append((r.offset, r.length))
    for held in seen.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 1024
    assert len(seen) <= brute_best_fit([n for _, n, _ in want.values()])


def brute_best_fit(lengths):
    """Sequences that plain best fit of the longest first needs."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 1024) - n)
    return len(gaps)


def test_op6(spark, folder):
    path, texts = folder
    rows = queries.op6_label_propagation(spark, path).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    counts = collections.Counter(r.shard for r in rows)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    # Twelve copies and their like in quotas of one and two cannot do better than fill shards.
    where = collections.defaultdict(collections.Counter)
    for r in rows:
        if texts[r.doc_id] is not None:
            where[texts[r.doc_id]][r.shard] += 1
    quota = max(counts.values())
    cut = sum(len(w) for w in where.values() if sum(w.values()) > 1)
    best = sum(-(-sum(w.values()) // quota) for w in where.values() if sum(w.values()) > 1)
    assert cut <= best + 2
