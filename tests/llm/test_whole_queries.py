"""op5 and op7 as whole queries against brute force, and all text queries on texts of a megabyte."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import pytest

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers as P  # noqa: E402

from sievelight.llm import order_minhash, ppm_language, queries  # noqa: E402
from tests.llm.test_small import DOCS, ODD, brute_measures, documents, prose  # noqa: E402


def alike(a, b):
    return order_minhash.aligned_similarity(a, b) >= 0.8


def test_op5_links_pairs_near_the_bound_at_all_lengths(spark, tmp_path):
    """A text and a copy with as many changed words as 0.8 allows, or one more; most lie within a few hundredths of the bound."""
    rnd = random.Random(8)
    texts = list(ODD)
    for n in (6, 13, 14, 20, 30, 50, 60, 100, 150, 300, 600):
        for k in range(12):
            w = prose(1000 * n + k, n).split()
            # A changed word inside breaks five shingles of either text, so one in 45 may change; the last word breaks one.
            inside = (n - 4) // 45 + k % 3 - 1
            other = list(w)
            for at in rnd.sample(range(5, n - 5), inside) if n > 15 and inside > 0 else [-1]:
                other[at] += "q"
            texts += [" ".join(w), " ".join(other)]
    hashed = [order_minhash.shingles(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or alike(hashed[i], hashed[j])):
                links += texts[i] != texts[j]
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.component_id, r.kept) for r in queries.op5_order_minhash(spark, str(tmp_path)).collect()}
    want = {i: (root(i), root(i) == i) for i in range(len(texts))}
    missed = [i for i in want if want[i] != got[i]]
    assert links > 60 and sum(a != b for a, b in zip(texts[len(ODD) :: 2], texts[len(ODD) + 1 :: 2], strict=True)) > links and len(missed) <= 0.02 * links  # a pair at the bound is met with probability 0.992 at least
    assert all(got[i][1] for i in missed)  # what is missed is a link, never one too many


def brute_bits(counts, text):
    """Code length by the definition: the longest known context, escapes by method C, at last one of 256."""
    padded, total = ppm_language.PAD + text, 0.0
    for i in range(len(text)):
        context, byte = padded[i : i + ppm_language.ORDER], padded[i + ppm_language.ORDER]
        for order in range(ppm_language.ORDER, -1, -1):
            followers = counts.get(context[len(context) - order :])
            if followers is None:
                continue
            n, d = sum(followers.values()), len(followers)
            if followers[byte]:
                total += math.log2((n + d) / followers[byte])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_op7_predictions_and_scores_of_a_whole_table(spark, tmp_path):
    rnd, words = random.Random(9), {"aa": "abra cada bra nada", "bb": "ytre wqui opl ytr", "cc": "éta üro ñan ça"}
    rows = []
    for i in range(160):
        lang = rnd.choice(list(words))
        rows.append((i, " ".join(rnd.choice(words[lang].split()) for _ in range(rnd.randrange(1, 12))), lang if i % 9 else None, "s", 1))
    rows += [(200 + i, t, None, "s", 1) for i, t in enumerate(["", None, "12 34", "abra ytre", "ç", "abra\nabra 7"])]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    counts: dict = {k: collections.defaultdict(collections.Counter) for k in words}
    for i, t, lang, *_ in rows:
        if lang and not held[i]:
            padded = ppm_language.PAD + t.encode()
            for at in range(ppm_language.ORDER, len(padded)):
                for order in range(ppm_language.ORDER + 1):
                    counts[lang][padded[at - order : at]][padded[at]] += 1
    got = {r.doc_id: r for r in queries.op7_ppm_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert r.held_out == held[i]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        bits = {k: brute_bits(counts[k], t.encode()) for k in words}
        best = min(bits, key=bits.get)
        score = 1 / sum(2.0 ** -(b - bits[best]) for b in bits.values())
        assert r.score == pytest.approx(score, rel=2e-3) and (r.lang_pred == best or score < 0.51)


def test_texts_of_a_megabyte(spark, tmp_path):
    from tokenizers import Tokenizer

    long = prose(5, 150_000)
    lines = "\n".join(prose(i, 9) for i in range(15_000))
    near = long.replace(" the ", " thee ", 20)
    texts = [long, long, near, lines, "漢" * 350_000, "x" * 1_000_000, "short text here", ""]
    assert min(map(len, texts[:4])) > 700_000
    documents(spark, texts).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    folder = str(tmp_path)
    one = {r.doc_id: r for r in queries.queries()["op1_quality_rules"](spark, folder).collect()}
    for i in (0, 3, 4, 5):
        assert (one[i].n_words, one[i].word_chars, one[i].n_symbols, one[i].n_dup_lines, one[i].n_repeat_words) == brute_measures(texts[i])
    two = {r.doc_id: (r.n_lines, r.n_equal) for r in queries.op2_line_dedup(spark, folder).collect()}
    assert two[3][0] == 15_000 and two[1] == (1, 1) and two[0] == (1, 0)
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    three = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in queries.op3_byte_bpe(spark, folder).collect()}
    for i in (2, 3):
        assert three[i] == (len(other.encode_ordinary(texts[i])), hashlib.sha256(texts[i].encode()).hexdigest())
    assert all(three[i][1] == hashlib.sha256(texts[i].encode()).hexdigest() for i in three)
    five = {r.doc_id: r.component_id for r in queries.op5_order_minhash(spark, folder).collect()}
    assert five == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    six = {r.doc_id: r.size for r in queries.op6_label_propagation(spark, folder).collect()}
    assert six == {i: len(t.encode()) + 16 for i, t in enumerate(texts)}
    eight = {r.doc_id: r.n_tokens for r in queries.op8_bit_packed_ids(spark, folder).collect()}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert all(eight[i] == len(tok.encode(texts[i], add_special_tokens=False).ids) + 1 for i in (2, 3, 6, 7))
    ten = collections.Counter()
    for r in queries.op10_best_fit_packing(spark, folder).collect():
        ten[r.doc_id] += r.length
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert all(ten[i] == len(tok.encode(texts[i], add_special_tokens=False).ids) + 1 for i in (2, 3, 6, 7))
