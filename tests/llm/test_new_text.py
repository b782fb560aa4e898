"""Fill-in-middle and spelling variants against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from sievelight.llm import fill_in_middle, queries, spelling  # noqa: E402
from tests.llm.test_small import DOCS, ODD, documents, prose  # noqa: E402

MARKED = ["a <P> b", "<S>", "x<M", "< P><", "ends with <", "<P", "é🙂" * 30, "aé" * 4000, "A" * 9000, "\n" * 5000, "word " * 2000, "\x00a\x00b"]


def brute_form(doc_id, text):
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return len(w), "spm" if spm else "psm", len(p), len(m), out


@pytest.mark.parametrize("chunk,slab", [(1, 7), (64, 1000), (fill_in_middle.CHUNK, fill_in_middle.SLAB)])
def test_fill_in_middle(spark, chunk, slab):
    rnd = random.Random(5)
    texts = [*ODD, *MARKED, *("".join(rnd.choice(["ab", "Z", "é", " ", "\n", "🙂", "<", "P>", "7"]) for _ in range(rnd.randrange(60))) for _ in range(300))]
    if chunk == 1:
        texts = texts[len(ODD) + len(MARKED) :]
    rows = spark.createDataFrame([(i if i else None, t, "mine", 7) for i, t in enumerate(texts)], "doc_id long, text string, Form string, other int").repartition(3)
    made = fill_in_middle.transform(rows, chunk=chunk, slab=slab).withColumn("again", fill_in_middle.restored(fill_in_middle.F.col("output"), fill_in_middle.F.col("form")))
    assert made.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()}
    assert got == {i if i else None: brute_form(i if i else None, t) for i, t in enumerate(texts)}
    assert all(r.again == (r.text or "") for r in made.collect())


def test_fill_in_middle_long_repeated_and_empty(spark):
    long = prose(8, 400_000)
    rows = spark.createDataFrame([(3, long), (3, long), (4, "x"), (4, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle.transform(rows).collect())
    assert got == sorted([(3, *brute_form(3, long))] * 2 + [(4, *brute_form(4, "x"))] * 2)
    assert fill_in_middle.transform(documents(spark, [])).count() == 0


def test_op12(spark, tmp_path):
    texts = [*ODD, *MARKED]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_fill_in_middle(spark, str(tmp_path)).collect():
        n, form, p, m, out = brute_form(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    form, out = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(others)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w], n[form[w]] if form[w] else None)
    return out


def spelled(seed, n):
    """Words that differ by an edit or two, some with runs of equal letters and letters beyond ASCII."""
    rnd = random.Random(seed)
    words = ["colour", "coloured", "centre", "Grèves", "aaaaa", "ÿÿÿÿÿ", "mississippi", "prefix×ed"]
    out = []
    for _ in range(n):
        w = list(rnd.choice(words))
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "s", "é", "R"])
        out.append("".join(w))
    return rnd.choice([" ", "\n", "-", "1"]).join(out)


def test_spelling_variants(spark, tmp_path):
    rows = [(i if i else None, spelled(i, 300)) for i in range(40)] + [(5, spelled(5, 300))] * 2 + [(90 + i, t) for i, t in enumerate([*ODD, *MARKED, "x" * 3000 + "y"] * 3)]
    want = brute_variants(rows)
    assert sum(bool(x[0]) for x in want.values()) > 50 and max(x[3] for x in want.values()) > 9
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == want


def test_spelling_radix_partitions_and_batches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "KEYS", 50)
    rows = [(i, spelled(i, 200)) for i in range(20)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, word int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}
    assert got == brute_variants(rows)
    assert spelling.group_variants(df.where("false")).count() == 0


def test_deletion_keys_and_collisions():
    words = ["abcde", "abXde", "abde", "été", "x" * 5000]
    number, place, keys = spelling.deletion_keys(words)
    by: dict = {}
    for i, p, k in zip(number, place, keys, strict=True):
        by.setdefault(spelling._rest(words[i], p), set()).add(int(k))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    # Strings whose hashes are equal but which are not: nothing may be linked.
    pa = spelling.pa
    t = pa.table({"hash": pa.array([1, 1, 1], pa.int64()), "place": pa.array([0, 0, -1], pa.int32()), "word": ["xabcd", "yabce", "qqqqq"], "n": [3, 4, 5]})
    assert spelling._met(t).num_rows == 0
