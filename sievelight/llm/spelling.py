"""Spelling variants: words one edit apart, found by hashes of deletions.

Two words differ by one edit if they share what a deletion leaves: at the same
place (a replaced letter), or with one of them left whole (an added letter). The
hash of every deletion follows from polynomial prefix and suffix hashes, so all
of a batch are NumPy integers at once. They are partitioned by their leading
bits, sorted within partitions, and what meets is verified on the strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

_ASCII, _LATIN = re.compile(rb"[a-z]+"), re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: A task counts so many different words before it hands them on; keys of one radix partition (mean); words of one batch of keys.
HELD, KEYS, WORDS = 200_000, 400_000, 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _noisy_counts(key: str, text: str, modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for k, t in zip(batch.column(key), batch.column(text).cast(pa.binary()), strict=True):
                low = (t.as_py() or b"").lower()  # of bytes: A to Z only
                words = (_ASCII if low.isascii() else _LATIN).findall(low)
                if not words:
                    continue
                counts.update(words)
                prefix = zlib.crc32(f"{'' if k.as_py() is None else k.as_py()}:".encode())
                for word in [w for w in set(words) if not zlib.crc32(w, prefix) % modulus]:
                    letters = word.decode()
                    at = zlib.crc32(word, prefix) % len(letters)
                    times = words.count(word)
                    counts[word] -= times
                    if len(letters) > 1:
                        counts[(letters[:at] + letters[at + 1 :]).encode()] += times
                if len(counts) >= HELD:
                    yield handed()
        if counts:
            yield handed()

    return run


def word_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n`` of all words of the texts after the letters that the checksum chooses are deleted.

    A checksum of key and word divided by ``modulus`` deletes one letter of all
    occurrences of a word in a document. Null texts hold no words, a null key
    counts as an empty one, and rows that repeat are counted as often as they
    stand there.
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counts = rows.mapInArrow(_noisy_counts("key", "text", modulus), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word whole and without each of its letters: the word's number, the place (-1: whole), the hash of what is left."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)])
    up, down = (_powers(b, len(points) + 1) for b in (_BASE, _INVERSE))
    upto = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[:-1], out=upto[1:], dtype=np.uint64)
    number = np.repeat(np.arange(len(words)), length)
    i, first, end = np.arange(len(points)), begin[:-1][number], begin[1:][number]
    left = (upto[i] - upto[first]) + (upto[end] - upto[i + 1]) * np.uint64(_INVERSE)
    whole = (upto[begin[1:]] - upto[begin[:-1]]) * down[begin[:-1]]
    keys = np.concatenate([whole, left * down[first]])
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    return np.concatenate([np.arange(len(words)), number]), np.concatenate([np.full(len(words), -1), i - first]), keys


def _keyed(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), WORDS):
                batch = whole_batch.slice(at, WORDS)
                number, place, keys = deletion_keys(batch.column("word").to_pylist())
                for a in range(0, len(keys), 1 << 17):
                    part = slice(a, a + (1 << 17))
                    own = batch.take(pa.array(number[part]))
                    radix = (keys[part] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(own), np.int32)
                    found = [pa.array(radix, pa.int32()), pa.array(keys[part].view(np.int64)), pa.array(place[part], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*found, own.column("word"), own.column("n")], names=["radix", "hash", "place", "word", "n"])

    return run


def _rest(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _met(table: pa.Table) -> pa.Table:
    """Of one radix partition: each word's count of near words there and the first of them."""
    hashes = table.column("hash").to_numpy()
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    some = np.zeros(len(order), bool)
    some[1:] |= same
    some[:-1] |= same
    order = order[some]
    rows = table.take(pa.array(order))
    hashes, places = rows.column("hash").to_numpy(), rows.column("place").to_pylist()
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    edges = [0, *(np.flatnonzero(hashes[1:] != hashes[:-1]) + 1).tolist(), len(words)]
    n_near: Counter[str] = Counter()
    best: dict[str, tuple[int, str]] = {}

    def offer(members: list[tuple[int, str]], to: list[tuple[int, str]], less: int) -> None:
        """All members are near to all of ``to`` (less themselves); the first two of the members are enough."""
        first = sorted(members)[:2]
        for own in to:
            n_near[own[1]] += len(members) - less
            other = next((x for x in first if x != own), None)
            if other:
                best[own[1]] = min(best.get(own[1], other), other)

    for a, b in zip(edges, edges[1:], strict=False):
        by_rest: dict[str, list[int]] = {}
        for i in range(a, b):
            by_rest.setdefault(_rest(words[i], places[i]), []).append(i)  # equal hashes of different strings part here
        for held in by_rest.values():
            if len(held) < 2:
                continue
            by_place: dict[int, list[tuple[int, str]]] = {}
            for i in held:
                by_place.setdefault(places[i], []).append((-counts[i], words[i]))
            whole = by_place.pop(-1, [])
            for members in by_place.values():
                if len(members) > 1:
                    offer(members, members, 1)
            if whole:
                # Deleting any letter of a run of equal ones leaves the same; only the first of a run counts.
                longer = [(-counts[i], words[i]) for i in held if places[i] == 0 or places[i] > 0 and words[i][places[i]] != words[i][places[i] - 1]]
                if longer:
                    offer(longer, whole, 0)
                    offer(whole, longer, 0)
    kept = list(best)
    return pa.table({"word": pa.array(kept, pa.string()), "n_near": pa.array([n_near[w] for w in kept], pa.int64()), "form_n": pa.array([-best[w][0] for w in kept], pa.int64()), "form": pa.array([best[w][1] for w in kept], pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n`` of the words (``word, n``; each once) that have a near word; form is the most frequent one, the smaller of equals.

    What a deletion leaves is shared by at most one word for each letter of the
    alphabet and place, so no key gathers more rows than that.
    """
    total = words.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    bits = max(0, int(total // KEYS).bit_length())
    keys = words.select("word", "n").mapInArrow(_keyed(bits), "radix int, hash long, place int, word string, n long")
    found = keys.groupBy("radix").applyInArrow(_met, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def group_variants(documents: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every counted word.

    A word's form is its most frequent near word (of equals the smaller) if that
    is at least ``ratio`` times as frequent, and its root the last of the chain of
    forms. Each form is ``ratio`` times as frequent as its word, so a chain is as
    long as the logarithm of the largest count, and pointers that double find its
    end. Defined results: null and empty texts hold no words; a null key counts as
    an empty one; repeated rows count as often as they stand there; ties go by
    code points; words of any length are hashed in linear time; an empty table
    gives no words; other columns of the input play no part.
    """
    words = staged(word_counts(documents, key, text, modulus, min_length, min_count), "spelling-words")
    near = near_words(words).withColumnRenamed("word", "_word")
    joined = words.join(near, F.col("word") == F.col("_word"), "left")
    enough = F.col("form_n") >= F.col("n") * ratio
    judged = staged(joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")), "spelling-forms")
    discard(words)
    roots = staged(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not roots.where("moved").isEmpty():
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = staged(roots.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        roots = step
    ends = roots.select("word", "root")
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
