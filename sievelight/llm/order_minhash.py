"""Near-duplicate documents by order MinHash and banded alignment.

A document is the sequence of its five-word shingles, each labelled with its
occurrence number. For each of several random orders the smallest ``PICK``
labelled shingles are taken and kept in text order; their sequence is one sketch.
Two documents share a sketch with a chance that falls with their edit distance,
not only with the overlap of their sets. Texts of at most ``SHORT`` shingles are
too short for chance: they also emit their whole sequence and every sequence
with one shingle left out, which any two of them at 0.8 have in common.
Documents that share a key are candidates. Candidates are verified by aligning
their shingles within the band that the threshold allows: similarity is
matched / (n1 + n2 - matched), the Jaccard measure of an alignment, and 0.8 or
more is a link.

Equal texts are one vertex from the start, named by the digest of the text. In a
bucket of one key every member is first aligned with a pivot, the member whose
keys are the most common. Where this leaves a bucket's members in different
components, all pairs between components are looked at, block by block inside
tasks: shared shingles are counted first, and pairs that share enough are
aligned until the components are one. So no link between components is lost, and
pairs are never written. Texts are read once more for candidates alone; what is
shuffled of them are the candidates' shingle hashes.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, sieved, staged, with_partner
from .components import components
from .encoding import texts_of

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 12
PICK = 4
#: Texts of up to so many shingles emit keys of their own: a pair of them at 0.8 differs by one shingle.
SHORT = 9
#: Shingle bytes of a bucket's members that one task compares with as many others.
BLOCK_BYTES = 4 << 20
#: A shingle that occurs more often gets a bit set of its own when texts are aligned.
DENSE = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.array([0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1 for i in range(64)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's word shingles in order; a text with fewer words than a shingle has one, without words none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mix(out + h[k : k + n])
    return out


def occurrence_labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle's hash with the number of its earlier occurrences mixed in."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    new = np.concatenate([[True], run[1:] != run[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    number = np.empty(len(s), np.uint64)
    number[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return _mix(s + number * _SEEDS[63])


def sketches(s: np.ndarray) -> np.ndarray:
    """Order-MinHash sketches of a sequence of shingles as one hash each."""
    if not len(s):
        return np.zeros(0, np.int64)
    labelled, pick = occurrence_labelled(s), min(PICK, len(s))
    at = np.empty((SKETCHES, pick), np.int64)
    for k in range(SKETCHES):
        at[k] = np.argpartition(_mix(labelled ^ _SEEDS[k]), pick - 1)[:pick] if pick < len(s) else np.arange(pick)
    at.sort(axis=1)
    value = np.zeros(SKETCHES, np.uint64)
    for j in range(pick):
        value = _mix(value + labelled[at[:, j]])
    return _mix(value + _SEEDS[:SKETCHES]).view(np.int64)


def short_keys(s: np.ndarray) -> np.ndarray:
    """Hashes of a short sequence and of all sequences with one shingle left out; none for longer ones."""
    if not 0 < len(s) <= SHORT:
        return np.zeros(0, np.int64)
    found = {xxhash.xxh3_64_intdigest(x.tobytes()) for x in (s, *(np.delete(s, i) for i in range(len(s)))) if len(x)}
    return np.array(sorted(found), np.uint64).view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Jaccard measure of the best alignment within the band in which ``least`` can be reached.

    Exact whenever it is at least ``least``; otherwise some value below.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    most = int((n + m) * (1 - least) / (1 + least) + 1e-9)  # unmatched shingles that the threshold allows
    if abs(n - m) > most:
        return 0.0
    short = min(n, m)
    differs = a[:short] != b[:short]
    head = int(np.argmax(differs)) if differs.any() else short
    differs = a[n - (short - head) :][::-1] != b[m - (short - head) :][::-1]
    tail = int(np.argmax(differs)) if len(differs) and differs.any() else short - head
    matched = head + tail + _banded_matches(a[head : n - tail], b[head : m - tail], most)
    return matched / (n + m - matched)


class _Places:
    """Bits of the places of a value in a sequence, seen through a window that only moves forward."""

    def __init__(self, places: list[int]):
        self._places, self._bits, self._base, self._next = places, 0, 0, 0

    def seen(self, low: int, high: int) -> int:
        places = self._places
        if len(places) <= DENSE:
            bits = 0
            for p in places[bisect_left(places, low) : bisect_left(places, high)]:
                bits |= 1 << p - low
            return bits
        self._bits >>= low - self._base
        self._base = low
        while self._next < len(places) and places[self._next] < high:
            if places[self._next] >= low:
                self._bits |= 1 << places[self._next] - low
            self._next += 1
        return self._bits


def _banded_matches(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence with |i - j| <= band, bit-parallel along a window of 2 * band + 1 places of ``a``."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    where = {x: _Places(p) for x, p in places.items()}
    width = min(len(a), 2 * band + 1)
    full = (1 << width) - 1
    state, low, matched = full, 0, 0  # a zero bit: the matches grow by one at that place
    for j, y in enumerate(b.tolist()):
        if j - band >= len(a):
            break
        if j - band > low:  # one place leaves the window at its foot, one comes in at its head
            matched += not state & 1
            state = state >> 1 | 1 << width - 1
            low += 1
        found = where.get(y)
        if found is not None:
            carry = state & found.seen(low, min(len(a), j + band + 1))
            if carry:
                state = ((state + carry) | (state - carry)) & full
    return matched + width - state.bit_count()


def digest_of(text: str) -> Column:
    """A text's digest: equal digests are equal texts."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def signatures(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, digest, n_shingles, sketches, short`` of every whole text that is not null."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingles(t) for t in texts_of(part.column(2))]
                columns = [pa.array([f(s) for s in own], pa.list_(pa.int64())) for f in (sketches, short_keys)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in own], pa.int64()), *columns], names=["doc_id", "digest", "n_shingles", "sketches", "short"])

    rows = documents.where(F.col(text).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), digest_of(text).alias("digest"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, n_shingles long, sketches array<long>, short array<long>")


def _shingled(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).tobytes() for t in texts_of(part.column(1))], pa.binary())], names=["digest", "shingles"])


def _verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Of pairs ``u, v`` of digests those whose shingles align."""
    own = pairs.join(held.select(F.col("digest").alias("u"), F.col("shingles").alias("a")), "u")
    both = own.join(held.select(F.col("digest").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                met = [aligned_similarity(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), least) >= least for pair in zip(part.column(2), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(met, pa.bool_()))

    return both.mapInArrow(run, "u binary, v binary")


def _counts(rows: list[np.ndarray]):
    """For one row after another, how many labelled shingles it shares with each row."""
    values = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for r in rows:
        low, high = np.searchsorted(values, r, "left"), np.searchsorted(values, r, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield np.bincount(owner[at], minlength=len(rows))


def _block_links(least: float):
    """Links between components among the members of two blocks of a bucket, enough to connect what is linked."""

    def run(group: pa.Table) -> pa.Table:
        i, j, band = (group.column(n)[0].as_py() for n in ("i", "j", "band"))
        block, ids = group.column("block").to_numpy(), group.column("digest").to_pylist()
        names = {c: k for k, c in enumerate(dict.fromkeys(group.column("c").to_pylist()))}
        parts = np.array([names[c] for c in group.column("c").to_pylist()], np.int64)
        own = group.column("sketches").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        plain = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        labelled = [occurrence_labelled(s) for s in plain]
        sizes = np.array([len(s) for s in plain])
        parent = list(range(len(names)))

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        us, vs = [], []
        for x, shared in enumerate(_counts(labelled)):
            if block[x] != i:
                continue
            may = (shared >= least * (sizes + sizes[x] - shared) - 1e-9) & (parts != parts[x])
            may &= (block == j) if i != j else (np.arange(len(ids)) > x)
            for y in np.flatnonzero(may):
                # A pair of rows is looked at in the first bucket that they share.
                if (own[x, :band] == own[y, :band]).any() or root(parts[x]) == root(parts[y]):
                    continue
                if aligned_similarity(plain[x], plain[y], least) >= least:
                    parent[root(parts[x])] = root(parts[y])
                    us.append(ids[x])
                    vs.append(ids[y])
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def near_duplicates(documents: DataFrame, least: float = SIMILARITY, text: str = "text") -> DataFrame:
    """Per row ``doc_id, component_id, kept, digest``: the smallest ``doc_id`` of its class, whether it is that one, and of which text.

    Defined results: a null text is a class of its own; empty texts are equal
    texts; texts with fewer than five words link only if all their words are
    equal; every row is judged by its own text and returned, so rows that repeat
    a ``doc_id`` are in one class only if their texts are equal or alike, and of
    alike ones under the class's smallest number those with one text are kept;
    a row with a null ``doc_id`` is kept, alone, with a null class. An empty table
    gives an empty one. A text of any length is one row of hashes, eight bytes a
    word; texts themselves are not joined.
    """
    signed = staged(signatures(documents, text), "omh-signed")
    firsts = staged(signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "sketches", "short"))), "omh-firsts")
    entries = firsts.select("digest", "doc_id", "n_shingles", F.posexplode(F.concat("sketches", "short")).alias("place", "key"))
    entries = entries.select("digest", "doc_id", "n_shingles", F.least("place", F.lit(SKETCHES)).alias("band"), "key")
    bucket = ["band", "key"]
    sizes = staged(entries.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum(8 * F.col("n_shingles") + 64).alias("bytes")).where("n > 1"), "omh-buckets")
    members = staged(sieved(entries, sizes, bucket).where("_may").drop("_may").join(sizes, bucket), "omh-members")
    central = members.groupBy("digest").agg(F.sum("n").alias("weight"))
    weighed = members.join(central, "digest")
    pivots = staged(weighed.groupBy(*bucket).agg(F.max(F.struct("weight", -F.col("doc_id"), "digest", "n_shingles")).alias("p")).select(*bucket, F.col("p.digest").alias("pivot"), F.col("p.n_shingles").alias("m")), "omh-pivots")
    wanted = staged(members.select("doc_id", "digest").distinct(), "omh-wanted")
    rows = documents.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    likely = with_partner(rows, wanted.select("doc_id").distinct(), ["doc_id"]).withColumn("digest", digest_of("text"))
    held = likely.join(wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select("digest", "text")
    held = staged(held.mapInArrow(_shingled, "digest binary, shingles binary"), "omh-shingles")
    near = F.least("n_shingles", "m") >= F.lit(least) * F.greatest("n_shingles", "m") - 1e-9
    pairs = members.join(pivots, bucket).where(near & (F.col("digest") != F.col("pivot"))).select(F.col("digest").alias("u"), F.col("pivot").alias("v")).distinct()
    pairs = staged(pairs, "omh-pairs")
    links = staged(_verified(pairs, held, least), "omh-links")
    found = components(links)
    classes = found.select(F.col("id").alias("digest"), "component")
    # Buckets whose members are in several components: all members but the pivot with each other, in blocks.
    wide = members.where("n > 2").join(classes, "digest", "left").withColumn("c", F.coalesce("component", "digest")).drop("component")
    mixed = wide.join(pivots.select(*bucket, "pivot"), bucket).where("digest != pivot")
    still = mixed.groupBy(*bucket).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high").select(*bucket)
    mixed = mixed.join(still, bucket, "left_semi")
    mixed = mixed.withColumn("blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    mixed = staged(mixed.select(*bucket, "i", "j", "block", "digest", "c"), "omh-mixed")
    more = None
    if not mixed.isEmpty():
        loaded = mixed.join(firsts.select("digest", "sketches"), "digest").join(held, "digest")
        more = staged(loaded.groupBy(*bucket, "i", "j").applyInArrow(_block_links(least), "u binary, v binary"), "omh-links")
        if not more.isEmpty():
            discard(found)
            found = components(links.unionByName(more))
            classes = found.select(F.col("id").alias("digest"), "component")
    # The first text of each class, from one row per distinct text; then the rows get it by their text.
    named = firsts.select("digest", "doc_id").join(classes, "digest", "left").withColumn("class", F.coalesce("component", "digest"))
    lowest = named.groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    named = named.join(lowest, "class").select("digest", F.col("first.doc_id").alias("component_id"), (F.col("digest") == F.col("first.digest")).alias("is_first"))
    judged = signed.select("digest", "doc_id").join(named, "digest").select("doc_id", "component_id", ((F.col("doc_id") == F.col("component_id")) & F.col("is_first")).alias("kept"), "digest")
    alone = documents.where(F.col("doc_id").isNull() | F.col(text).isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("component_id"), F.lit(True).alias("kept"), digest_of(text).alias("digest"))
    out = judged.unionByName(alone)
    out = staged(out, "omh-classes")
    discard(signed, firsts, sizes, members, pivots, wanted, held, pairs, links, found, mixed, more)
    return out
