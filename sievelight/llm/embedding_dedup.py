"""Near-duplicate vectors through iterative quantisation and Hamming tables.

Vectors are centred and rotated so that their signs make balanced binary codes:
starting from a random rotation of the principal axes, codes and rotation are
fitted to each other in turn. A few such codes, from different starts, are cut
into substrings, and each substring is a table of its own. Vectors of the same
label that share a table entry are compared by their original components. Large
entries are cut into blocks and every pair of blocks is one task's work; links
are counted and reduced to a spanning forest there, so pairs are never written.

Equal vectors of a label are one, weighed by their number, before anything is
compared. Tables grow with the largest label: a code's substrings get one bit
more whenever it doubles, and there are as many tables as keep the chance to
meet. The most frequent lengths have codes of their own; vectors of any other
length are compared with all of that length and label, block by block.

Defined results: a vector that is null, zero, or holds null or non-finite
components links with nothing, as does one without a label; vectors of different
lengths do not link; equal vectors link with each other; ties in the kept vector
go to the smallest ``vec_id``. ``vec_id`` must not repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, without
from .components import components

#: Expected number of vectors that the rotations are fitted on; all vectors are indexed and compared.
FIT_VECTORS = 20_000
#: Lengths of vectors that have codes, the most frequent ones.
CODED_LENGTHS = 8
#: Bits of one table's substring: as few, and as many, and vectors of the largest label for one entry of a table.
FEWEST_BITS, MOST_BITS, PER_ENTRY = 12, 24, 4
#: The chance that a bit differs between vectors at cosine 0.93, and that no table brings such vectors together.
BIT_DIFFERS, MISSED = 0.12, 0.026
#: Vectors of one block; an entry with more is compared block by block.
BLOCK = 1024
#: Groups of up to so many vectors are compared together, row against shifted row.
SMALL = 48


class Codes:
    """Rotations fitted on a sample; gives each vector one number per table."""

    def __init__(self, sample: np.ndarray, bits: int = FEWEST_BITS, rounds: int = 40, seed: int = 7):
        tables = max(1, round(np.log(MISSED) / np.log1p(-((1 - BIT_DIFFERS) ** bits))))
        rotations = -(-tables // max(1, sample.shape[1] // min(bits, sample.shape[1])))
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        dims = sample.shape[1]
        values, axes = np.linalg.eigh(centred.T @ centred / max(1, len(sample)) + 1e-9 * np.eye(dims))
        axes = axes[:, np.argsort(-values)]
        self.maps = []
        for r in range(rotations):
            rotation = np.linalg.qr(np.random.default_rng(seed + r).normal(size=(dims, dims)))[0]
            projected = centred @ axes
            for _ in range(rounds):
                signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
                u, _, vt = np.linalg.svd(projected.T @ signs)
                rotation = u @ vt
            self.maps.append(axes @ rotation)
        self.bits, self.per = min(bits, dims), max(1, dims // min(bits, dims))

    @property
    def tables(self) -> int:
        return len(self.maps) * self.per

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        weights = (1 << np.arange(self.bits)).astype(np.int32)
        out = []
        for m in self.maps:
            signs = ((vectors - self.mean) @ m >= 0).astype(np.int32)
            out += [signs[:, i * self.bits : (i + 1) * self.bits] @ weights for i in range(self.per)]
        return np.stack(out, axis=1).astype(np.int32)


def bits_for(largest: int) -> int:
    """Bits of a substring when the largest label has so many vectors."""
    return int(min(MOST_BITS, max(FEWEST_BITS, np.ceil(np.log2(max(1, largest / PER_ENTRY))))))


def valid(df: DataFrame) -> DataFrame:
    """Rows that can link: labelled, and a finite non-zero vector."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.Array) else column.combine_chunks()
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    peak = np.abs(rows).max(axis=1, keepdims=True)  # against overflow of squares
    rows = rows / peak
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest row that the links a-b reach."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs(vectors: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float):
    """Linked rows of each group, group after group for large ones and all small ones together."""
    sizes = ends - starts
    small = sizes <= SMALL
    of = np.repeat(np.arange(len(starts)), sizes)
    rows = np.flatnonzero(small[of])
    for lag in range(1, int(sizes[small].max(initial=1))):
        rows = rows[rows + lag < ends[of[rows]]]
        for lo in range(0, len(rows), 50_000):
            a = rows[lo : lo + 50_000]
            b = a + lag
            met = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
            met &= (block[a] != block[b]) | (i[a] == j[a])
            yield a[met], b[met]
    for g in np.flatnonzero(~small):
        s, first = slice(starts[g], ends[g]), starts[g]
        left = first + np.flatnonzero(block[s] == i[first])
        right = left if i[first] == j[first] else first + np.flatnonzero(block[s] == j[first])
        a, b = np.nonzero(vectors[left] @ vectors[right].T >= threshold)
        a, b = left[a], right[b]
        keep = a < b if i[first] == j[first] else slice(None)
        yield a[keep], b[keep]


def _compare(threshold: float):
    """Rows sorted by entry and pair of blocks: links first found in this table, and a spanning forest of all links."""

    def chunk(table: pa.Table) -> pa.RecordBatch:
        key = [table.column(n).to_numpy() for n in ENTRY[1:]]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(new))
        ids, block = table.column("vec_id").to_numpy(), table.column("block").to_numpy()
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        vectors = _matrix(table.column("embedding"))
        weight = table.column("weight").to_numpy()
        n_links, edges = np.zeros(len(ids), np.int64), []
        for a, b in _pairs(vectors, starts, ends, block, key[3], key[4], threshold):
            if not len(a):
                continue
            first = np.ones(len(a), bool)
            for t in range(codes.shape[1] - 1):
                first &= (codes[a, t] != codes[b, t]) | (t >= key[1][a])
            a1, b1 = a[first], b[first]
            np.add.at(n_links, a1, weight[b1])
            np.add.at(n_links, b1, weight[a1])
            rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            reached = rows[_forest(len(rows), at[: len(a)], at[len(a) :])]
            edges.append((ids[rows], ids[reached]))
        met = np.flatnonzero(n_links > 0)
        out = [(ids[met], n_links[met], ids[met])] + [(u[u != v], np.zeros((u != v).sum(), np.int64), v[u != v]) for u, v in edges]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["vec_id", "n_links", "to"])

    def chunks(table: pa.Table):
        """Groups of one length of vectors at a time."""
        dims = table.column("dims").to_numpy()
        edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield chunk(table.slice(lo, hi - lo).combine_chunks())

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            same = np.all([table.column(n).to_numpy() == table.column(n)[-1].as_py() for n in ENTRY], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on in the next batch
            if cut:
                yield from chunks(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from chunks(pa.Table.from_batches(held))

    return run


#: What the groups of vectors that are compared together have in common.
ENTRY = ("dims", "label", "table", "code", "i", "j")


def near_duplicates(df: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Add ``n_links, component_id, kept`` to vectors ``vec_id, embedding, label``.

    Only vectors of equal label are compared, by cosine in double precision.
    Extra columns are kept; columns named like a result are replaced. Rows of one
    ``vec_id`` are one vector, which links with others only, and each row gets its
    result once; if their vectors differ, the one with the smallest label, length
    and hashes counts, and others are left out. An empty table gives an empty one.
    """
    spark = df.sparkSession
    df = df.select(*(F.col(f"`{c}`") for c in without(df.columns, ("n_links", "component_id", "kept"))))
    alone = lambda: df.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id"), "kept": F.col("vec_id").isNotNull()})
    kind = {c: t for c, t in df.dtypes if c in ("vec_id", "label", "embedding")}
    # Two hashes, 128 bits, name a vector; the first of equal ones stands for all.
    named = valid(df).select("vec_id", "label", F.size("embedding").alias("dims"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    name = ["label", "dims", "h1", "h2"]
    ids = named.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct(*name)).alias("v")).select("vec_id", "v.*")
    equal = ids.groupBy(*name).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    equal = staged(equal.join(named.groupBy(*name).agg(F.first("embedding").alias("embedding")), name), "itq-vectors")
    lengths = equal.groupBy("dims").agg(F.sum(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(CODED_LENGTHS).collect()
    if not lengths:
        discard(equal)
        return alone()
    codes = {}
    for d, n in lengths:
        own = equal.where(F.col("dims") == d)
        largest = own.groupBy("label").count().agg(F.max("count")).first()[0]
        chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
        sample = own.where(chance < min(1.0, FIT_VECTORS / n)).select("embedding").limit(2 * FIT_VECTORS).toArrow()  # an expected FIT_VECTORS
        if sample.num_rows:
            codes[d] = Codes(_matrix(sample.column(0)), bits_for(largest))
    shared = spark.sparkContext.broadcast(codes)

    def coded(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                made = shared.value.get(int(d))
                found = made(_matrix(part.column(0))) if made else np.zeros((part.num_rows, 1), np.int32)
                of = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, of], names=["embedding", "dims", "vec_id", "label", "weight", "codes"])

    schema = f"embedding {kind['embedding']}, dims int, vec_id {kind['vec_id']}, label {kind['label']}, weight long, codes array<int>"
    rows = staged(equal.select("embedding", "dims", "vec_id", "label", "weight").mapInArrow(coded, schema), "itq-codes")
    entry = list(ENTRY[:4])
    light = rows.select("vec_id", "label", "dims", F.posexplode("codes").alias("table", "code"))
    sizes = staged(light.groupBy(*entry).agg(F.count("*").alias("n")).where("n > 1"), "itq-entries")
    # A vector goes to the pairs of blocks that its block is in; an entry of up to BLOCK vectors has one block. Vectors join last.
    placed = light.join(sizes, entry).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    pairs = pairs.select(*ENTRY, "block", "vec_id").join(rows.select("vec_id", "weight", "codes", "embedding"), "vec_id")
    work = pairs.select(*ENTRY, "block", "vec_id", "weight", "codes", "embedding").repartition(*ENTRY).sortWithinPartitions(*ENTRY)
    compared = staged(work.mapInArrow(_compare(threshold), f"vec_id {kind['vec_id']}, n_links long, to {kind['vec_id']}"), "itq-links")
    links = compared.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    classes = components(compared.where("vec_id != to").select(F.col("vec_id").alias("u"), F.col("to").alias("v")))
    found = equal.select(*name, "vec_id", "weight").join(links, "vec_id", "left").join(classes.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    found = staged(found.select(*name, (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "itq-found")
    # Every vector takes the result of the one that stands for it.
    judged = staged(ids.join(found, name).select("vec_id", "n_links", "component_id"), "itq-judged")
    discard(equal, rows, sizes, compared, classes, found)
    out = df.join(judged, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
