"""Bulk-synchronous best-fit packing of token sequences.

Documents are cut into pieces of at most ``capacity`` tokens. All bins that the
total size calls for are opened, and supersteps follow. In each, unplaced items
and free gaps are range-sorted together by size over the cluster; every range is
swept in ascending order, where a gap takes the largest waiting item that fits
it (equal sizes: by rank, that is by the order of ids). What a range cannot
settle by itself is settled between ranges from their counts alone: the r-th
item left over in one range meets the r-th gap left over in a later one. Matched
gaps shrink, and the next superstep begins. When nothing fits any more, as many
bins are opened as the rest needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, without
from .encoding import library_encoder, texts_of

#: Rows of one range of a superstep; a task holds a range's sizes and ids in memory.
RANGE_ROWS = 250_000

#: Runs of items of one length of at most this part of the capacity move as one.
BUNDLE_PART = 32


def token_pieces(documents: DataFrame, vocabulary_path: str, end_id: int, capacity: int, text: str = "text") -> DataFrame:
    """Pieces of whole encoded documents: ``doc_id, piece, start, length, ids`` (binary uint32).

    A null text is encoded as an empty one. A document of more than ``capacity``
    tokens becomes full pieces, the first of which may be shorter. Rows that
    repeat are documents of their own; an empty table gives no pieces; a text of
    any length is encoded whole and leaves the task piece by piece.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())  # a fixed public file of under two megabytes

    def cut(batches):
        encoder, end = library_encoder(vocabulary.value), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = ([], [], [], [], [])
                for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    ids = encoder.encode(text) + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        for column, value in zip(rows, (doc_id, k, a, b - a, ids[4 * a : 4 * b]), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])
        encoder.forget()

    rows = documents.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _bundled(capacity: int):
    """Sorted pieces of a range: runs of short ones of equal length share a leader and an inner offset."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        length_now, run_at = -1, 0
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            leader, inner = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i, n in enumerate(lengths.tolist()):
                size = max(1, capacity // BUNDLE_PART // n)
                if n != length_now or run_at >= size:
                    length_now, run_at, first = n, 0, (part << 33) + seen
                leader[i], inner[i] = first, run_at * n
                run_at += 1
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leader), pa.array(inner)], names=[*batch.schema.names, "item", "inner"])

    return run


def _swept(batches):
    """One range of items (kind 0) and gaps (kind 1) in ascending size; mates within it, order of the rest."""
    tables = [pa.table({n: b.column(n) for n in ("size", "kind", "id")}) for b in map(lambda b: b, batches)]
    if not tables:
        return
    table = pa.concat_tables(tables)
    size, kind, ids = (table.column(n).to_numpy() for n in ("size", "kind", "id"))
    mate = np.full(len(size), -1, np.int64)  # row of the partner
    waiting: list[int] = []
    for i, k in enumerate(kind.tolist()):
        if k == 0:
            waiting.append(i)
        elif waiting:
            j = waiting.pop()
            mate[i], mate[j] = j, i
    place = np.full(len(size), -1, np.int64)
    place[waiting] = np.arange(len(waiting))
    gaps_left = np.flatnonzero((kind == 1) & (mate < 0))
    place[gaps_left] = np.arange(len(gaps_left))
    part, met = TaskContext.get().partitionId(), mate >= 0
    keep = ~(met & (kind == 1))  # a matched pair is told by its item
    at = np.flatnonzero(keep)
    partner = np.where(met[at], mate[at], 0)
    none = ~met[at]
    for lo in range(0, len(at), 50_000):
        s = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at[s]), part, np.int64)),
                pa.array(kind[at[s]].astype(np.int32)),
                pa.array(ids[at[s]]),
                pa.array(size[at[s]]),
                pa.array(ids[partner[s]], mask=none[s]),
                pa.array(size[partner[s]], mask=none[s]),
                pa.array(place[at[s]]),
            ],
            names=["range", "kind", "id", "size", "gap_id", "gap_size", "place"],
        )


_SWEPT = "range long, kind int, id long, size long, gap_id long, gap_size long, place long"


def _between(counts: list) -> list[tuple[int, int, int, int, int]]:
    """Matches between ranges from each range's numbers of items and gaps left: (kind, range, lo, hi, first pair).

    A range's gaps come before its items for what lies outside it. The pair
    number of an item at place p is first + hi - 1 - p, of a gap first + p - lo.
    """
    waiting: list[list[int]] = []
    found, pair = [], 0
    for part, items, gaps in counts:
        at = 0
        while at < gaps and waiting:
            source, n = waiting[-1]
            take = min(n, gaps - at)
            found.append((0, source, n - take, n, pair))
            found.append((1, part, at, at + take, pair))
            pair, at = pair + take, at + take
            if take == n:
                waiting.pop()
            else:
                waiting[-1][1] = n - take
        if items:
            waiting.append([part, items])
    return found


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length`` from 1 to ``capacity``.

    Pieces with the same length are interchangeable; ties go by ``doc_id`` and
    ``piece``, then by place. Every piece is placed once; the pieces of a
    sequence fill it from 0 without gaps. Extra columns are kept; columns named
    ``item, inner, sequence_id, offset, place_at`` are replaced. Pieces that
    repeat ``doc_id`` and ``piece`` are pieces of their own; no pieces give no rows.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*(F.col(f"`{c}`") for c in without(pieces.columns, ("item", "inner", "sequence_id", "offset", "place_at"))))
    n = pieces.count()
    parts = max(1, -(-n // RANGE_ROWS))
    names = [*pieces.columns, "item", "inner"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", item long, inner long"
    order = ["length", *(c for c in ("doc_id", "piece") if c in pieces.columns)]
    pieces = staged(pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_bundled(capacity), schema).select(*names), "pack-pieces")
    items = pieces.groupBy("item").agg(F.sum("length").alias("size"))
    full = items.where(F.col("size") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("place_at"))
    items = staged(items.where(F.col("size") < capacity), "pack-items")
    gaps = spark.createDataFrame([], "id long, size long")
    placed, opened, held, least = [full], 0, [pieces, items], None
    n_items, n_gaps, stuck = items.count(), 0, True
    while n_items:
        if stuck:
            left = items.agg(F.sum("size").alias("tokens"), F.min("size").alias("least"), F.count_if(F.col("size") * 2 > capacity).alias("big")).first()
            more, least = max(-(-left.tokens // capacity), left.big), left.least
            new = spark.range(opened, opened + more).select((-1 - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("size"))
            gaps, opened, n_gaps = gaps.unionByName(new), opened + more, n_gaps + more
        gaps = gaps.where(F.col("size") >= least)
        both = items.select("size", F.lit(0).alias("kind"), F.col("item").alias("id")).unionByName(gaps.select("size", F.lit(1).alias("kind"), "id"))
        parts = max(1, -(-(n_items + n_gaps) // RANGE_ROWS))
        swept = staged(both.repartitionByRange(parts, "size", "kind", "id").sortWithinPartitions("size", "kind", "id").mapInArrow(_swept, _SWEPT), "pack-swept")
        held.append(swept)
        rest = F.col("gap_id").isNull()
        is_item, is_gap = rest & (F.col("kind") == 0), rest & (F.col("kind") == 1)
        counts = swept.groupBy("range").agg(
            F.count_if(is_item).alias("i"), F.count_if(is_gap).alias("g"), F.count_if(~rest).alias("met"), F.min(F.when(is_item, F.col("size"))).alias("least")
        )
        counts = sorted(tuple(r) for r in counts.collect())  # a row per range of RANGE_ROWS rows
        cross = _between([c[:3] for c in counts])
        n_met = sum(c[3] for c in counts)
        n_cross = sum(c[3] - c[2] for c in cross if c[0] == 0)
        stuck = not n_cross and not n_met
        n_items, n_gaps = sum(c[1] for c in counts) - n_cross, sum(c[2] for c in counts) + n_met
        least = min((c[4] for c in counts if c[4] is not None), default=least)  # of what no range could place: at most the least that is left
        spans = F.broadcast(spark.createDataFrame(cross, "kind int, range long, lo long, hi long, first long"))  # at most four rows per range
        open_rows = swept.where(rest).drop("gap_id", "gap_size")
        inside = (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
        settled = swept.where(~rest).select("id", "size", "gap_id", "gap_size")
        lone = open_rows
        if cross:
            met = open_rows.join(spans, ["range", "kind"]).where(inside)
            pair = met.withColumn("pair", F.when(F.col("kind") == 0, F.col("first") + F.col("hi") - 1 - F.col("place")).otherwise(F.col("first") + F.col("place") - F.col("lo")))
            joined = pair.where("kind = 0").select("pair", F.col("id"), "size").join(pair.where("kind = 1").select("pair", F.col("id").alias("gap_id"), F.col("size").alias("gap_size")), "pair").drop("pair")
            joined = staged(joined, "pack-cross")
            held.append(joined)
            settled = settled.unionByName(joined)
            covered = spans.select("range", "kind", "lo", "hi")
            lone = open_rows.join(covered, (open_rows["range"] == covered["range"]) & (open_rows["kind"] == covered["kind"]) & inside, "left_anti")
        placed.append(settled.select(F.col("id").alias("item"), F.col("gap_id").alias("sequence_id"), (F.lit(capacity) - F.col("gap_size")).alias("place_at")))
        items = lone.where("kind = 0").select(F.col("id").alias("item"), "size")
        gaps = lone.where("kind = 1").select("id", "size").unionByName(settled.select(F.col("gap_id").alias("id"), (F.col("gap_size") - F.col("size")).alias("size")).where("size > 0"))
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    out = staged(pieces.join(where, "item").withColumn("offset", F.col("place_at") + F.col("inner")).drop("item", "inner", "place_at"), "packed")
    discard(*held)
    return out
