"""Passages that repeat anywhere, removed byte by byte, by a distributed merge sort of suffixes.

1. Every window of ``length`` bytes has an anchor: the leftmost of its grams (a
   quarter of the length) with the smallest hash. It depends on the window's bytes
   alone, so equal windows have their anchors at equal places. Windows whose
   anchor's gram occurs once cannot repeat; this only spares work.
2. At each other anchor the suffix is cut to what its windows reach, followed by
   the bytes before it from right to left. Tasks sort their suffixes into runs
   and hand them on front-coded (length of the prefix common with the one before,
   and the rest), split at sampled suffixes; equal ones are sent once.
3. Each range merges its runs with a loser tree that knows the common prefix of
   every head with the last winner and compares only what lies behind it. The
   common prefixes that come out tell at once which suffixes share the bytes from
   the anchor on; the same order of the parts before it tells the rest.
4. Where a gram is so frequent that a range ends within its suffixes, windows
   that may have an equal one beyond the end meet once more by their digests.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, with_partner, without, without_partner

LENGTH = 200
#: Suffixes of a range (mean) and of a sorted run at most; one suffix in so many is a sample; samples that reach the driver for a range.
SUFFIXES, RUN, SAMPLED, SAMPLES = 50_000, 65_536, 1024, 32
#: Window starts looked at together.
STRETCH = 1 << 17
ADDED = ["n_bytes", "n_removed", "n_spans", "kept"]
_KEY = ["_k1", "_k2"]

_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.default_rng(20260).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_of(length: int) -> int:
    return max(1, length // 4)


def _text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array in a row, and where each begins and the last ends."""
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, ...]]:
    """Of all windows, stretch by stretch: number of the text, anchor's place in ``data``, gram hash, first and last window start."""
    gram = gram_of(length)
    width = length - gram + 1
    powers, inverse = _powers(_BASE, stretch + length), _powers(pow(_BASE, -1, 1 << 64), stretch + length)
    place_mask = np.uint64((1 << (stretch + length).bit_length()) - 1)
    low, high = offsets[:-1], offsets[1:] - length + 1  # window starts of each text
    for a in range(int(offsets[0]), int(offsets[-1]) - length + 1, stretch):
        v = data[a : min(a + stretch + length - 1, int(offsets[-1]))]
        upto = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(_CODES[v] * powers[: len(v)], out=upto[1:], dtype=np.uint64)
        hashes = (upto[gram:] - upto[:-gram]) * inverse[: len(v) - gram + 1]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
        least = (hashes & ~place_mask) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        n = len(v) - length + 1
        least = np.minimum(least[:n], least[width - size : width - size + n])
        texts = slice(max(0, int(np.searchsorted(offsets, a, "right")) - 1), int(np.searchsorted(offsets, a + n)))
        begin, end = np.clip(low[texts] - a, 0, n), np.clip(high[texts] - a, 0, n)
        some = end > begin
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, begin[some], 1)
        np.add.at(change, end[some], -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(starts):
            continue
        at = (least[starts] & place_mask).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        first, last = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
        number = np.searchsorted(offsets, first + a, "right") - 1
        yield number, at[new] + a, hashes[at[new]], first + a, last + a


def _suffix(text: bytes, place: int, low: int, high: int, length: int) -> bytes:
    """The bytes from the anchor on (padded), those before it from right to left, and the least distance of a window start."""
    return text[place : place + length - low].ljust(length, b"\0") + text[place - high : place][::-1] + low.to_bytes(2, "big")


def _anchor_rows(length: int, sampled: int, stretch: int):
    names = [*_KEY, "place", "low", "high", "hash", "sample"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text_bytes(batch.column("_text"))
            k1, k2 = (batch.column(c).to_numpy() for c in _KEY)
            for number, at, hashes, first, last in anchors(data, offsets, length, stretch):
                place = at - offsets[number]
                chosen = (k1[number].view(np.uint64) ^ (place.astype(np.uint64) * np.uint64(_BASE))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
                sample: list[bytes | None] = [None] * len(at)
                for i in np.flatnonzero(chosen % np.uint64(sampled) == 0).tolist():
                    begin, end = int(offsets[number[i]]), int(offsets[number[i] + 1])
                    sample[i] = _suffix(data[max(begin, int(first[i])) : min(end, int(at[i]) + length)].tobytes(), int(at[i] - first[i]), int(at[i] - last[i]), int(at[i] - first[i]), length)
                values = [k1[number], k2[number], place.astype(np.int32), (at - last).astype(np.int16), (at - first).astype(np.int16), hashes.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array(sample, pa.binary())], names=names)

    return run


def _common_with_last(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string has in common with the one before it."""
    if len(strings) < 2:
        return np.zeros(len(strings), np.int64)
    size = np.array([len(s) for s in strings])
    width = int(size.max()) + 1
    out = np.zeros(len(strings), np.int64)
    for a in range(1, len(strings), 8192):
        part = strings[a - 1 : a + 8192]
        rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(len(part), width)
        differ = rows[1:] != rows[:-1]
        differ[:, -1] = True
        out[a : a + 8192] = differ.argmax(axis=1)
    out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


#: Columns of a piece of a run: numbers are packed arrays, little-endian.
_PIECE = "range int, common binary, sizes binary, rests binary, copies binary, docs binary, places binary, keys binary"


def _pieces(strings: list[bytes], doc: list[int], place: list[int], keys: np.ndarray, splitters: list[bytes]) -> pa.RecordBatch:
    """One sorted run, front-coded and split at the splitters."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    strings = [strings[i] for i in order]
    docs, places = np.array(doc, np.int64)[order], np.array(place, "<u4")[order]
    common = _common_with_last(strings)
    size = np.array([len(s) for s in strings])
    new = np.concatenate([[True], (common[1:] < size[1:]) | (size[1:] != size[:-1])])
    at = np.flatnonzero(new)
    copies = np.diff(np.append(at, len(strings)))
    once = [strings[i] for i in at.tolist()]
    cuts = [0, *(bisect.bisect_left(once, s) for s in splitters), len(once)]
    rows: list[tuple] = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == b:
            continue
        shared = common[at[a:b]].copy()
        shared[0] = 0
        rests = [s[c:] for s, c in zip(once[a:b], shared.tolist(), strict=True)]
        members = slice(at[a], at[b] if b < len(at) else len(strings))
        named, own = np.unique(docs[members], return_inverse=True)
        packed = (shared.astype("<u2"), np.array([len(x) for x in rests], "<u2"), b"".join(rests), copies[a:b].astype("<u4"), own.astype("<u4"), places[members], keys[named].astype("<i8"))
        rows.append((k, *(x if isinstance(x, bytes) else x.tobytes() for x in packed)))
    fields = [x.split() for x in _PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if t == "int" else pa.binary()) for v, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _run_maker(length: int, splitters: list[bytes], run_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[bytes] = []
        doc: list[int] = []
        place: list[int] = []
        keys: list[tuple[int, int]] = []
        for batch in batches:
            k1, k2 = (batch.column(c).to_pylist() for c in _KEY)
            spots = batch.column("spots")
            for i, text in enumerate(batch.column("_text").cast(pa.binary())):
                raw, own = text.as_py(), spots[i].values.flatten()
                keys.append((k1[i], k2[i]))
                for p, lo, hi in zip(*(x.to_pylist() for x in own), strict=True):
                    strings.append(_suffix(raw, p, lo, hi, length))
                    doc.append(len(keys) - 1)
                    place.append(p)
                    if len(strings) >= run_size:
                        yield _pieces(strings, doc, place, np.array(keys), splitters)
                        strings, doc, place, keys = [], [], [], [(k1[i], k2[i])]
        if strings:
            yield _pieces(strings, doc, place, np.array(keys), splitters)

    return run


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of all strings of sorted runs (run and number), and the prefix each has in common with the one before.

    A run comes with the common prefixes of its neighbours. A loser tree keeps for
    every head the prefix it shares with the last winner: of two heads the one
    that shares more is smaller, and only those that share as much are compared,
    behind what they share.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[bytes | None] = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(k)]
    at, known = [0] * k, [0] * k

    def duel(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        both = _common(x, y, known[a])
        if x[both : both + 1] <= y[both : both + 1]:
            known[b] = both
            return a, b
        known[a] = both
        return b, a

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = duel(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    order: list[tuple[int, int]] = []
    common: list[int] = []
    while heads[best] is not None:
        strings, shared = runs[best]
        i = at[best]
        order.append((best, i))
        common.append(known[best])
        at[best] = i = i + 1
        if i < len(strings):
            heads[best], known[best] = strings[i], shared[i]
        else:
            heads[best] = None
        node = (best + k) >> 1
        while node:
            best, losers[node] = duel(best, losers[node])
            node >>= 1
    return order, common


def _classes(common: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the runs of neighbours that share ``depth`` bytes or more."""
    return np.cumsum(common < depth)


_FOUND = "_k1 long, _k2 long, begin int, end int, digest binary, weight int"


def _range_merger(length: int, splitters: list[bytes]):
    gram = gram_of(length)
    width = length - gram + 1

    def run(table: pa.Table) -> pa.Table:
        here = table.column("range")[0].as_py()
        runs, members = [], []
        for row in table.to_pylist():
            shared, sizes, copies, docs, places = (np.frombuffer(row[c], t) for c, t in (("common", "<u2"), ("sizes", "<u2"), ("copies", "<u4"), ("docs", "<u4"), ("places", "<u4")))
            keys = np.frombuffer(row["keys"], "<i8").reshape(-1, 2)
            ends, strings, last = np.cumsum(sizes, dtype=np.int64).tolist(), [], b""
            for c, a, b in zip(shared.tolist(), [0, *ends], ends, strict=False):
                last = last[:c] + row["rests"][a:b]
                strings.append(last)
            runs.append((strings, shared.tolist()))
            members.append((np.concatenate([[0], np.cumsum(copies, dtype=np.int64)]), keys[docs], places.astype(np.int64)))
        order, common_list = merge(runs)
        common = np.array(common_list, np.int64)
        size = np.array([len(runs[r][0][i]) for r, i in order])
        new = np.concatenate([[True], (common[1:] < size[1:]) | (size[1:] != size[:-1])])
        group = np.cumsum(new) - 1
        at = np.flatnonzero(new).tolist()
        strings = [runs[order[i][0]][0][order[i][1]] for i in at]
        counts = np.bincount(group, weights=[int(members[r][0][i + 1] - members[r][0][i]) for r, i in order]).astype(np.int64)
        low = np.array([int.from_bytes(s[-2:], "big") for s in strings])
        high = np.array([len(s) for s in strings]) - length - 2
        after, n = np.minimum(common[at], length), len(strings)
        left = [s[length:-2] for s in strings]
        by_left = np.array(sorted(range(n), key=left.__getitem__))
        before = _common_with_last([left[i] for i in by_left.tolist()])
        reach = _beyond(strings, here, splitters, length, gram)
        hit = np.zeros((n, width), bool)
        crossing: list[tuple] = []
        left_class = np.empty(n, np.int64)
        for d in range(width):
            taking = np.flatnonzero((low <= d) & (d <= high))
            if not len(taking):
                continue
            left_class[by_left] = _classes(before, d)
            window = _classes(after, length - d)[taking] * (n + 1) + left_class[taking]
            sort = np.argsort(window, kind="stable")
            same = window[sort][1:] == window[sort][:-1]
            twice = np.zeros(len(taking), bool)
            twice[sort[1:]] |= same
            twice[sort[:-1]] |= same
            hit[taking, d] = twice | (counts[taking] > 1)
            wide = np.flatnonzero(reach[taking] >= length - d)
            if len(wide):
                first = wide[np.unique(window[wide], return_index=True)[1]]
                crossing += [(int(taking[i]), d) for i in first]
        out = _spans(hit, group, order, members, length)
        if crossing:
            rows = []
            for i, d in crossing:
                digest = hashlib.blake2b(left[i][:d][::-1] + strings[i][: length - d], digest_size=16).digest()
                if hit[i, d]:
                    rows.append((None, None, None, None, digest, 2))
                else:
                    r, j = order[at[i]]
                    first, keys, places = members[r]
                    m = int(first[j])
                    rows.append((int(keys[m, 0]), int(keys[m, 1]), int(places[m]) - d, int(places[m]) - d + length, digest, 1))
            out = pa.concat_tables([out, pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out.schema, strict=True)], schema=out.schema)])
        return out

    return run


def _beyond(strings: list[bytes], here: int, splitters: list[bytes], length: int, gram: int) -> np.ndarray:
    """How many bytes from its anchor on a suffix may share with one of another range. A splitter of a gram's length parts grams."""
    reach = np.zeros(len(strings), np.int64)
    for k in (here - 1, here):
        if 0 <= k < len(splitters) and len(splitters[k]) > gram:
            reach = np.maximum(reach, [_common(splitters[k][:length], s[:length], 0) for s in strings])
    return reach


def _spans(hit: np.ndarray, group: np.ndarray, order: list[tuple[int, int]], members: list[tuple], length: int) -> pa.Table:
    """Bytes of each document that lie in windows found twice."""
    edges = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    of, from_d = np.nonzero(edges == 1)
    to_d = np.nonzero(edges == -1)[1] - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(hit)))])
    parts: list[tuple[np.ndarray, ...]] = []
    of_run = np.array([r for r, _ in order])
    by_run = np.argsort(of_run, kind="stable")  # strings of a run are in its order
    bounds = np.searchsorted(of_run[by_run], np.arange(len(members) + 1))
    for r, (offsets, keys, places) in enumerate(members):
        row = np.repeat(group[by_run[bounds[r] : bounds[r + 1]]], np.diff(offsets))  # the group of each member
        times = first[row + 1] - first[row]
        m = np.repeat(np.arange(len(row)), times)
        span = np.repeat(first[row], times) + np.arange(len(m)) - np.repeat(np.cumsum(times) - times, times)
        parts.append((keys[m, 0], keys[m, 1], places[m] - to_d[span], places[m] - from_d[span] + length))
    k1, k2, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    none = pa.nulls(len(k1))
    return pa.table({"_k1": k1, "_k2": k2, "begin": begin.astype(np.int32), "end": end.astype(np.int32), "digest": none.cast(pa.binary()), "weight": none.cast(pa.int32())})


def _splitters(samples: list[bytes], ranges: int, gram: int) -> list[bytes]:
    """Where ranges begin: at sampled suffixes, or before all suffixes of their gram where the range before has another."""
    samples = sorted(samples)
    chosen = sorted({samples[len(samples) * k // ranges] for k in range(1, ranges)}) if samples else []
    return sorted({s if i and chosen[i - 1][:gram] == s[:gram] else s[:gram] for i, s in enumerate(chosen)})


def _keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.col(f"`{key}`")
    return documents.withColumns({"_text": whole, "_k1": F.xxhash64(own, whole), "_k2": F.xxhash64(whole, own, F.length(whole))})


def repeated_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, suffixes: int = SUFFIXES, run_size: int = RUN, sampled: int = SAMPLED, stretch: int = STRETCH) -> DataFrame:
    """``_k1, _k2`` (a document's digest, see ``_keyed``) and ``spans``: bytes of windows of ``length`` that start in two places or more.

    Memory of a task follows ``suffixes`` and ``run_size``. The driver holds about
    ``SAMPLES`` sampled suffixes for each range.
    """
    if not 2 <= length < 1 << 15:
        raise ValueError("length must be between 2 and 32767")
    keyed = _keyed(documents, key, text).select("_text", *_KEY)
    rows = keyed.where(F.octet_length("_text") >= length).mapInArrow(_anchor_rows(length, sampled, stretch), "_k1 long, _k2 long, place int, low short, high short, hash long, sample binary")
    every = staged(rows, "suffix-anchors")
    repeated = staged(every.groupBy("hash").count().where("count > 1").select("hash"), "suffix-grams")
    some = staged(with_partner(every, repeated, ["hash"]).drop("hash"), "suffix-candidates")
    discard(every, repeated)
    ranges = max(1, -(-some.count() // suffixes))
    samples = some.where("sample IS NOT NULL").select("sample")
    share = min(1.0, SAMPLES * ranges / max(1, samples.count()))
    thin = F.pmod(F.xxhash64("sample", F.lit(3)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    splitters = _splitters([r.sample for r in samples.where(thin).collect()], ranges, gram_of(length)) if ranges > 1 else []
    spots = staged(some.groupBy(*_KEY).agg(F.collect_set(F.struct("place", "low", "high")).alias("spots")), "suffix-spots")
    discard(some)
    texts = with_partner(keyed, spots.select(*_KEY), _KEY).join(spots, _KEY)
    pieces = texts.select(*_KEY, "_text", "spots").mapInArrow(_run_maker(length, splitters, run_size), _PIECE)
    found = staged(pieces.groupBy("range").applyInArrow(_range_merger(length, splitters), _FOUND), "suffix-found")
    discard(spots)
    met = found.where("digest IS NOT NULL").groupBy("digest").agg(F.sum("weight").alias("times")).where("times > 1").select("digest")
    across = found.where("digest IS NOT NULL AND weight = 1").join(met, "digest", "left_semi")
    spans = found.where("digest IS NULL").unionByName(across.select(found.columns))
    out = staged(spans.groupBy(*_KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "suffix-spans")
    discard(found)
    return out


def _cutter(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for text, spans in zip(batch.column("_text").cast(pa.binary()), batch.column("spans"), strict=True):
                raw = memoryview(text.as_py())
                begin, end = (np.array(x, np.int64) for x in spans.values.flatten())
                order = np.argsort(begin, kind="stable")
                begin, until = begin[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], begin[1:] > until[:-1]])
                first, last = begin[new].tolist(), until[np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)].tolist()
                removed.append(sum(last) - sum(first))
                runs.append(len(first))
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *last], [*first, len(raw)], strict=True)))
            found = [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, "n_removed", "n_spans", "kept"])

    return run


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **sizes: int) -> DataFrame:
    """Documents with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the bytes that are left).

    A byte goes if a string of ``length`` bytes that covers it starts in a second
    place as well, in this document or another. Defined results: null and empty
    texts, and texts under ``length`` bytes, lose nothing; rows that repeat are
    copies of each other, also with the same key; cuts may fall within a character,
    so ``kept`` is binary; texts of any length are read in stretches; a text of one
    repeated character has an anchor for each byte, which is the most there can
    be; an empty table gives an empty table; columns of the input named like an
    added one are replaced.
    """
    spans = repeated_spans(documents, key, text, length, **sizes)
    keyed = _keyed(documents, key, text)
    own: list[Column] = [F.col(f"`{c}`") for c in without(documents.columns, ADDED)]
    n_bytes = F.octet_length("_text").cast("long").alias("n_bytes")
    whose = spans.select(*_KEY)
    none = F.lit(0).cast("long")
    untouched = without_partner(keyed, whose, _KEY).select(*own, n_bytes, none.alias("n_removed"), none.alias("n_spans"), F.encode("_text", "UTF-8").alias("kept"))
    rows = with_partner(keyed, whose, _KEY).join(spans, _KEY).select(*own, n_bytes, "_text", "spans")
    columns = rows.columns[:-2]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*(f"`{c}`" for c in columns)).schema)
    touched = rows.mapInArrow(_cutter(columns), f"{kinds}, n_removed long, n_spans long, kept binary")
    return untouched.unionByName(touched)
