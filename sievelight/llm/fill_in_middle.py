"""Fill-in-middle forms of documents, cut at token ranks.

Tokens are runs of ASCII letters and single other characters, so whether a token
starts at a character follows from it and its left neighbour. Texts fall into
chunks that overlap by that one neighbour; the chunks of all texts of a batch are
counted at once, prefix sums tell which chunk owns a rank, and only the owners of
the two cuts are looked at again. Everything but the two ranks is Spark's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk, and of what is counted at once.
CHUNK, SLAB = 1 << 12, 1 << 22
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def chances(key: Column) -> list[Column]:
    """Four numbers under 2^32 that follow from a document's key; a null key counts as an empty text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _marks(data: np.ndarray, begin: int, end: int, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes from begin to end: whether a token, and whether a code point starts. opens: where texts begin."""
    overlap = data[max(begin - 1, 0) : end]
    letter = _LETTER[overlap]
    before = letter[:-1] if begin else np.concatenate([[False], letter[:-1]])
    letter = letter[1:] if begin else letter
    before = before.copy()
    before[opens[(opens >= begin) & (opens < end)] - begin] = False
    point = (data[begin:end] & 0xC0) != 0x80
    return point & ~(letter & before), point


def _cut_positions(data: np.ndarray, offsets: np.ndarray, chance: np.ndarray, chunk: int, slab: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the code points before the cuts that the numbers in ``chance`` (two a text) choose."""
    begin, length = offsets[:-1], np.diff(offsets)
    per_text = -(-length // chunk)
    first = np.concatenate([[0], np.cumsum(per_text)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], per_text)
    edge = np.repeat(begin, per_text) + k * chunk
    until = np.minimum(edge + chunk, np.repeat(offsets[1:], per_text))
    opens = np.unique(begin[length > 0])
    tokens, points = np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64)
    at = 0
    while at < len(edge):
        to = max(at + 1, int(np.searchsorted(until, edge[at] + slab, side="right")))
        token, point = _marks(data, edge[at], until[to - 1], opens)
        inner = edge[at:to] - edge[at]
        tokens[at:to] = np.add.reduceat(token, inner, dtype=np.int64)
        points[at:to] = np.add.reduceat(point, inner, dtype=np.int64)
        at = to
    tokens_to, points_to = np.concatenate([[0], np.cumsum(tokens)]), np.concatenate([[0], np.cumsum(points)])
    n = tokens_to[first[1:]] - tokens_to[first[:-1]]
    chars = points_to[first[1:]] - points_to[first[:-1]]
    ranks = np.sort(chance % (n[:, None] + 1), axis=1)
    before = np.repeat(chars[:, None], 2, axis=1)
    for i, j in np.argwhere(ranks < n[:, None]):
        wanted = tokens_to[first[i]] + ranks[i, j]
        owner = int(np.searchsorted(tokens_to, wanted, side="right")) - 1
        token, point = _marks(data, edge[owner], until[owner], opens[np.searchsorted(opens, edge[owner]) :][:1])
        inside = np.flatnonzero(token)[wanted - tokens_to[owner]]
        before[i, j] = points_to[owner] - points_to[first[i]] + np.count_nonzero(point[:inside])
    return n, before


def _cutter(columns: list[str], chunk: int, slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("_text")
            wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
            _, offsets, data = text.buffers()
            if len(text) == 0:
                continue
            offsets = np.frombuffer(offsets, wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            chance = np.stack([batch.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in (1, 2)], axis=1)
            n, before = _cut_positions(data, offsets, chance, chunk, slab)
            found = [pa.array(x, pa.int64()) for x in (n, before[:, 0], before[:, 1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, "_n", "_one", "_two"])

    return run


def transform(documents: DataFrame, key: str = "doc_id", text: str = "text", fim_percent: int = 90, spm_percent: int = 20, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """Documents with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The first two of ``chances(key)`` choose the ranks of the cuts, the third
    whether a document is transformed, the fourth its order of parts. Defined
    results: a null or empty text has no tokens and stays plain and empty, as does
    as it stands a text that holds a mark already; rows that repeat a key are cut
    alike if their texts are equal; a null key counts as an empty one; texts of
    any length are counted in chunks (a batch holds whole rows, so memory follows
    the longest text, not the table); an empty table gives an empty table; columns
    of the input named like an added one are replaced.
    """
    h = chances(F.col(f"`{key}`"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = without(documents.columns, ADDED)
    rows = documents.select(*(F.col(f"`{c}`") for c in kept), whole.alias("_text"), *(x.alias(f"_h{i}") for i, x in enumerate(h, 1)))
    columns = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    cut = rows.mapInArrow(_cutter(columns, chunk, slab), f"{kinds}, _n long, _one long, _two long")
    t = F.col("_text")
    has_mark = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((t == "") | has_mark | (F.col("_h3") % 100 >= fim_percent), "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    part = {
        "prefix": F.substring(t, F.lit(1), F.col("_one").cast("int")),
        "middle": F.substring(t, F.col("_one").cast("int") + 1, (F.col("_two") - F.col("_one")).cast("int")),
        "suffix": F.substring(t, F.col("_two").cast("int") + 1, F.lit(2**31 - 1)),
    }
    psm = F.concat(F.lit(PREFIX), part["prefix"], F.lit(SUFFIX), part["suffix"], F.lit(MIDDLE), part["middle"])
    spm = F.concat(F.lit(SUFFIX), part["suffix"], F.lit(PREFIX), part["prefix"], F.lit(MIDDLE), part["middle"])
    cut = cut.withColumn("form", form)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", psm).otherwise(spm)
    shown = F.col("form") != "plain"
    return cut.select(
        *(F.col(f"`{c}`") for c in kept), F.col("_n").alias("n"), "form", F.when(shown, F.col("_one")).alias("prefix_chars"),
        F.when(shown, F.col("_two") - F.col("_one")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; a transformed text holds no mark of its own, so each mark is found once."""
    at = {mark: F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE)}
    rest = F.lit(2**31 - 1)
    between = lambda a, b: F.substring(output, at[a] + 3, at[b] - at[a] - 3)
    middle = F.substring(output, at[MIDDLE] + 3, rest)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
