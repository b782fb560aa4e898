"""Language identification by partial matching of byte contexts.

Each language has a tree of byte contexts up to ``ORDER`` bytes with the counts
of the bytes that followed. A byte seen after its longest context costs
-log2(c / (n + d)) bits, where n counts the context's followers and d the
distinct ones (escape method C, without exclusions); otherwise the escape
-log2(d / (n + d)) is paid and the context loses its oldest byte; after the empty
context all 256 bytes are equally likely. The statistics are frozen after
fitting, so a text's code length is a sum over its bytes of looked-up costs. The
language with the shortest code is predicted; the score is its posterior
probability under equal priors.

Defined results: null texts and texts without a letter are ``und`` with score 0;
equal code lengths go to the language first in alphabetical order; repeated rows
are judged each by itself; extra columns are kept, columns named ``lang_pred``
or ``score`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without
from .encoding import texts_of

ORDER = 3

#: Expected number of documents per language that a model is fitted on.
FIT_DOCUMENTS = 2000

#: Longer texts are coded a stretch of so many bytes at a time.
LONG = 1 << 18

#: What stands before a text's first byte.
PAD = b"\n" * ORDER

#: A model of more languages than this is refused: its size is their number times the sample of one.
MOST_LANGUAGES = 1000


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with its context as one number, and where each text's windows begin."""
    data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8).astype(np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    full = data[ORDER:].copy()
    for back in range(1, ORDER + 1):
        full |= data[ORDER - back : len(data) - back] << np.uint32(8 * back)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    keep = np.ones(len(full), bool)
    for at in (np.cumsum(lengths + ORDER)[:-1] - ORDER).tolist():  # windows that end in the next text's padding
        keep[at : at + ORDER] = False
    return full[keep], starts


class PpmModel:
    """Frozen costs: per order the known windows with a row of bits per language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        n_lang = len(self.languages)
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint32)] * (ORDER + 1)
        self.costs: list[np.ndarray] = [np.zeros((0, n_lang), np.float32)] * (ORDER + 1)
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint32)] * (ORDER + 1)
        self.escapes: list[np.ndarray] = [np.zeros((0, n_lang), np.float32)] * (ORDER + 1)
        for order in range(ORDER + 1 if counts else 0):
            self._fit_order(order, counts)

    @staticmethod
    def _cut(window: np.ndarray, order: int) -> np.ndarray:
        return window & np.uint32((1 << 8 * (order + 1)) - 1)

    def _fit_order(self, order: int, counts) -> None:
        seen = []
        for language in self.languages:
            grams, n = counts[language]
            keys, at = np.unique(self._cut(grams, order), return_inverse=True)
            seen.append((keys, np.bincount(at, n, len(keys))))
        keys = np.unique(np.concatenate([k for k, _ in seen]))
        contexts = np.unique(keys >> np.uint32(8))
        count = np.zeros((len(keys), len(seen)))
        for i, (k, n) in enumerate(seen):
            count[np.searchsorted(keys, k), i] = n
        of = np.searchsorted(contexts, keys >> np.uint32(8))
        total, distinct = np.zeros((len(contexts), len(seen))), np.zeros((len(contexts), len(seen)))
        np.add.at(total, of, count)
        np.add.at(distinct, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, np.log2(total + distinct) - np.log2(distinct), 0.0)
            direct = np.log2((total + distinct)[of]) - np.log2(count)
        below = self.bits(keys, order - 1)
        self.keys[order], self.contexts[order] = keys, contexts
        self.escapes[order] = escapes.astype(np.float32)
        self.costs[order] = np.where(count > 0, direct, escapes[of] + below).astype(np.float32)

    def bits(self, window: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code lengths in bits, a row per window and a column per language."""
        if order < 0:
            return np.full((len(window), len(self.languages)), 8.0, np.float32)
        keys = self._cut(window, order)
        if not len(self.keys[order]):
            return self.bits(window, order - 1)
        at = np.minimum(np.searchsorted(self.keys[order], keys), len(self.keys[order]) - 1)
        out = self.costs[order][at]
        missed = np.flatnonzero(self.keys[order][at] != keys)
        if len(missed):
            rest = self.bits(window[missed], order - 1)
            contexts = keys[missed] >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.contexts[order], contexts), len(self.contexts[order]) - 1)
            known = self.contexts[order][at] == contexts
            rest[known] += self.escapes[order][at[known]]
            out[missed] = rest
        return out

    def long_code(self, text: bytes) -> np.ndarray:
        """The code length of one long text, a stretch of it at a time, each after the bytes before it."""
        total, padded = np.zeros(len(self.languages)), PAD + text
        for at in range(0, len(text), LONG):
            stretch = np.frombuffer(padded[at : at + LONG + ORDER], np.uint8).astype(np.uint32)
            window = stretch[ORDER:].copy()
            for back in range(1, ORDER + 1):
                window |= stretch[ORDER - back : len(stretch) - back] << np.uint32(8 * back)
            total += self.bits(window).sum(axis=0, dtype=np.float64)
        return total

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code lengths of whole texts in bits, a row per text and a column per language."""
        long = {i: self.long_code(t) for i, t in enumerate(texts) if len(t) > LONG}
        if long:
            out = self.code_lengths([b"" if i in long else t for i, t in enumerate(texts)])
            for i, row in long.items():
                out[i] = row
            return out
        out = np.zeros((len(texts), len(self.languages)))
        filled = [i for i, t in enumerate(texts) if t]
        if filled:
            window, starts = windows([texts[i] for i in filled])
            edges = [*starts.tolist(), len(window)]
            at = 0
            while at < len(filled):  # a few hundred thousand bytes at a time
                to = at + 1
                while to < len(filled) and edges[to + 1] - edges[at] < 1 << 18:
                    to += 1
                bits = self.bits(window[edges[at] : edges[to]])
                out[filled[at:to]] = np.add.reduceat(bits, starts[at:to] - edges[at], axis=0, dtype=np.float64)
                at = to
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        has_letter = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = self.code_lengths([t.encode() if ok else b"" for t, ok in zip(texts, has_letter, strict=True)])
        best = bits.argmin(axis=1)
        lead = bits - bits[np.arange(len(bits)), best][:, None]
        score = 1 / np.exp2(-np.minimum(lead, 1000.0)).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, has_letter, strict=True)]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting; one without a number is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", documents: int = FIT_DOCUMENTS) -> PpmModel:
    """Fit on a bounded sample of rows with text and language.

    Per language an expected ``documents`` rows are used, chosen by a hash of the
    row, each with its whole text; rare languages are used fully. Counts are
    gathered by Spark; what reaches the driver is the model, bounded by the
    sample. Null texts and languages are left out; rows that repeat count once in
    the sample's draw for each; without rows the model knows no language, and
    ``predict`` then says ``und`` of every text.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[lang]: r["count"] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}  # a row per language
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"there are more than {MOST_LANGUAGES} languages")
    if not sizes:
        return PpmModel({})
    share = F.lit(None).cast("double")
    for language, n in sizes.items():
        share = F.when(F.col(lang) == language, F.lit(min(1.0, documents / n))).otherwise(share)
    chance = F.pmod(F.xxhash64(*[c for c in labelled.columns if not isinstance(labelled.schema[c].dataType, T.MapType)]), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                by: dict[str, list[bytes]] = {}
                for language, t in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    if t:
                        by.setdefault(language, []).append(t.encode())
                for language, texts in by.items():
                    grams, n = np.unique(windows(texts)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return PpmModel({language: (g["gram"].to_numpy().astype(np.uint32), g["n"].to_numpy()) for language, g in counts.groupby("lang")})


def predict(df: DataFrame, model: PpmModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) for every whole text; only the text is read."""
    kept = without(df.columns, ("lang_pred", "score"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                languages, scores = shared.value.predict(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return df.mapInArrow(run, schema)
