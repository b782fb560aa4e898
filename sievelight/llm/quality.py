"""Quality rules as a ledger of failure bits.

Each document is measured once and each rule judged once; the measurements and
one bit per failed rule are stored. Policies are versioned masks over the bits:
applying another policy, or asking what a policy would do without one of its
rules, reads the ledger alone.

Defined results: null and empty texts measure 0 everywhere (and fail
``few_words``); ties and repeated rows are judged each by itself; extra columns
are kept, and columns named like a measurement are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without
from .encoding import texts_of

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")

#: Rule name -> SQL condition on the measurements under which a document fails. A rule's bit is its place here.
RULES = {
    "few_words": "n_words < 50",
    "repeated_phrases": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "n_upper > n_lower",
}

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_phrases"),
    "v1": tuple(RULES),
}


def bit_of(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask_of(policy: str) -> int:
    return reduce(int.__or__, map(bit_of, POLICIES[policy]), 0)


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()  # on ASCII white space
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    with_word = dup = 0
    for line in lines:
        if line.strip(SPACES):
            with_word += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    n_space = len(raw) - len(raw.translate(None, SPACES))
    codes = np.frombuffer(raw, np.uint8)
    upper = int(np.count_nonzero((codes - np.uint8(65)) < 26))
    lower = int(np.count_nonzero((codes - np.uint8(97)) < 26))
    return (len(words), len(text) - n_space, len(raw) - len(raw.translate(None, SYMBOLS)), with_word, dup, repeat_words(words), upper, lower)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # keep the keys of triples below 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    triples = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(triples, kind="stable")
    same = triples[order[1:]] == triples[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements (long) of every whole text."""
    kept = without(df.columns, (*MEASURES, "failure_bits"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.array([measure_text(t) for t in texts_of(part.column(part.schema.get_field_index(text)))], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(found[:, i]) for i in range(len(MEASURES))], names=kept + list(MEASURES))

    return df.mapInArrow(run, schema)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and ``failure_bits`` (long): every rule judged once.

    Defined results: a null text is an empty one; rows that repeat are judged
    each; a text of any length is measured whole, in memory that follows it; an
    empty table gives an empty one; columns named like a measurement are replaced.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(c), F.lit(bit_of(r))).otherwise(F.lit(0)) for r, c in RULES.items()))
    return measure(df, text).withColumn("failure_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: str, to: str = "kept") -> DataFrame:
    """Add a boolean: no rule of the policy failed."""
    return rows.withColumn(to, F.col("failure_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: ``rule, failed, rejected_alone, rejected_without``.

    ``rejected_alone`` counts documents that no other rule of the policy rejects;
    ``rejected_without`` what the policy would reject without the rule. The rows
    are counted once by their bits (at most 2 to the number of rules), map-side first.
    """
    counts = rows.groupBy("failure_bits").agg(F.count("*").alias("n"))
    mask = mask_of(policy)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit_of(r)).alias("bit")) for r in POLICIES[policy]])).alias("r")
    held = counts.select("n", F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits"), rules).select("n", "bits", "r.*")
    others = F.col("bits").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("bit")))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return held.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"), total(F.col("bits") == F.col("bit")).alias("rejected_alone"), total(others != 0).alias("rejected_without")
    )
