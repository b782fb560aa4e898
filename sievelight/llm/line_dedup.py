"""Line de-duplication by a deletion-neighbourhood join, in DataFrame operations.

A line is the sequence of its words. Two lines are near duplicates if one word
inserted, deleted or replaced turns one into the other; the earliest occurrence
(by ``doc_id``, then line number) stays.

Only lines that may have a neighbour emit their neighbourhood: an edit leaves
the first or the last half of the shorter line untouched, so a line whose halves
occur in no other line has none. For the others every variant with one word left
out is emitted as a hash over words and their places, from running XORs before
and after the gap. Lines with equal variants at the same gap differ by a
replacement; a variant equal to a whole line differs by an insertion. In both
cases all that meet are neighbours, so each key needs to carry only the earliest
line, and groups of any size are aggregated before they are shuffled. The
earliest neighbour found is then confirmed by the edit distance of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sieved, staged, with_partner, without_partner

#: Lines with fewer words have equal lines but no near ones: one word is too much of them.
MIN_WORDS = 5


def normal_line(line: Column) -> Column:
    """The line's words with one space between them; words are what stands between ASCII white space."""
    odd = F.lit(False)
    for c in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\r\x0b\x0c]+", " "))).otherwise(F.trim(line))


def _lines(documents: DataFrame, text: str) -> DataFrame:
    """``doc_id, line_no, norm, n`` of lines with a word."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    rows = rows.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    rows = rows.select("doc_id", "line_no", normal_line(F.col("line")).alias("norm"))
    n = F.when(F.col("norm") == "", 0).otherwise(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    return rows.withColumn("n", n).where("n > 0")


def _identity() -> list[Column]:
    return [F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.col("n")]


def _half_keys() -> Column:
    """Hashes of the halves that one edit may leave untouched, against partners of n or n - 1 and n + 1 words."""
    head = lambda k: F.expr(f"hash(1, {k}, substring_index(norm, ' ', {k}))")
    tail = lambda k: F.expr(f"hash(2, {k}, substring_index(norm, ' ', -({k})))")
    half, less = "n div 2", "(n - 1) div 2"
    return F.array_distinct(F.array(*[f(f"int({k})") for f, k in ((head, half), (head, less), (tail, f"n - {half}"), (tail, f"n - 1 - {less}"))]))


def _within_one(a: Column, b: Column) -> Column:
    """Whether the word sequences are at most one edit apart: head and tail in common cover all but one word."""
    short = F.least(F.size(a), F.size(b))
    head = F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x == y), False), F.lit(0)) - 1, short)
    tail_a, tail_b = F.slice(F.reverse(a), F.lit(1), short), F.slice(F.reverse(b), F.lit(1), short)
    tail = F.coalesce(F.nullif(F.array_position(F.zip_with(tail_a, tail_b, lambda x, y: x == y), False), F.lit(0)) - 1, short)
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (head + tail >= F.greatest(F.size(a), F.size(b)) - 1)


def duplicate_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """Lines to leave out: ``doc_id, line_no`` (from 0), ``near`` (false: equal to an earlier line), ``keeper_doc_id, keeper_line_no``.

    The keeper is the earliest equal or neighbouring line, which may itself have
    an earlier neighbour. Defined results: null texts and null ``doc_id`` have no
    lines; lines of fewer than ``MIN_WORDS`` words have equal lines but no near
    ones; lines without a word are never duplicates; lines that differ only in
    white space are equal; rows that
    repeat a ``doc_id`` are one document whose lines have equal places, and
    lines at equal places are not each other's duplicates. An empty table has no
    lines. A text of any length is split where it is read, and its lines are rows
    of their own from then on.
    """
    lines = _lines(documents, text)
    occurrences = staged(lines.select("doc_id", "line_no", *_identity(), F.when(F.col("n") >= MIN_WORDS, _half_keys()).alias("halves")), "line-occurrences")
    firsts = occurrences.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves"))
    firsts = staged(firsts.select("h1", "h2", "n", "first.doc_id", "first.line_no", "copies", "halves"), "line-firsts")
    halves = firsts.select("h1", "doc_id", "line_no", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low != high").select("half")
    wanted = halves.select("half", "doc_id", "line_no").join(shared, "half", "left_semi").select("doc_id", "line_no").distinct()
    # The text of lines with possible neighbours, from their first occurrence.
    wanted = staged(wanted, "line-wanted")
    places = ["doc_id", "line_no"]
    again = _lines(with_partner(documents.select("doc_id", text), wanted.select("doc_id").distinct(), ["doc_id"]), text)
    held = staged(with_partner(again, wanted, places).dropDuplicates(places), "line-candidates")
    at = held.select("doc_id", "line_no", "n", F.posexplode(F.split("norm", " ")).alias("place", "word"))
    hashed = at.select("doc_id", "line_no", "n", "place", F.xxhash64("word", "place").alias("here"), F.xxhash64("word", F.col("place") - 1).alias("left"))
    line = Window.partitionBy("doc_id", "line_no").orderBy("place")
    whole_line = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gaps = hashed.withColumns({"upto": F.bit_xor("here").over(line), "left_upto": F.bit_xor("left").over(line), "left_all": F.bit_xor("left").over(whole_line)})
    # The words before the gap at their places, and those after it one place to the left.
    rest = F.col("upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("left_all")).bitwiseXOR(F.col("left_upto"))
    whole_key = F.struct(F.xxhash64("n", "upto").alias("variant"), F.lit(-1).alias("gap"))
    gap_key = F.struct(F.xxhash64(F.col("n") - 1, rest).alias("variant"), F.col("place").alias("gap"))
    both = F.when(F.col("place") == F.col("n") - 1, F.array(gap_key, whole_key)).otherwise(F.array(gap_key))
    keys = staged(gaps.select("doc_id", "line_no", F.explode(both).alias("key")).select("doc_id", "line_no", "key.variant", "key.gap"), "line-variants")
    place = F.struct("doc_id", "line_no")
    earliest = staged(keys.groupBy("variant", "gap").agg(F.min(place).alias("first"), F.count("*").alias("lines")), "line-earliest")
    by_variant = earliest.groupBy("variant").agg(
        F.min(F.when(F.col("gap") == -1, F.col("first"))).alias("whole"), F.min(F.when(F.col("gap") >= 0, F.col("first"))).alias("shortened")
    )
    equal_gaps = earliest.where("lines > 1 AND gap >= 0").select("variant", "gap", "first")
    across = by_variant.where("whole IS NOT NULL AND shortened IS NOT NULL")
    replaced = keys.join(equal_gaps, ["variant", "gap"]).select("doc_id", "line_no", "first")
    changed = keys.join(across, "variant").select("doc_id", "line_no", F.when(F.col("gap") == -1, F.col("shortened")).otherwise(F.col("whole")).alias("first"))
    met = staged(replaced.unionByName(changed).where(F.col("first") < place).distinct().select("doc_id", "line_no", F.col("first.doc_id").alias("keeper_doc_id"), F.col("first.line_no").alias("keeper_line_no")), "line-pairs")
    theirs = held.select(F.col("doc_id").alias("keeper_doc_id"), F.col("line_no").alias("keeper_line_no"), F.col("norm").alias("keeper_norm"))
    confirmed = met.join(held, places).join(theirs, ["keeper_doc_id", "keeper_line_no"]).where(_within_one(F.split("norm", " "), F.split("keeper_norm", " ")))
    confirmed = confirmed.groupBy(*places).agg(F.min(F.struct("keeper_doc_id", "keeper_line_no")).alias("k")).select(*places, "k.keeper_doc_id", "k.keeper_line_no")
    near = confirmed.select(F.col("doc_id").alias("f_doc"), F.col("line_no").alias("f_line"), "keeper_doc_id", "keeper_line_no")
    # Lines that occur once and have no neighbour need no further look.
    judged = firsts.select("h1", "h2", "n", F.col("doc_id").alias("f_doc"), F.col("line_no").alias("f_line"), "copies").join(near, ["f_doc", "f_line"], "left").where("copies > 1 OR keeper_doc_id IS NOT NULL")
    judged = staged(judged, "line-judged")
    same = ["h1", "h2", "n"]
    found = sieved(occurrences.select("doc_id", "line_no", *same), judged, same).where("_may").drop("_may").join(judged, same)
    is_first = (F.col("doc_id") == F.col("f_doc")) & (F.col("line_no") == F.col("f_line"))
    out = found.where(~is_first | F.col("keeper_doc_id").isNotNull())
    out = staged(out.select("doc_id", "line_no", is_first.alias("near"), F.coalesce("keeper_doc_id", "f_doc").alias("keeper_doc_id"), F.coalesce("keeper_line_no", "f_line").alias("keeper_line_no")).distinct(), "line-duplicates")
    discard(occurrences, firsts, wanted, held, keys, earliest, met, judged)
    return out


def line_report(documents: DataFrame, duplicates: DataFrame, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_lines, n_equal, n_near`` and ``dropped``, the dropped line numbers in order."""
    by_doc = duplicates.groupBy("doc_id").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_list("line_no")).alias("dropped"))
    n_lines = F.coalesce(F.size(F.split(F.col(text), "\n", -1)), F.lit(0)).cast("long")
    n_lines = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    rows = documents.select("doc_id", n_lines.alias("n_lines")).join(by_doc, "doc_id", "left")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "n_lines", F.coalesce("n_equal", none).alias("n_equal"), F.coalesce("n_near", none).alias("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_lines(documents: DataFrame, duplicates: DataFrame, text: str = "text") -> DataFrame:
    """Documents without their duplicate lines; all columns and rows stay, null texts stay null."""
    dropped = duplicates.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set("line_no").alias("_dropped"))
    whose = duplicates.select("doc_id").distinct()
    touched = with_partner(documents, whose, ["doc_id"])
    joined = touched.join(dropped, touched["doc_id"] == F.col("_of"))
    numbered = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("_dropped", s["i"]))
    clean = F.array_join(F.transform(numbered, lambda s: s["x"]), "\n")
    return without_partner(documents, whose, ["doc_id"]).unionByName(joined.select(*[clean.alias(c) if c == text else touched[c] for c in documents.columns]))
