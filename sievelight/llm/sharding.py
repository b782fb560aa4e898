"""Sharding by balanced label propagation, in DataFrame operations.

Documents with equal texts are linked. Every shard has a quota of rows, the
quotas being at most one apart. Linked documents start spread evenly; in each
round a group of linked documents looks at how its members are spread and asks
for the shard that holds most of them (in every second round: of the shards with
room). What may move from shard to shard is settled from counts alone: moves
against each other are exchanged, others need room, and no shard passes its
quota. Groups move as a whole unless they are large against a quota. Documents
without links then fill each shard up to its quota, so that the counts are equal
and few links are cut but for lack of room.

Which shard and slot a row gets follows from the rows' contents, not from how
they are partitioned; rows equal in number and text are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sieved, staged

ROUNDS = 40
#: Fine steps in which moves from shard to shard are granted.
STEPS = 32
#: Rows that are numbered together in one task, and counts of so many that are.
NUMBERED, COUNTED = 100_000, 2048
#: Groups with at least this part of all rows are at most so many, and are broadcast.
MANY = 4096


def _numbered(df: DataFrame, rows: int, within: list[str], to: str) -> DataFrame:
    """Gapless numbers from 0 in each ``within``, by hash, without gathering a group in one task."""
    parts = max(1, -(-rows // NUMBERED))
    cut = df.withColumn("_part", F.pmod(F.xxhash64("mark"), F.lit(parts)).cast("int"))
    keys = [*within, "_part"]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_top", (F.col("_part") / COUNTED).cast("int"))
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = counts.groupBy(*within, "_top").agg(F.sum("_n").alias("_n"))
    tops = tops.select(*within, "_top", before(within, "_top").alias("_above"))
    offsets = counts.withColumn("_before", before([*within, "_top"], "_part")).join(tops, [*within, "_top"]).select(*keys, (F.col("_above") + F.col("_before")).alias("_before"))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy("mark", "rid")) - 1)
    return local.join(offsets, keys).withColumn(to, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_before", "_local")


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def assign(documents: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The law is ``rows``: counts of any two shards are at most one apart. Defined
    results: a null text has size 16, CRC 0 and no links; empty texts are equal
    texts; rows that repeat a ``doc_id`` (or have none) are rows of their own;
    fewer rows than shards leave shards empty; an empty table gives an empty one.
    Texts are hashed where they are read and never moved, so their length does
    not matter.
    """
    known = F.col(text).isNotNull()
    rows = documents.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(known, F.xxhash64(text)).alias("hash"),
    )
    rows = staged(rows.withColumn("mark", F.xxhash64("doc_id", "hash", "text_crc32", "size")), "shard-rows")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    same = ["hash", "text_crc32", "size"]
    groups = rows.where("hash IS NOT NULL").groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")
    groups = staged(groups.withColumn("gid", F.xxhash64(*same)), "shard-groups")
    least = -(-total // MANY)
    large, small = F.broadcast(groups.where(F.col("n") >= least)), groups.where(F.col("n") < least)  # at most MANY large ones
    likely = sieved(rows, groups, same).where("_may").drop("_may")
    both = likely.join(large, same).unionByName(likely.join(large.select(*same), same, "left_anti").join(small, same))
    linked = staged(both.select("rid", "mark", "gid", "n"), "shard-linked")
    n_linked = linked.count()
    spread = staged(_numbered(linked, n_linked, [], "at").select("rid", "mark", "gid", "n", F.pmod("at", F.lit(shards)).cast("int").alias("shard")), "shard-labels")
    discard(groups, linked)
    linked = _propagated(spread, quota, max(1, total // shards // 64), least)
    used = dict.fromkeys(range(shards), 0) | {r.shard: r["count"] for r in linked.groupBy("shard").count().collect()}
    free = rows.join(linked.select("rid"), "rid", "left_anti").select("rid", "mark")
    free = _numbered(free, total - n_linked, [], "at")
    shard, upto = F.lit(shards - 1), sum(quota[s] - used[s] for s in range(shards - 1))
    for s in reversed(range(shards - 1)):
        shard = F.when(F.col("at") < upto, F.lit(s)).otherwise(shard)
        upto -= quota[s] - used[s]
    labels = linked.select("rid", "shard").unionByName(free.select("rid", shard.cast("int").alias("shard")))
    final = staged(labels, "shard-final")
    placed = _numbered(rows.join(final, "rid"), -(-total // shards), ["shard"], "slot")
    out = staged(placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "shards")
    discard(rows, linked, final)
    return out


def granted(asked: dict[tuple[int, int], list[int]], room: list[int]) -> dict[tuple[int, int], int]:
    """For each pair of shards the number of steps whose rows may move, so that no shard takes more than it gives and has room for.

    ``asked`` has the rows of each step for pairs (from, to).
    """
    total = {k: sum(v) for k, v in asked.items()}
    left, allowed = list(room), {}
    for k, n in total.items():
        allowed[k] = min(n, total.get(k[::-1], 0))
    for k, n in sorted(total.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[k], left[k[1]])
        allowed[k] += more
        left[k[1]] -= more
    steps, moved = {}, {}
    for k, rows in asked.items():
        n, sent = 0, 0
        while n < len(rows) and sent + rows[n] <= allowed[k]:
            sent += rows[n]
            n += 1
        steps[k], moved[k] = n, sent
    while True:  # steps are whole, so exchanges may not be even: take steps back where a shard would pass its quota
        over = list(room)
        for (a, b), n in moved.items():
            over[a] += n
            over[b] -= n
        full = next((s for s, free in enumerate(over) if free < 0), None)
        if full is None:
            return {k: n for k, n in steps.items() if moved[k]}
        k = max((k for k in moved if k[1] == full and moved[k]), key=lambda k: (moved[k], k))
        steps[k] -= 1
        moved[k] -= asked[k][steps[k]]


def _propagated(linked: DataFrame, quota: list[int], large: int, least: int) -> DataFrame:
    """Rows ``rid, mark, gid, n, shard`` after rounds of moves towards the neighbours' shard."""
    spark, shards, idle = linked.sparkSession, len(quota), 0
    for turn in range(ROUNDS):
        spread = staged(linked.groupBy("gid", "shard").agg(F.count("*").alias("here"), F.first("n").alias("n")), "shard-spread")
        used = dict.fromkeys(range(shards), 0) | {r.shard: r.rows for r in spread.groupBy("shard").agg(F.sum("here").alias("rows")).collect()}  # a row per shard
        room = [max(0, quota[s] - used[s]) for s in range(shards)]
        open_to = spread.where(_pick(room, F.col("shard")) > 0) if turn % 2 else spread
        target = open_to.groupBy("gid").agg(F.max(F.struct("here", F.xxhash64("gid", "shard", F.lit(turn)).alias("tie"), "shard")).alias("t")).select("gid", F.col("t.here").alias("there"), F.col("t.shard").alias("to"))
        wishes = staged(spread.join(target, "gid").where("shard != to AND here <= there").select("gid", "shard", "to", "n"), "shard-wishes")
        # Of large groups at most MANY times the number of shards.
        many, few = F.broadcast(wishes.where(F.col("n") >= least).drop("n")), wishes.where(F.col("n") < least).drop("n")
        big, rest = linked.where(F.col("n") >= least), linked.where(F.col("n") < least)
        step = F.pmod(F.xxhash64(F.lit(turn), F.when(F.col("n") > large, F.col("mark")).otherwise(F.col("gid"))), F.lit(STEPS)).cast("int")
        moves = big.join(many, ["gid", "shard"], "left").unionByName(rest.join(few, ["gid", "shard"], "left")).withColumn("step", step)
        moves = staged(moves, "shard-moves")
        asked: dict[tuple[int, int], list[int]] = {}
        for r in moves.where("to IS NOT NULL").groupBy("shard", "to", "step").agg(F.count("*").alias("rows")).collect():  # at most STEPS rows for a pair of shards
            asked.setdefault((r.shard, r.to), [0] * STEPS)[r.step] = r.rows
        grants = granted(asked, room)
        discard(spread, wishes)
        if not grants:
            discard(moves)
            idle += 1
            if idle == 4 or not asked and turn % 2 == 0:
                break
            continue
        idle = 0
        steps = F.broadcast(spark.createDataFrame([(a, b, n) for (a, b), n in grants.items()], "shard int, to int, upto int"))  # a row per pair of shards
        goes = F.coalesce(F.col("step") < F.col("upto"), F.lit(False))
        moved = moves.join(steps, ["shard", "to"], "left").select("rid", "mark", "gid", "n", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        moved = staged(moved, "shard-labels")
        discard(linked, moves)
        linked = moved
    return linked
