"""Sharding [native]: label propagation between documents of equal text, under a quota for each shard; groups that are left apart are
laid over the free places, and an exact levelling moves unlinked documents first.

Law `rows`: the counts of any two shards are at most one apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesieve.llm.common import discard, keep, pick, read, with_start

#: Hash bins of groups, of which a shard lets in the first ones that it has room for: bins, not movers, are sorted.
BINS = 64
#: A bound on the rounds; what they leave apart is mended afterwards.
ROUNDS = 12
#: A group with more than 1 / HOT of all rows is hot; so there are at most HOT hot groups, and their list is safe to broadcast.
HOT = 1000
#: Rows that one cell of the final order aims at.
CELL = 256


def _number(values: dict[int, int], key: Column) -> Column:
    """The value at a shard's number; one literal for each shard."""
    return F.element_at(F.array(*(F.lit(int(values[i])).cast("long") for i in range(len(values)))), key + 1)


def _loads(rows: DataFrame, shards: int) -> dict[int, int]:
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shard
    return {s: found.get(s, 0) for s in range(shards)}


def let_in(wished: dict[tuple[int, int, int], int], load: dict[int, int], quota: dict[int, int], until: dict[int, int]) -> dict[int, int]:
    """For each shard the bin below which it takes all that wish to come, at most what `until` says. wished: documents by (from, to,
    bin). No shard ends above its quota, or above its load where that is higher; those who leave make room, so shards can swap."""
    until = dict(until)
    while True:
        after = dict(load)
        come: dict[int, dict[int, int]] = {s: {} for s in load}
        for (s, t, b), n in wished.items():
            if b < until[t]:
                after[s] -= n
                after[t] += n
                come[t][b] = come[t].get(b, 0) + n
        over = {t: n - max(quota[t], load[t]) for t, n in after.items() if n > max(quota[t], load[t])}
        if not over:
            return until
        # The last bins stay out; that keeps leavers back in others, so it goes on until nothing is over.
        for t, n in over.items():
            for b in sorted(come[t], reverse=True):
                if n <= 0:
                    break
                n -= come[t][b]
                until[t] = b


def propagate(linked: DataFrame, hot: DataFrame, quota: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """linked (_id, _group, shard, ...) after rounds in each of which documents move to the shard that holds most of their
    neighbours, until no more move. A shard takes no more than its quota and its leavers give room for, and no row is lost. A
    shard lets groups in whole, by bins of their hash; the bins that it once had no room for turn to their next best shard.

    hot: the few groups too large for one task, by _group; their joins broadcast one row a group.
    """
    shards = len(quota)
    until = dict.fromkeys(quota, BINS)
    bin_of = F.pmod(F.xxhash64(F.lit(8), "_group"), F.lit(BINS))
    for _ in range(rounds):
        load = _loads(linked, shards)
        cells = keep(linked.groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("_n")), "cells")
        # The best shard for a group: the most neighbours there, the hash breaking ties, among those that still let its bin in.
        rank = F.struct("_n", F.xxhash64("_group", "shard").alias("_tie"), "shard")
        best = cells.where(bin_of < _number(until, F.col("shard"))).groupBy("_group").agg(F.max(rank).alias("_best"))
        move = cells.join(best, "_group").where(F.col("_best.shard") != F.col("shard")).select("_group", "shard", F.col("_best.shard").alias("_to"), "_n", bin_of.alias("_bin"))
        move = keep(move, "moves")
        # At most shards x shards x BINS rows, whatever the input. Hot groups, which fill shards of their own, move by bins of ids.
        cool = move.join(F.broadcast(hot), "_group", "left_anti")
        warm = linked.join(F.broadcast(hot), "_group", "left_semi").join(F.broadcast(move.join(F.broadcast(hot), "_group", "left_semi").drop("_n", "_bin")), ["_group", "shard"])
        of_id = F.pmod(F.xxhash64(F.lit(8), "_group", "_id"), F.lit(BINS))
        wishes = cool.groupBy("shard", "_to", "_bin").agg(F.sum("_n").alias("n")).unionByName(warm.groupBy("shard", "_to", of_id.alias("_bin")).agg(F.count(F.lit(1)).alias("n")))
        wished: dict[tuple[int, int, int], int] = {}
        for r in wishes.collect():
            wished[r["shard"], r["_to"], r["_bin"]] = wished.get((r["shard"], r["_to"], r["_bin"]), 0) + r["n"]
        last, until = until, let_in(wished, load, quota, until)
        if any(b < until[t] for _, t, b in wished):
            few = move.join(F.broadcast(hot), "_group", "left_semi").drop("_n", "_bin")  # at most HOT groups x shards rows
            many = cool.where(F.col("_bin") < _number(until, F.col("_to"))).drop("_n", "_bin")
            is_hot = linked.join(F.broadcast(hot), "_group", "left_semi").join(F.broadcast(few), ["_group", "shard"], "left")
            is_hot = is_hot.withColumn("_to", F.when(of_id < _number(until, F.col("_to")), F.col("_to")))
            is_not = linked.join(F.broadcast(hot), "_group", "left_anti").join(many, ["_group", "shard"], "left")
            moved = is_hot.unionByName(is_not).withColumn("shard", F.coalesce("_to", "shard"))
            before, linked = linked, keep(moved.select("_id", "_size", "_crc", "_group", "shard"), "linked")
            discard(before)
        elif until == last:
            break
        discard(cells, move)
    return linked


def mend(linked: DataFrame, hot: DataFrame, quota: dict[int, int]) -> DataFrame:
    """Groups that are still in several shards are laid out one after the other over the places that the others leave free, so
    only those on the border of two shards stay cut: fewer than there are shards, and those larger than a shard."""
    shards = range(len(quota))
    split = keep(linked.groupBy("_group").agg(F.min("shard").alias("_a"), F.max("shard").alias("_b")).where("_a <> _b").select("_group", F.lit(True).alias("_split")), "split")
    is_hot = linked.join(F.broadcast(hot), "_group", "left_semi").join(F.broadcast(split.join(F.broadcast(hot), "_group", "left_semi")), "_group", "left")
    is_not = linked.join(F.broadcast(hot), "_group", "left_anti").join(split, "_group", "left")
    told = keep(is_hot.unionByName(is_not), "told")
    load = _loads(told.where("_split IS NULL"), len(quota))
    upto, ends = 0, []
    for s in shards:
        upto += max(0, quota[s] - load[s])
        ends.append(upto)
    laid = with_start(told.where("_split").withColumn("_one", F.lit(1)), ["_group", "_id", "_size"], "_one", "_at")
    to = reduce(lambda otherwise, s: F.when(F.col("_at") < ends[s], F.lit(s)).otherwise(otherwise), reversed(shards), F.lit(shards[-1]))
    names = ["_id", "_size", "_crc", "_group", "shard"]
    out = keep(told.where("_split IS NULL").select(names).unionByName(laid.withColumn("shard", to).select(names)), "mended")
    discard(split, told)
    return out


def _placed(rows: DataFrame, hot: DataFrame, cells: int) -> DataFrame:
    """Adds _slot, gapless from 0 in each shard, with copies of a text together and unlinked rows last. Rows meet in cells of
    bounded size; a hot group is dealt over many of them."""
    dealt = rows.join(F.broadcast(hot), "_group", "left")
    # Sections: 0 hot groups, by group then salt; 1 other groups; 2 rows without links.
    section = F.when(F.col("_salts").isNotNull(), 0).when(F.col("_linked"), 1).otherwise(2)
    cell = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(F.lit(3), "_id", "_size"), F.col("_salts"))).otherwise(F.pmod(F.xxhash64(F.lit(4), "_group"), F.lit(cells)))
    part = F.when(F.col("_salts").isNotNull(), F.col("_group")).otherwise(F.lit(0))
    dealt = keep(dealt.withColumns({"_section": section, "_part": part, "_cell": cell}).drop("_salts"), "dealt")
    where = ["shard", "_section", "_part", "_cell"]
    counts = dealt.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))
    # The cells of one shard, not its rows, are put in order.
    base = keep(counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_section", "_part", "_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n"), "bases")
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*where).orderBy("_group", "_id", "_size", "_crc")))
    return inside.join(base, where).withColumn("_slot", F.col("_base") + F.col("_in") - 1)


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32, law, shard,
    slot (gapless from 0) and grown_shard (null: the law is rows).

    Equal texts are linked; null is a text of its own kind, linked to the empty one. Documents without id are placed like any
    other. Shard counts are at most one apart, so a group larger than a shard is cut, and as few others as the counts allow.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("_id"), (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text).alias("_crc"), F.xxhash64(text).alias("_group"))
    rows = keep(rows, "rows")
    total = rows.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    groups = keep(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "groups")
    hot = groups.where(F.col("_n") > max(CELL, total // HOT)).select("_group", F.ceil(F.col("_n") / CELL).alias("_salts"))
    cool = groups.join(F.broadcast(hot), "_group", "left_anti").select("_group", F.lit(True).alias("_many"))
    # At the start every document has a shard by its own hash.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(shards)).cast("int"))
    of_hot = rows.join(F.broadcast(hot.select("_group")), "_group", "left_semi").withColumn("_linked", F.lit(True))
    others = rows.join(F.broadcast(hot.select("_group")), "_group", "left_anti").join(cool, "_group", "left").withColumn("_linked", F.col("_many").isNotNull()).drop("_many")
    names = ["_id", "_size", "_crc", "_group", "shard", "_linked"]
    rows = keep(of_hot.select(names).unionByName(others.select(names)), "linked-or-not")
    linked = keep(rows.where("_linked").drop("_linked"), "linked")
    linked = mend(propagate(linked, hot.select("_group"), quota, rounds), hot.select("_group"), quota)
    placed = linked.withColumn("_linked", F.lit(True)).unionByName(rows.where("NOT _linked"))
    placed = keep(_placed(placed, hot, max(1, total // (shards * CELL))), "placed")

    # Levelling: what lies beyond a shard's quota goes, in order, to the places that are free in others.
    load = _loads(placed, shards)
    over, free = {s: max(0, load[s] - quota[s]) for s in quota}, {s: max(0, quota[s] - load[s]) for s in quota}
    before_over, before_free = ({s: sum(x[t] for t in range(s)) for s in x} for x in (over, free))
    beyond = F.col("_slot") - _number(quota, F.col("shard"))
    rank = _number(before_over, F.col("shard")) + beyond
    to = reduce(lambda otherwise, s: F.when((rank >= before_free[s]) & (rank < before_free[s] + free[s]), F.lit(s)).otherwise(otherwise), range(shards), F.lit(None).cast("int"))
    level = placed.withColumns({"_to": F.when(beyond >= 0, to), "_rank": rank})
    shard = F.coalesce("_to", "shard")
    slot = F.when(F.col("_to").isNull(), F.col("_slot")).otherwise(F.col("_rank") - _number(before_free, F.col("_to")) + _number(load, F.col("_to")))
    return level.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
