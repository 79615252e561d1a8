"""Shards of equal row counts that keep linked documents together, by balanced label propagation.

Documents with the same text are linked. Members of a group that stand in the same shard are alike, so the state is
(group, shard, members): at most one row for each shard of even the largest group. In every round each group names
the shard where most of its members stand, as long as it has room; members elsewhere move there, and where more want
in than the quota leaves room for, a hash decides which. Members that still do not fit, and documents without links,
fill the shards to exactly equal counts.

The law is ``rows``: counts of any two shards differ by one at most. Results for special rows: a null text has no
links, size 16 and a null crc; empty texts are linked like others; rows that repeat a doc_id are separate documents.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import documents_only, rank_within, store

SHARDS = 40
ROUNDS = 8
_HEADER = 16
_BUCKETS = 65_536


def propagate(groups: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(g, shard, n) for groups (g, n) after label propagation under ``capacity`` members for each shard.

    The quotas hold on average; what is over after the last round is for the caller to move.
    """
    spark = groups.sparkSession
    spread = groups.select("g", "n", F.explode(F.expr(f"sequence(0L, least(n, {shards}L) - 1)")).alias("i"))
    share = F.floor(F.col("n") / shards) + (F.col("i") < F.col("n") % shards).cast("long")
    state = store(spread.select("g", F.pmod(F.pmod(F.xxhash64("g"), F.lit(shards)) + F.col("i"), F.lit(shards)).cast("int").alias("shard"), share.alias("n")).where("n > 0"), "labels")
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = spark.createDataFrame([(s, max(0, capacity - load.get(s, 0))) for s in range(shards)], "shard int, room long")
        voted = state.join(F.broadcast(room), "shard")
        # the fullest of its shards that has room; ties go by a hash, so that no shard is everyone's choice
        rank = F.struct((F.col("room") > 0).cast("int"), F.col("n"), F.xxhash64("g", "shard"))
        votes = voted.groupBy("g").agg(F.max_by("shard", rank).alias("to"), F.max_by("n", rank).alias("most"))
        asked = state.join(votes, "g").withColumn("asks", (F.col("shard") != F.col("to")) & (F.col("n") <= F.col("most")))
        asks = {(r["shard"], r["to"]): r["n"] for r in asked.where("asks").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        if not asks:
            break
        odds = spark.createDataFrame(list(_odds(asks, load, shards, capacity).items()), "to int, odds double")
        draw = F.pmod(F.xxhash64("g", "shard", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        moved = asked.join(F.broadcast(odds), "to").withColumn("shard", F.when(F.col("asks") & (draw < F.col("odds")), F.col("to")).otherwise(F.col("shard")))
        state = store(moved.groupBy("g", "shard").agg(F.sum("n").alias("n")), "labels")
    return state


def _odds(asks: dict[tuple[int, int], int], load: dict[int, int], shards: int, capacity: int) -> dict[int, float]:
    """For each shard, the share of those who want in that its room lets in, counting the room that others leave."""
    odds = dict.fromkeys(range(shards), 1.0)
    wanted = {s: sum(n for (_, to), n in asks.items() if to == s) for s in odds}
    for _ in range(30):
        out = {s: sum(n * odds[to] for (at, to), n in asks.items() if at == s) for s in odds}
        odds = {s: min(1.0, max(0.0, capacity - load.get(s, 0) + out[s]) / wanted[s]) if wanted[s] else 0.0 for s in odds}
    return odds


def _fitted(state: DataFrame, target: dict[int, int]) -> DataFrame:
    """(g, shard, first, last): which members (by rank in their group) each shard takes, within its target."""
    spark = state.sparkSession
    placed = state.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(_BUCKETS)).cast("int"))
    sums = placed.groupBy("shard", "b").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    limit = spark.createDataFrame(list(target.items()), "shard int, most long")
    room = F.col("most") - F.col("base") - F.coalesce(F.sum("n").over(inside), F.lit(0))
    kept = (
        placed.join(sums, ["shard", "b"]).join(F.broadcast(limit), "shard")
        .withColumn("kept", F.least("n", F.greatest(room, F.lit(0)))).where("kept > 0")
    )
    order = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("kept").over(order)
    return kept.select("g", "shard", (last - F.col("kept")).alias("first"), last.alias("last"))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 within the shard), grown_shard (null)."""
    plain = documents_only(docs)
    base = plain.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + _HEADER).alias("size"),
        F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), F.col("text").isNotNull().alias("linked"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("g"),
    )
    ranked = rank_within(base, ["g", "linked"], "vertices")
    ranked = ranked.withColumnRenamed("rank", "member")
    groups = store(ranked.where("linked").groupBy("g").agg((F.max("member") + 1).alias("n")).where("n > 1"), "groups")
    rows = ranked.count()
    target = {s: rows // shards + (s < rows % shards) for s in range(shards)}
    pieces = store(_fitted(propagate(groups, shards, max(1, rows // shards), rounds), target), "pieces")
    p = pieces.withColumnRenamed("g", "pg")
    together = ranked.join(p, (ranked.g == p.pg) & ranked.linked & (ranked.member >= p["first"]) & (ranked.member < p["last"]), "left")
    together = store(together.select("doc_id", "size", "text_crc32", "shard"), "placed")
    taken = {r["shard"]: r["n"] for r in together.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, total = [], 0
    for s in range(shards):
        total += target[s] - taken.get(s, 0)
        ends.append(total)
    free = rank_within(together.where("shard is null").withColumn("all", F.lit(0)), ["all"], "free")
    free = free.withColumn("shard", F.expr(f"size(filter(array({', '.join(f'{e}L' for e in ends)}), e -> e <= rank))")).drop("all", "rank")
    whole = together.where("shard is not null").unionByName(free)
    return rank_within(whole, ["shard"], "slots").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
