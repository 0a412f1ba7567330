"""Sharding by balanced label propagation under the law `rows`: shard sizes differ by one row at most.

Links join documents through hubs: the documents of a hub are neighbours of each other, so that a group of n
documents takes n rows and not n * n edges. A hub larger than a shard is first cut into parts that fit one.

Every document starts in a shard given by a hash. In each round the documents of every hub vote with their
shards; a linked document asks to move to the shard where most of its neighbours are, weighed over its hubs.
Requests are counted by (from, to), a table of shards * shards rows at most, from which quotas follow: no
shard may take more linked documents than it has rows. A request is granted if the hash of its hub is below
the quota's share, so that the members of a hub move together and reruns agree.

In the end a shard keeps its linked documents first and then unlinked ones until it is full; the rest, of
which moving an unlinked document cuts nothing, fills the room that is left. Positions are counted in two
levels, per bucket and within it, so that no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables


def below(key: Column, n) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def positions(df: DataFrame, group: list[str], bucket: str, order: list) -> DataFrame:
    """Adds `at`: 0, 1, 2 ... within each group, by bucket and then by order. Only a bucket's rows meet in a
    task; the offsets of the buckets come from their counts."""
    rows = df.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1
    return df.withColumn("_row", within).join(starts, [*group, bucket]).withColumn("at", F.col("_start") + F.col("_row")).drop("_start", "_row")


def quotas(asked: np.ndarray, load: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The share of the requests from i to j that is granted, so that no load ends above the room. Requests
    into an overfull shard are cut in proportion, until all fit; cutting them keeps other rows where they
    are, so it is repeated."""
    granted = asked.astype(float)
    for _ in range(100):
        after = load + granted.sum(0) - granted.sum(1)
        into = granted.sum(0)
        over = (after > room + 1e-9) & (into > 0)
        if not over.any():
            break
        granted[:, over] *= np.maximum(0, 1 - (after - room)[over] / into[over])
    return np.divide(granted, asked, out=np.zeros_like(granted), where=asked > 0)


def propagate(tables: Tables, members: DataFrame, shards: int, room: float, rounds: int) -> DataFrame:
    """(node, shard) for the linked nodes. members: (node, hub, salt, salts), salts being the number of parts in which a
    large hub is joined."""
    tables = Tables(tables.spark)  # of the rounds
    labels = tables.keep(members.select("node").distinct().withColumn("shard", below(F.col("node"), shards)))
    for k in range(rounds):
        seen = tables.keep(members.join(labels, "node"))
        votes = seen.groupBy("hub", "salts", "shard").agg(F.count("*").alias("votes"))
        best = votes.groupBy("hub", "salts").agg(F.max(F.struct("votes", (-F.col("shard")).alias("low"))).alias("top"))
        best = best.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("top.votes").alias("votes"), (-F.col("top.low")).alias("wish"))
        wishes = seen.join(best, ["hub", "salt"]).groupBy("node", "shard", "wish").agg(F.sum("votes").alias("votes"), F.min("hub").alias("hub"))
        wishes = wishes.groupBy("node", "shard").agg(F.max(F.struct("votes", (-F.col("wish")).alias("low"), "hub")).alias("top")).select("node", "shard", (-F.col("top.low")).alias("wish"), F.col("top.hub").alias("hub"))
        wishes = tables.keep(wishes)
        counted = wishes.groupBy("shard", "wish").count().collect()  # shards * shards rows at most
        asked, load = np.zeros((shards, shards), int), np.zeros(shards)
        for r in counted:
            load[r["shard"]] += r["count"]
            if r["shard"] != r["wish"]:
                asked[r["shard"], r["wish"]] += r["count"]
        share = quotas(asked, load, np.full(shards, room))
        granted = F.lit(share.ravel())[(F.col("shard") * shards + F.col("wish")).cast("int")]
        move = below(F.concat_ws(":", F.lit(k), "hub"), 1_000_000) < granted * 1_000_000
        labels = tables.keep(wishes.select("node", F.when(move, F.col("wish")).otherwise(F.col("shard")).alias("shard")))
        tables.only(labels)
        if not asked.any():
            break
    return labels


def shard(docs: DataFrame, key: Column, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, hot: int = 5000) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    key: the group of a row; rows with equal keys are linked, null keys link nothing. size: UTF-8 bytes of
    the text (null: none) plus 16. shard: 0 to shards - 1, with counts one apart at most. slot: 0, 1, ... within the
    shard. grown_shard: null under this law. text_crc32: of the UTF-8 bytes, of none for null.

    Null ids and texts, empty texts and repeated rows are rows like any other; repeated rows are linked and
    get slots of their own. An empty table gives no rows. Other columns are not read.
    """
    tables = Tables(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("hub"))
    rows = tables.keep(rows)
    total = rows.count()
    sizes = rows.filter("hub is not null").groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1")
    # Rows of one id and hub are one node: repeated rows move together.
    fit = max(1, total // shards)
    parts = F.ceil(F.col("n") / F.lit(0.95 * fit)).cast("int")
    linked = rows.join(sizes, "hub").select("id", "hub", "n", parts.alias("parts"))
    part = F.concat_ws("#", "hub", F.pmod(F.xxhash64("id"), F.col("parts")))
    linked = linked.withColumn("node", F.xxhash64("id", "hub")).withColumn("hub", part)
    members = linked.withColumn("salts", F.ceil(F.col("n") / F.col("parts") / hot).cast("int")).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).cast("int"))
    members = tables.keep(members.select("node", "hub", "salt", "salts"))
    labels = propagate(tables, members, shards, 0.97 * total / shards, rounds)
    named = tables.keep(members.groupBy("node").agg(F.min("hub").alias("part"), F.min(F.ceil(F.col("salts") * hot / 50_000)).alias("spread")).join(labels, "node"))

    # Linked rows first, hub by hub, a large hub over several buckets; then the rows that nothing binds.
    buckets = max(1, total // shards // 50_000)
    rows = rows.withColumn("node", F.xxhash64("id", "hub")).join(named, "node", "left")
    bucket = F.pmod(F.when(F.col("part").isNull(), F.xxhash64("id", "text_crc32")).otherwise(below(F.col("part"), buckets) + F.pmod(F.xxhash64("id"), F.col("spread"))), F.lit(buckets))
    rows = rows.select("id", "size", "text_crc32", "part", F.coalesce(F.col("shard"), below(F.struct("id", "text_crc32"), shards)).cast("int").alias("shard"), (F.when(F.col("part").isNull(), buckets).otherwise(0) + bucket).alias("bucket"))
    rows = tables.keep(positions(rows, ["shard"], "bucket", ["part", "id", "text_crc32"]))
    capacity = F.lit(total // shards) + (F.col("shard") < total % shards).cast("bigint")
    loads = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    room = np.array([total // shards + (s < total % shards) - loads.get(s, 0) for s in range(shards)])
    stay = rows.filter(F.col("at") < capacity).select("id", "size", "text_crc32", "shard", F.col("at").alias("slot"))
    free = np.maximum(room, 0)
    ends = np.cumsum(free)
    over = positions(rows.filter(F.col("at") >= capacity).drop("at").withColumn("b", F.col("shard") * 2 * buckets + F.col("bucket")), [], "b", ["part", "id", "text_crc32"])
    target = F.aggregate(F.lit(ends.astype(np.int64)), F.lit(0), lambda n, e: n + (e <= F.col("at")).cast("int"))
    begin = F.lit((ends - free).astype(np.int64))[F.col("to")]
    held = F.lit(np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64) - free)[F.col("to")]
    moved = over.withColumn("to", target).select("id", "size", "text_crc32", F.col("to").alias("shard"), (held + F.col("at") - begin).alias("slot"))
    return stay.union(moved).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def by_text(docs: DataFrame, shards: int = 40, **how) -> DataFrame:
    """Sharding with equal texts as groups; a null text is like an empty one here."""
    return shard(docs, F.md5(F.coalesce(F.col(how.get("text_col", "text")), F.lit(""))), shards, **how)
