"""Near duplicates by SimHash and multi-index hashing.

Every document gets a fingerprint: bit k is 1 if it is set in over half of the hashes of its word shingles.
Fingerprints within a given Hamming distance are linked; linked documents form groups.

Links are found by multi-index hashing. A fingerprint is cut into segments of 32 bits. If two fingerprints
of two segments differ in at most 5 bits, they differ in at most 2 bits of one segment, so that some value
lies within 1 bit of that segment in both. Each fingerprint therefore enters a table under every value of
the Hamming ball of radius 1 around each segment (33 a segment), fetches its fellows there, and verifies the
complete distance. Balls of radius 1 on both sides replace a ball of radius 2 (529 values) on one.

A bucket with many different fingerprints (a large family of near copies) is not compared in pairs. Its
fingerprints enter a second table under every value of the ball of radius 2 around the whole fingerprint.
Two such balls share a value exactly if the fingerprints differ in at most 4 bits, so linking each to the
smallest fingerprint under the same value gives the same groups, with a number of rows linear in the
fingerprints.

With several lanes no such ball reaches far enough. There the pairs of a crowded bucket are compared in blocks, a
row for two blocks, unless they are in one group already.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, components, tucked, untucked

#: The largest bucket whose fingerprints are compared in pairs of rows; beyond it the linear way is taken, or blocks.
PAIRED = 64
#: Fingerprints of a block, on average.
BLOCK = 256
#: Fingerprints in a sample that hot keys are looked for in, how often one occurs there, and the parts in which its rows are counted. At most
#: SAMPLED times the keys of a fingerprint (66 or 272) over HOT keys are hot, whatever the size of the corpus.
SAMPLED, HOT, PARTS = 20_000, 64, 64
#: Where there are several lanes, so many bits of a segment flip alone, in twos and in threes: those that were the closest calls. At a
#: similarity of 0.8 these 17 values meet in some of 16 segments for 97 % of pairs, 17 values of 16 bits that flip alone for 85 % (simulated).
ALONE, TWOS, THREES = 10, 4, 0
SEED = 42


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the shingles of a text, A-Z in lower case, repeats included. bytes.lower and bytes.split
    know ASCII only: they lower A-Z and split at blank and TAB to CR."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 1024):
        bits = np.unpackbits(hashes[at : at + 255 * 1024].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return counts


def packed(bits: np.ndarray) -> int:
    """64 bits as a signed number."""
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def close_calls(margin: np.ndarray) -> list[int]:
    """The ALONE bits of each segment whose counts are nearest to one half, nearest first, as digits of 5 bits in one number."""
    order = np.argsort(margin.reshape(-1, 32), axis=1, kind="stable")[:, :ALONE]
    return (order << 5 * np.arange(ALONE)).sum(1).tolist()


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes of lane k: lane 0 has them as they are, others after a 64-bit mixing step of their own."""
    if k == 0:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint_udf(shingle: int, lanes: int):
    """array<bigint> of `lanes` fingerprints of 64 bits and, if there are several, the close calls of each segment.
    Arrow batches; a text is never cut."""

    @F.pandas_udf("array<bigint>")
    def fingerprint(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            hashes = shingle_hashes(text, shingle)
            margin = np.stack([bit_counts(lane(hashes, k)) for k in range(lanes)]) * 2 - len(hashes)
            row = [packed(m > 0) for m in margin]
            out.append(row if lanes == 1 else row + close_calls(np.abs(margin)))
        return pd.Series(out, dtype=object)

    return fingerprint


def distance(a: Column, b: Column, lanes: int) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, lanes)), F.bit_count(a[0].bitwiseXOR(b[0])))


def segment_keys(fps: DataFrame, lanes: int) -> DataFrame:
    """(node, key, flip): key holds the segment's number and, in 32 bits, a value near the segment; flip has the bits
    in which they differ. With one lane these are the ball of radius 1. With several it is a ball of radius 3 of which only
    the likeliest values are taken: two texts that differ little differ in the bits that were close calls in one or the other."""
    halves = lambda k: (F.col("fp")[k].bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col("fp")[k], 32))
    parts = [F.struct(part.alias("part"), (F.col("fp")[lanes + 2 * k + half] if lanes > 1 else F.lit(0)).alias("weak")) for k in range(lanes) for half, part in enumerate(halves(k))]
    rows = fps.select("node", F.posexplode(F.array(*parts)).alias("segment", "s"))
    if lanes == 1:
        ball = F.lit(np.array([0] + [1 << i for i in range(32)], np.int64))
    else:
        bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright("s.weak", 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(ALONE)]
        chosen = [c for n, most in enumerate((ALONE, ALONE, TWOS, THREES)) for c in combinations(range(most), n)]
        ball = F.array(*[reduce(Column.bitwiseXOR, (bits[i] for i in c), F.lit(0).cast("bigint")) for c in chosen])
    rows = rows.select("node", "segment", "s.part", F.explode(ball).alias("flip"))
    return rows.select("node", (F.shiftleft(F.col("segment").cast("long"), 32) + F.col("part").bitwiseXOR(F.col("flip"))).alias("key"), "flip")


def met_rows(tables: Tables, fps: DataFrame, lanes: int) -> DataFrame:
    """(key, node, flip, met, hub): the segment keys that several nodes have, how many have them and the smallest of these.

    The rows of a key are counted in one task, but for hot keys, which many fingerprints of a bounded sample have: theirs are counted
    in PARTS parts first, and the parts are summed."""
    share = min(1.0, SAMPLED / max(1, fps.count()))
    sample = fps.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < (1 << 20) * share)
    hot = tables.keep(segment_keys(sample, lanes).groupBy("key").count().filter(F.col("count") >= HOT).select(F.col("key").alias("hot")))
    # The part stands above the key's 36 bits; 0 for all others.
    part = F.when(F.col("hot").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64("node", F.lit(8)), F.lit(PARTS)) + 1)
    rows = segment_keys(fps, lanes).join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    rows = rows.select("node", (F.col("key") + F.shiftleft(part, 40)).alias("key"), "flip")
    bucket, is_hot = Window.partitionBy("key"), F.col("key") >= 1 << 40
    counted = rows.withColumns({"met": F.count("*").over(bucket), "hub": F.min("node").over(bucket)}).filter((F.col("met") > 1) | is_hot)
    counted = tables.keep(counted.select("key", "node", "flip", "met", "hub"))
    parted = counted.filter(is_hot).withColumn("key", F.col("key").bitwiseAND(F.lit((1 << 40) - 1)))
    whole = parted.groupBy("key").agg(F.count("*").alias("met"), F.min("hub").alias("hub")).filter("met > 1")
    summed = parted.drop("met", "hub").join(F.broadcast(whole), "key")
    return counted.filter(~is_hot).unionByName(summed)


def links(tables: Tables, fps: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Edges (a, b) between nodes of fps (node long, fp array<bigint>) that give the groups of all pairs within
    radius. For one lane, where the node is the fingerprint, this is exact at radius 4. With more lanes two
    fingerprints are compared if some segment differs in a few bits only, close calls of one and the other, however
    large the bucket is."""
    if lanes == 1 and radius != 4:
        raise ValueError("with one lane the radius is 4: balls of radius 2 meet up to a distance of 4")
    met = met_rows(tables, fps, lanes)
    a, b = (met.filter(F.col("met") <= PAIRED).select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "flip")]) for side in "ab")
    crowded = met.filter(F.col("met") > PAIRED)
    pairs = a.join(b, "key").filter(F.col("node_a") < F.col("node_b"))
    ends = (F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    if lanes == 1:
        # Two fingerprints meet under several keys; the pair is taken under the smallest value between them alone.
        value = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
        low = F.col("flip_a").bitwiseXOR(F.col("flip_b"))
        low = low.bitwiseAND(-low)
        between = [value.bitwiseXOR(F.col(f"flip_{side}")).bitwiseXOR(low) for side in "ab"]
        pairs = pairs.filter((value == F.least(*between)) & (F.bit_count(F.col("node_a").bitwiseXOR(F.col("node_b"))) <= radius)).select(*ends)
        wide = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
        balls = crowded.select("node").distinct().withColumn("flip", F.explode(F.lit(np.array([signed(x) for x in wide], np.int64))))
        near = balls.select("node", F.col("node").bitwiseXOR(F.col("flip")).alias("value"))
        # The planner takes these rows for as few as the nodes and would broadcast them.
        near = near.hint("merge").join(near.groupBy("value").agg(F.min("node").alias("hub")).hint("merge"), "value")
        return pairs.union(near.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))).distinct()
    return starred(tables, fps, met, lanes, radius)


def starred(tables: Tables, fps: DataFrame, met: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Edges within the radius for several lanes, in two steps. First each fingerprint is compared with the
    smallest of every bucket; that alone joins most of a family of near copies. Then the pairs of a bucket that
    are not in one group yet are compared: fewer by the square of what the first step has joined, and none of
    the others could join more."""
    at = lambda side: fps.select(F.col("node").alias(side), F.col("fp").alias(f"fp_{side}"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(at("a"), "a").join(at("b"), "b")
        return both.filter(distance(F.col("fp_a"), F.col("fp_b"), lanes) <= radius).select("a", "b")

    stars = tables.keep(verified(met.select(F.col("hub").alias("a"), F.col("node").alias("b")).filter("a <> b")))
    more = met.filter("met > 2").join(components(tables, stars), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = more.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", "node").alias("own")).filter("low <> high")
    more = tables.keep(more.join(mixed.select("key", "own"), "key").select("key", "node", "flip", "met", "comp", "own"))
    a, b = (more.filter(F.col("met") <= PAIRED).select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "flip", "comp")]) for side in "ab")
    # Equal segments meet under every flip; the pair is taken without one, where all pairs are compared too.
    once = (F.col("flip_a") != F.col("flip_b")) | (F.col("flip_a") == 0)
    pairs = a.join(b, "key").filter((F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & once).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return stars.union(verified(pairs)).union(crossed(more.filter(F.col("met") > PAIRED), fps, lanes, radius))


def crossed(crowded: DataFrame, fps: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Edges (a, b) within the radius between groups that meet in crowded buckets (key, node, met, comp, own): for two blocks
    of a bucket, one of each two groups, which join no more by the others. All pairs are compared but those within `own`, the group of
    the bucket's smallest node, which is mostly by far the largest: one side leaves it out."""
    count = F.ceil(F.col("met") / BLOCK).cast("int")
    rows = crowded.withColumns({"count": count, "block": F.pmod(F.xxhash64("node", "key"), count).cast("int")})
    rows = rows.join(fps.select("node", F.slice("fp", 1, lanes).alias("fp")), "node")

    def blocks(some: DataFrame, side: str) -> DataFrame:
        found = some.groupBy("key", "block", "count").agg(F.collect_list(F.struct("node", "comp", "fp")).alias("m"))
        return found.select("key", "block", "count", *[x.alias(f"{c}_{side}") for c, x in (("node", F.col("m.node")), ("comp", F.col("m.comp")), ("fp", F.flatten("m.fp")))])

    # Each block of the outer ones goes to every block of its bucket, dealt by bucket and block.
    outer = blocks(rows.filter("comp <> own"), "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).drop("count")
    both = outer.hint("merge").join(blocks(rows, "b").drop("count").hint("merge"), ["key", "block"])
    columns = [f"{c}_{side}" for side in "ab" for c in ("node", "comp", "fp")]
    # An inner explode would have the optimizer ask beforehand whether a list is empty, and compare twice for it.
    found = both.select(F.explode_outer(near_pairs(lanes, radius)(*columns)).alias("e")).filter("e is not null")
    return found.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()


def near_pairs(lanes: int, radius: int):
    """A column function from two blocks (nodes, groups, fingerprints end to end) to a pair within the radius for each
    two groups that have one."""

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def pairs(node_a: pd.Series, comp_a: pd.Series, fp_a: pd.Series, node_b: pd.Series, comp_b: pd.Series, fp_b: pd.Series) -> pd.Series:
        out = []
        for na, ca, fa, nb, cb, fb in zip(node_a, comp_a, fp_a, node_b, comp_b, fp_b, strict=True):
            fa, fb = (np.asarray(x, np.int64).view(np.uint64).reshape(-1, lanes) for x in (fa, fb))
            apart = sum(np.bitwise_count(fa[:, None, k] ^ fb[None, :, k]).astype(np.int16) for k in range(lanes))
            i, j = np.nonzero((apart <= radius) & (np.asarray(ca)[:, None] != np.asarray(cb)[None, :]))
            found = {(ca[x], cb[y]): (na[x], nb[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
            out.append([{"a": int(x), "b": int(y)} for x, y in found.values()])
        return pd.Series(out, dtype=object)

    return pairs


def radius_for(similarity: float, lanes: int) -> int:
    """The distance within which 14 of 15 pairs lie whose sets of shingles have this Jaccard similarity, and more of those
    more similar. The share of bits that differ is expected to be the angle between their vectors over pi; to
    that come one and a half standard deviations."""
    bits, share = 64 * lanes, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + 1.5 * math.sqrt(bits * share * (1 - share)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, lanes: int = 1, radius: int = 4) -> DataFrame:
    """One row for each document: its id, fp (array of `lanes` 64-bit numbers) and component_id, the smallest
    id of its group.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. A text
    with fewer words than a shingle is one shingle. Repeated rows and ties are rows of their own in one group.
    Null ids take part; a group of nulls only has a null component_id. Other columns are not read. An empty
    table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    made = tables.keep(docs.select(F.col(id_col).alias("id"), fingerprint_udf(shingle, lanes)(F.col(text_col)).alias("fp")))
    return grouped(tables, made, lanes, radius).select(F.col("id").alias(id_col), "fp", "component_id")


def grouped(tables: Tables, made: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Adds component_id, and comp, the key of the group, to rows (id, fp); other columns stay."""
    node = F.col("fp")[0] if lanes == 1 else F.xxhash64(F.slice("fp", 1, lanes))
    made = made.withColumn("node", node)
    fps = tables.keep(made.groupBy("node").agg(F.min("fp").alias("fp"), F.min("id").alias("least")))
    between = Tables(tables.spark)
    comps = components(tables, links(between, fps, lanes, radius))
    between.only()
    member = fps.join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    groups = member.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = member.join(groups, "comp").select("node", "comp", "component_id")
    return made.join(named, "node").drop("node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, lanes: int = 8, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the group's smallest id (of rows with equal ids
    the one of smallest text hash, of equal rows one), whatever its ids are: null ids come last, and neither they nor repeated
    ids with different texts join groups. Rows are told apart by id and text hash. Null texts, empty ones and texts
    without words are one group. Other columns pass through under any name; an empty table gives no rows."""
    used, tables = {"id": id_col, "text": text_col}, Tables(docs.sparkSession)
    own = tucked(docs, **used).withColumn("th", F.xxhash64("text"))
    made = tables.keep(own.select("id", "th", fingerprint_udf(shingle, lanes)(F.col("text")).alias("fp")))
    found = grouped(tables, made, lanes, radius_for(similarity, lanes))
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best"))
    best = best.select("comp", F.col("best.id").alias("best_id"), F.col("best.th").alias("best_th"))
    left = own.join(best.hint("merge"), F.col("id").eqNullSafe(F.col("best_id")) & (F.col("th") == F.col("best_th")))
    first = F.row_number().over(Window.partitionBy("comp").orderBy("th"))
    return left.withColumn("rank", first).filter("rank = 1").select(*untucked(docs.columns, **used))
