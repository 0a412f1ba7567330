"""Approximate nearest neighbours by inner product over an inverted multi-index.

Both halves of the vectors are quantised on their own, by k-means fitted to a bounded sample; a vector belongs
to the cell of its two centroids. A query walks over the pairs of centroids in order of their summed distance
(the negative inner product with its halves), by a heap, until the cells hold enough vectors; these are
reranked by the exact inner product. How many are enough is measured: a bounded sample of queries is answered
exactly over all rows, and the walk goes as far as these needed to find nearly all of their neighbours.

Equal vectors are one entry with its smallest ids: no more than `k` + 1 of them can be among k results. Cells
and queries meet in blocks, so that a task holds a bounded number of either.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Vectors that k-means sees, queries that the length of the walk is measured on, members and queries in a block, and
#: centroids of a half: there are at most as many cells as the square of that, and the driver knows the size of each.
FITTED, MEASURED, MEMBERS, QUERIES, CENTROIDS = 16_384, 64, 8192, 2048, 512


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the distinct rows whose vector takes part: not null, not zero, all components finite, and of
    the most frequent length (the larger one of two as frequent)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()  # one row
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def cells_of(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first.shape[1]
    a, b = ((((c**2).sum(1) - 2 * y @ c.T)).argmin(1) for c, y in ((first, x[:, :h]), (second, x[:, h:])))
    return a * len(second) + b


def walk(q: np.ndarray, first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float):
    """Cells in order of summed distance until they hold `enough` vectors, with the number held before each."""
    h = first.shape[1]
    da, db = -(first @ q[:h]), -(second @ q[h:])
    ia, ib = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
    heap, held = [(da[ia[0]] + db[ib[0]], 0, 0)], 0
    while heap and held < enough:
        _, i, j = heappop(heap)
        cell = ia[i] * len(ib) + ib[j]
        if counts[cell]:
            yield cell, held
            held += counts[cell]
        if j + 1 < len(ib):
            heappush(heap, (da[ia[i]] + db[ib[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(ia):
            heappush(heap, (da[ia[i + 1]] + db[ib[0]], i + 1, 0))


def bundled(counts: np.ndarray, n_blocks: np.ndarray, most: int) -> np.ndarray:
    """The bundle of each cell (its first, if it has several blocks): neighbouring cells share one with `most` rows at most."""
    out, at, held = np.zeros(len(counts), np.int32), 0, 0
    for cell, (n, blocks) in enumerate(zip(counts, n_blocks, strict=True)):
        if held and (blocks > 1 or held + n > most):
            at, held = at + 1, 0
        out[cell], held = at, held + n
        if blocks > 1:
            at, held = at + int(blocks), 0
    return out


def best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the k best rows of x: places and scores, nearest first, ties to the smaller id. The
    scores of those kept are summed anew one by one, so that they don't hang on the shape of a block."""
    rough = q @ x.T
    places = np.argpartition(-rough, min(k + 8, len(ids)) - 1, 1)[:, : k + 8] if len(ids) > k + 8 else np.tile(np.arange(len(ids)), (len(q), 1))
    scores = np.stack([(x[p] * y).sum(1) for p, y in zip(places, q, strict=True)])
    order = np.stack([np.lexsort((ids[p], -s))[:k] for p, s in zip(places, scores, strict=True)])
    return np.take_along_axis(places, order, 1), np.take_along_axis(scores, order, 1)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.97, per_cell: int = 256) -> DataFrame:
    """(query_id, rank, id, score): for each row for which the column is_query (of `id`) holds, the k nearest
    of the other rows found, by inner product in double precision, ties to the smaller id; all, if fewer.

    Rows with a null id, and vectors that are null, empty, zero, of another length than most, or hold null or
    non-finite components take no part. Repeated rows count once; equal vectors under different ids count
    each. An empty table gives no rows; other columns are not read. recall: the share of the neighbours of the measured queries
    that the walk has to find; per_cell: vectors in a cell on average, as long as CENTROIDS allow.
    """
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)
    rows = tables.keep(usable(vectors, id_col, vector_col).distinct())
    entry = rows.withColumn("row", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("row") <= k + 1)
    entries = tables.keep(entry.groupBy("v").agg(F.min("id").alias("e"), F.sort_array(F.collect_list("id")).alias("ids")))
    total = entries.count()
    if not total:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    sample = lambda df, n, most, salt: df.filter(F.pmod(F.xxhash64("e", F.lit(salt)), F.lit(1 << 20)) < (1 << 20) * min(1.0, most / max(1, n)))
    fitted = matrix(sample(entries, total, FITTED, 1).select("v").toPandas()["v"]) if total > FITTED else matrix(entries.select("v").toPandas()["v"])
    h, size = fitted.shape[1] // 2, int(np.clip(np.sqrt(total / per_cell), 1, CENTROIDS))
    first, second = kmeans(fitted[:, :h], size), kmeans(fitted[:, h:], size)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(cells_of(matrix(v), first, second)) if len(v) else pd.Series([], dtype="int32")

    index = tables.keep(entries.withColumn("cell", cell_of("v")))

    def sizes(df: DataFrame) -> np.ndarray:
        """Rows of each cell; as many numbers as there are cells reach the driver."""
        known, out = df.groupBy("cell").count().toPandas(), np.zeros(len(first) * len(second), np.int64)
        out[known["cell"]] = known["count"]
        return out

    counts = sizes(index)
    asked = tables.keep(rows.filter(is_query(F.col("id"))).groupBy("v").agg(F.min("id").alias("e")))
    n_asked = asked.count()
    enough = measure(index, sample(asked, n_asked, MEASURED, 2), first, second, counts, k, recall)

    @F.pandas_udf("array<int>")
    def cells_for(v: pd.Series) -> pd.Series:
        return pd.Series([[c for c, _ in walk(q, first, second, counts, enough)] for q in matrix(v)] if len(v) else [], dtype=object)

    # Queries that start in neighbouring cells share a slot, since they walk over much the same cells; a cell goes to the slots that want it.
    asked = tables.keep(asked.withColumn("cells", cells_for("v")).withColumn("cell", F.col("cells")[0]))
    begins = sizes(asked)
    parts = [np.maximum(1, -(-n // most)).astype(np.int32) for n, most in ((begins, QUERIES), (counts, MEMBERS))]
    split = lambda n, salt: F.pmod(F.xxhash64("e", F.lit(salt)), F.lit(n)[F.col("cell")]).cast("int")
    slot = F.lit(bundled(begins, parts[0], QUERIES))[F.col("cell")] + split(parts[0], 3)
    probes = asked.withColumn("slot", slot).select(F.col("e").alias("q"), "v", "slot", F.explode("cells").alias("cell"))
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts[1])[F.col("cell")] - 1)))
    wanted = tables.keep(probes.select("cell", "block", "slot").distinct())
    members = index.select("e", "v", "cell", split(parts[1], 4).alias("block")).join(wanted, ["cell", "block"])

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "e": [], "score": []}).astype({"q": "int64", "e": "int64"})
        parts, own = [], right.groupby("cell").indices
        for cell, asking in left.groupby("cell").indices.items():
            if cell in own:
                q, ids = left.iloc[asking], right["e"].to_numpy()[own[cell]]
                places, scores = best(matrix(q["v"]), ids, matrix(right["v"].iloc[own[cell]]), k + 1)
                parts.append(pd.DataFrame({"q": np.repeat(q["q"].to_numpy(), places.shape[1]), "e": ids[places].ravel(), "score": scores.ravel()}))
        if not parts:
            return rerank(left[:0], right)
        out = pd.concat(parts).sort_values(["q", "score", "e"], ascending=[True, False, True])
        return out.groupby("q").head(k + 1)

    keys = ["slot", "bundle"]
    bundle = (F.lit(bundled(counts, parts[1], MEMBERS))[F.col("cell")] + F.col("block")).alias("bundle")  # a query brings back its best of a bundle
    probes, members = probes.select("q", "v", "cell", "slot", bundle), members.select("e", "v", "cell", "slot", bundle)
    found = probes.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(rerank, "q bigint, e bigint, score double")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "e")
    found = tables.keep(found.withColumn("at", F.row_number().over(nearest)).filter(F.col("at") <= k + 1).drop("at"))
    named = found.join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("id"))
    named = tables.keep(named.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("at") <= k + 1))
    lists = named.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score"))).alias("near"))  # k + 1 at most
    queries = rows.filter(is_query(F.col("id"))).join(asked.withColumnRenamed("e", "q"), "v").select("id", "q")
    own = F.filter("near", lambda x: x["id"] != F.col("id"))
    out = queries.join(lists, "q").select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def measure(index: DataFrame, asked: DataFrame, first, second, counts: np.ndarray, k: int, recall: float) -> float:
    """How many vectors a walk has to take in to find the share `recall` of the exact neighbours of a sample of
    queries, MEASURED or about as many. Each batch of the index keeps its k best for each of them."""
    known = asked.toPandas()
    if not len(known):
        return 1.0
    q, names = matrix(known["v"]), known["e"].to_numpy()

    def exact(batches):
        for b in batches:
            if len(b):
                ids = b["e"].to_numpy()
                places, scores = best(q, ids, matrix(b["v"]), k + 1)
                yield pd.DataFrame({"q": np.repeat(names, places.shape[1]), "cell": b["cell"].to_numpy()[places].ravel(), "e": ids[places].ravel(), "score": scores.ravel()})

    top = index.select("e", "v", "cell").mapInPandas(exact, "q bigint, cell int, e bigint, score double")
    top = top.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "e"))).filter(F.col("at") <= k + 1).toPandas()
    at = {e: {c: held + counts[c] for c, held in walk(v, first, second, counts, np.inf)} for e, v in zip(names, q, strict=True)}
    needed = np.sort([at[e][c] for e, c in zip(top["q"], top["cell"], strict=True)])
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
