"""What the operators of this subpackage share: words, keys and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these six (blank, TAB, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def quoted(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def tucked(df: DataFrame, **used: str) -> DataFrame:
    """The columns that an operator works on, under its own names (own name = name in df), and all others in one struct `row`,
    so that none of their names meets one that the operator makes."""
    rest = [quoted(c) for c in df.columns if c not in used.values()]
    return df.select(*[quoted(c).alias(own) for own, c in used.items()], (F.struct(*rest) if rest else F.lit(True)).alias("row"))


def untucked(columns: list[str], **used: str) -> list[Column]:
    """The columns that tucked was given, in their order, to be selected."""
    own = {c: name for name, c in used.items()}
    return [(F.col(own[c]) if c in own else F.col("row").getField(c)).alias(c) for c in columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row, though body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def filter_after(df: DataFrame, condition: Column) -> DataFrame:
    """df.filter(condition), but evaluated on the columns as computed. The optimizer would push the filter below their
    projections and copy their expressions into it, into lambdas as well; it doesn't where the filter hangs on a row number.
    The number's name is one that df does not have."""
    number = "_row"
    while number in map(str.lower, df.columns):
        number = f"_{number}"
    return df.withColumn(number, F.monotonically_increasing_id()).filter(condition & (F.col(number) >= 0)).drop(number)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset and Spark runs on
    one machine, as in tests, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        context.setCheckpointDir(named or tempfile.mkdtemp("-checkpoints"))
    return context.getCheckpointDir()


class Tables:
    """Intermediate results written as Parquet to the shared folder. They cut lineage, so a lost executor costs
    no recomputation of what came before, and they give the planner true sizes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.count, self.held = 0, []

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df.write.parquet(path)
        self.held.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.held[-1][0]

    def only(self, *needed: DataFrame) -> None:
        """Deletes what keep() has returned, but for what is still needed: nothing that is left to compute may read the others."""
        jvm = self.spark.sparkContext._jvm
        for df, path in self.held:
            if not any(df is x for x in needed):
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.held = [x for x in self.held if any(x[0] is y for y in needed)]

    def keep_part(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df as one more part of a table and returns this part."""
        self.count += 1
        path = f"{self.root}/{name}/{self.count:06d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def parts(self, name: str, schema) -> DataFrame:
        """All parts of a table."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}")


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, comp) for each node that has an edge,
    comp being the smallest node of its component.

    Every round hooks each node to its smallest neighbour, if that is smaller, follows the hooks to
    their ends by doubling, and contracts the edges to these; edges within one node go. A round leaves half of
    the nodes with edges at most. Each round is written out; it ends when no edge is left. Only the
    answers to whether an edge is left or a hook moved reach the driver.
    """
    tables, pair = Tables(tables.spark), (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = tables.keep(edges.select(*pair).filter("a <> b").distinct())
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    labels = tables.keep(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")))
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hooks = tables.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to")))
        while True:
            next_ = hooks.select(F.col("node").alias("to"), F.col("to").alias("then"))
            hooks = tables.keep(hooks.join(next_, "to").select("node", F.col("to").alias("was"), F.col("then").alias("to")))
            if not hooks.filter("was <> to").limit(1).count():
                break
        roots = hooks.select("node", F.col("to").alias("root"))
        at = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        contracted = edges.join(at("a"), "a").join(at("b"), "b").filter("root_a <> root_b")
        edges = tables.keep(contracted.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        moved = labels.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left")
        labels = tables.keep(moved.select("node", F.coalesce("root", "comp").alias("comp")))
        tables.only(edges, labels)
    return labels
