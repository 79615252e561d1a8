"""Distributed helpers of the text operators: ranks without a global sort, connected components, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.runtime import materialize as store

__all__ = ["components", "documents_only", "rank_within", "store", "text_key"]


def documents_only(docs: DataFrame) -> DataFrame:
    """The two columns that operators read. Other columns, whatever their names, stay outside."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key(column: str = "text") -> Column:
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.xxhash64(column)


def rank_within(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2 ... within each value of ``key`` (non-null columns).

    Rows are numbered within their key and scan partition; the partitions' counts give the offsets. No task
    holds more of one key than the rows of one scan partition or one count for each partition.
    """
    placed = store(
        df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), label
    )
    counts = placed.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_row")) - 1
    numbered = placed.withColumn("_local", local)
    return numbered.join(offsets, [*key, "_part"]).withColumn("rank", F.col("_before") + F.col("_local")).drop(
        "_part", "_row", "_local", "_before"
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the least node connected to it.

    Distributed union-find by alternating large and small stars: every node hands its larger neighbours to its
    least neighbour, then its smaller ones, until nothing changes. Each round is written to the shared folder.
    """
    now = store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label
    )
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        now = store(small, label)
        before, seen = seen, _digest(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
