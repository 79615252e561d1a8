"""Splits, samples, permutations and running totals over a total order, without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from creditloom.functions.rules import row_hash
from creditloom.runtime import local_table, materialize

_DIGITS = 4  # hex digits resolved per pass: at most 65,536 counts reach the driver


# --- splits ----------------------------------------------------------------------------------


def temporal_split(
    df: DataFrame, train: list[str], valid: list[str], test: list[str], column: str = "quarter"
) -> DataFrame:
    """Tag rows by period; rows of other periods are left out (a pruned scan on a partitioned store)."""
    period = F.col(column)
    split = (
        F.when(period.isin(train), "train").when(period.isin(valid), "valid").when(period.isin(test), "test")
    )
    return df.where(period.isin([*train, *valid, *test])).withColumn("split", split)


def hash_cutoffs(df: DataFrame, hashed: Column, counts: list[int]) -> list[str]:
    """For each count, the hash value up to which exactly that many rows lie.

    Radix selection: every pass counts rows by the next four hex digits within the prefixes still
    undecided. The hash is uniform, so two passes usually leave a handful of rows per prefix.
    """
    hashes = df.select(hashed.alias("h"))
    open_: dict[int, tuple[str, int]] = {k: ("", k) for k in set(counts)}
    found: dict[int, str] = {}
    depth = 0
    while open_:
        depth += _DIGITS
        prefixes = sorted({p for p, _ in open_.values()})
        scope = hashes if prefixes == [""] else hashes.where(
            F.substring("h", 1, depth - _DIGITS).isin(prefixes)
        )
        rows = (
            scope.groupBy(F.substring("h", 1, depth).alias("p")).agg(F.count("*").alias("n")).collect()
        )
        sizes = sorted((r["p"], r["n"]) for r in rows)
        for count, (prefix, left) in list(open_.items()):
            for p, n in sizes:
                if not p.startswith(prefix):
                    continue
                if left > n:
                    left -= n
                    continue
                if left == n:
                    # everything under this prefix belongs below the cut
                    found[count] = p + "g" * (32 - len(p))
                elif depth >= 32:
                    raise ValueError("the split key is not unique")
                else:
                    open_[count] = (p, left)
                    break
                del open_[count]
                break
            else:
                raise ValueError(f"fewer than {count} rows")
    return [found[k] for k in counts]


def hash_split(
    df: DataFrame, key: list[str], seed: int = 42, holdout: float = 0.20, test_share: float = 0.50
) -> DataFrame:
    """Reproducible random split with exact sizes: ``holdout`` of the rows, of which ``test_share``
    is the test set. Rows are ordered by a hash of their (unique) key."""
    n = df.count()
    n_holdout = math.ceil(n * holdout)
    n_test = math.ceil(n_holdout * test_share)
    n_train, n_valid = n - n_holdout, n_holdout - n_test
    hashed = row_hash(key, seed)
    marks = [m for m in (n_train, n_train + n_valid) if 0 < m]
    cut = dict(zip(marks, hash_cutoffs(df, hashed, marks))) if marks else {}
    split = (
        F.when(hashed <= cut.get(n_train, ""), "train")
        .when(hashed <= cut.get(n_train + n_valid, ""), "valid")
        .otherwise("test")
    )
    return df.withColumn("split", split)


def sample_cap(df: DataFrame, key: list[str], rows: int | None, seed: int = 42) -> DataFrame:
    """The whole frame if it has at most ``rows`` rows, else exactly ``rows`` of them."""
    if rows is None:
        return df
    if df.count() <= rows:
        return df
    if rows == 0:
        return df.limit(0)
    hashed = row_hash(key, seed)
    return df.where(hashed <= hash_cutoffs(df, hashed, [rows])[0])


# --- permutation -----------------------------------------------------------------------------


def permute_columns(df: DataFrame, columns: list[str], key: list[str], seed: int = 42, suffix: str = "__permuted") -> DataFrame:
    """Add a permuted copy of each column, every other column staying where it is.

    All rows stand in one circle, in the order of a hash of their (unique) key. The first column is handed on by one
    place, the second by two and so on. The circle is cut into ranges; each range also gets the rows that follow its
    last one, as many as there are columns, so all columns share one order and no task sees more than one range.
    """
    p = len(columns)
    ranged = materialize(
        df.withColumn("__hash", row_hash(key, seed)).repartitionByRange("__hash").withColumn("__range", F.spark_partition_id()), "circle"
    )
    walk = Window.partitionBy("__range").orderBy("__hash")
    # only what is moved goes on ahead; rows of the ranges' beginnings are found again by their place
    heads = ranged.select("__range", "__hash", *columns).withColumn("__place", F.row_number().over(walk)).where(F.col("__place") <= p)
    # one row for each range
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    after: list[tuple[int, int, int, int]] = []
    for i, to in enumerate(order):
        given, at = 0, i + 1
        while given < p:
            source = order[at % len(order)]
            for place in range(1, min(sizes[source], p - given) + 1):
                given += 1
                after.append((source, place, to, given))
            at += 1
    plan = df.sparkSession.createDataFrame(after, "__range int, __place int, __to int, __behind int")
    behind = heads.join(plan, ["__range", "__place"]).select(F.col("__to").alias("__range"), "__behind", *columns)
    both = ranged.withColumn("__behind", F.lit(0)).unionByName(behind, allowMissingColumns=True)
    on = Window.partitionBy("__range").orderBy("__behind", "__hash")
    moved = both.withColumns({c + suffix: F.lead(c, i).over(on) for i, c in enumerate(columns, 1)})
    return moved.where("__behind = 0").drop("__range", "__hash", "__behind")


# --- running totals --------------------------------------------------------------------------


def running_totals(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Add ``<name>_before``: for each row the total of ``name`` over all rows ordered before it.

    ``order`` must be unique. Rows are range-partitioned and written once with their range number;
    totals per range (as many as partitions) give each range its offset, and within a range an
    ordinary window runs. No task sees more than one range.
    """
    ranged = materialize(
        df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged"
    )
    # one row per shuffle partition
    totals = ranged.groupBy("__range").agg(*[F.sum(s).alias(s) for s in sums]).orderBy("__range").collect()
    schema = T.StructType().add("__range", T.IntegerType())
    for s in sums:
        schema = schema.add(f"__offset_{s}", T.DoubleType())
    offsets, so_far = [], [0.0] * len(sums)
    for row in totals:
        offsets.append((row["__range"], *so_far))
        so_far = [a + (row[s] or 0) for a, s in zip(so_far, sums)]
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(local_table(df.sparkSession, offsets, schema), "__range")
    return placed.select(
        *df.columns,
        *[
            (F.col(f"__offset_{s}") + F.coalesce(F.sum(s).over(before), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
    )
