"""Exact quantiles of large, possibly continuous columns, for any number of groups.

Built-in exact percentiles hold every distinct value of a group in one task. Here order statistics are found by radix
selection on the 64-bit pattern of the doubles, written as a number of the same order. A pass counts the values of
all groups and columns by their next 20 bits, in one aggregation that combines before its shuffle; the buckets that
hold a wanted rank stay open for the next pass, unless all their values are equal. Columns of few distinct values are
settled by one pass, continuous ones mostly by two, and after four no bit is left. Groups, counts and open buckets are
tables throughout; a group has at most 2**20 buckets in a pass, however many rows it has.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.runtime import ident, materialize, number, quoted

Quantile = namedtuple("Quantile", "column prob value n")

#: Low bits that a pass leaves out.
_SHIFTS = (44, 24, 4, 0)
_FEW_ROWS = 1_000_000
_LEAST_NORMAL = "2.2250738585072014E-308D"


def ordered_bits(value: str) -> str:
    """SQL for a BIGINT that orders like the double ``value``: its bit pattern, negative numbers mirrored.

    Both zeros are one value and NaN is the largest, as in comparisons. Every step is exact.
    """
    size = f"abs({value})"
    # the logarithm may be off by one next to a power of two
    guess = f"floor(log2({size}))"
    exponent = f"({guess} + CASE WHEN {size} < pow(2D, {guess}) THEN -1 WHEN {size} >= 2 * pow(2D, {guess}) THEN 1 ELSE 0 END)"
    return _ordered_bits(value, exponent, f"pow(2D, {exponent})")


def _ordered_bits(value: str, exponent: str, scale: str) -> str:
    size = f"abs({value})"
    normal = f"shiftleft(CAST({exponent} + 1023 AS BIGINT), 52) + CAST(({size} / ({scale}) - 1) * 4503599627370496D AS BIGINT)"
    small = f"CAST({size} * {2.0**537!r}D * {2.0**537!r}D AS BIGINT)"
    pattern = (
        f"CASE WHEN isnan({value}) THEN shiftleft(2047L, 52) + 1 WHEN {size} = double('infinity') THEN shiftleft(2047L, 52) "
        f"WHEN {size} < {_LEAST_NORMAL} THEN {small} ELSE {normal} END"
    )
    return f"CASE WHEN {value} < 0 THEN -1 - ({pattern}) ELSE {pattern} END"


def _group(by: list[str]) -> Column:
    """All group columns as one value, so that nulls match in joins; a table without groups is one group."""
    return F.struct(*[F.col(ident(b)) for b in by]) if by else F.struct(F.lit(0).alias("all"))


def _values(df: DataFrame, columns: list[str], by: list[str], used: list[int]) -> DataFrame:
    """(g, c, v, key): the non-null values of the columns with the numbers ``used``."""
    cells = ", ".join(f"named_struct('c', {i}, 'v', CAST({ident(columns[i])} AS DOUBLE))" for i in used)
    long = df.select(_group(by).alias("g"), F.expr(f"inline(array({cells}))")).where("v IS NOT NULL")
    # one logarithm and one power for each value, in columns of their own, instead of one wherever they are needed
    steps = long.withColumn("__guess", F.expr("floor(log2(abs(v)))")).withColumn("__power", F.expr("pow(2D, __guess)"))
    steps = steps.withColumn("__off", F.expr("CASE WHEN abs(v) < __power THEN -1 WHEN abs(v) >= 2 * __power THEN 1 ELSE 0 END"))
    scale = "CASE WHEN __off = 0 THEN __power ELSE pow(2D, __guess + __off) END"
    return steps.withColumn("key", F.expr(_ordered_bits("v", "(__guess + __off)", scale))).drop("__guess", "__power", "__off")


def _marks(probs: list[float]) -> str:
    return "array(" + ", ".join(number(p) for p in probs) + ")"


def _ranks(probs: list[float]) -> Column:
    """Ranks from 0 that the interpolation of ``probs`` needs, among ``total`` values."""
    return F.expr(f"array_distinct(flatten(transform({_marks(probs)}, p -> array(floor((total - 1) * p), ceil((total - 1) * p)))))")


def order_statistics(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = ()) -> DataFrame:
    """(g, c, total, rank, v): every value that ``probs`` need, by group struct and column number."""
    by, settled = list(by), []
    asked: DataFrame | None = None  # ranks still looked for, each in the bucket ``parent`` that has ``below`` values before it
    used = list(range(len(columns)))
    for level, shift in enumerate(_SHIFTS):
        values = _values(df, columns, by, used).withColumn("bits", F.shiftright("key", shift))
        values = values.withColumn("parent", F.shiftright("key", _SHIFTS[level - 1]) if level else F.lit(0).cast("long"))
        if asked is not None:
            values = values.join(asked.select("g", "c", "parent").distinct(), ["g", "c", "parent"])
        counts = materialize(
            values.groupBy("g", "c", "parent", "bits").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "quantile-counts"
        )
        if asked is None:
            totals = counts.groupBy("g", "c", "parent").agg(F.sum("n").alias("total"))
            asked = totals.select("g", "c", "parent", "total", F.lit(0).cast("long").alias("below"), F.explode(_ranks(probs)).alias("rank"))
        hit = materialize(_bucket_of_rank(counts, asked), "quantile-buckets")
        same = F.col("low").eqNullSafe(F.col("high")) if shift else F.lit(True)
        settled.append(hit.where(same).select("g", "c", "total", "rank", F.col("low").alias("v")))
        asked = hit.where(~same).select("g", "c", F.col("bits").alias("parent"), "total", "below", "rank")
        used = sorted(r["c"] for r in asked.select("c").distinct().collect())  # at most one row for each column
        if not used:
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def _bucket_of_rank(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The bucket of each asked rank: buckets and ranks stand in one order, and a rank is in the last bucket before it."""
    within = Window.partitionBy("g", "c", "parent")
    first = F.coalesce(F.sum("n").over(within.orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = counts.withColumn("first", first).select("g", "c", "parent", F.col("first").alias("at"), F.struct("bits", "first", "low", "high").alias("b"))
    both = buckets.unionByName(asked.withColumn("at", F.col("rank") - F.col("below")), allowMissingColumns=True)
    upto = within.orderBy("at", F.col("rank").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("b", F.last("b", ignorenulls=True).over(upto)).where("rank IS NOT NULL")
    return found.select("g", "c", "total", "rank", "b.bits", "b.low", "b.high", (F.col("below") + F.col("b.first")).alias("below"))


def quantile_arrays(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = ()) -> DataFrame:
    """(g, column, n, q): the linearly interpolated quantiles of each group and column, in the order of ``probs``.

    Groups and columns without a value have no row. ``g`` is a struct of the group columns.
    """
    found = order_statistics(df, columns, probs, by).groupBy("g", "c", "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    names = "array(" + ", ".join(quoted(c) for c in columns) + ")"
    ends = f"transform({_marks(probs)}, p -> named_struct('a', at[floor((total - 1) * p)], 'b', at[ceil((total - 1) * p)], 'x', (total - 1) * p - floor((total - 1) * p)))"
    # equal neighbours need no arithmetic, which would turn infinite ones into NaN
    value = f"transform({ends}, e -> CASE WHEN e.a = e.b THEN e.a ELSE e.a + (e.b - e.a) * e.x END)"
    return found.selectExpr("g", f"{names}[c] AS column", "total AS n", f"{value} AS q")


def quantile_table(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = ()) -> DataFrame:
    """Group columns, column, prob, value, n: one row for each quantile of the non-null values."""
    made = quantile_arrays(df, columns, probs, by)
    marks = F.array(*[F.lit(float(p)) for p in probs])
    flat = made.select("g", "column", "n", F.posexplode("q").alias("i", "value"))
    return flat.select(*[F.col("g")[b].alias(b) for b in by], "column", F.get(marks, "i").alias("prob"), "value", "n")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> list[Quantile]:
    """Quantiles over the whole table, by column and probability; None and a count of 0 for a column without values."""
    if not columns:
        return []
    # one row for each column
    found = {r["column"]: r for r in quantile_arrays(df, columns, probs).collect()}
    return [Quantile(c, p, found[c]["q"][i] if c in found else None, found[c]["n"] if c in found else 0) for c in columns for i, p in enumerate(probs)]


def exact_medians(df: DataFrame, columns: list[str], rows: int | None = None) -> dict[str, float | None]:
    """Medians by column. A table that is known to have few ``rows`` is sorted by one task instead of counted in passes."""
    if not columns or rows is None or rows > _FEW_ROWS:
        return {q.column: q.value for q in exact_quantiles(df, columns, [0.5])}
    at = "(size(s) - 1) * 0.5D"
    ends = f"transform(array(sort_array(array_compact(s))), s -> named_struct('a', get(s, CAST(floor({at}) AS INT)), 'b', get(s, CAST(ceil({at}) AS INT)), 'x', {at} - floor({at})))"
    value = f"transform({ends}, e -> CASE WHEN e.a = e.b THEN e.a ELSE e.a + (e.b - e.a) * e.x END)[0]"
    lists = [F.struct(F.lit(i).alias("i"), F.collect_list(F.col(c).cast("double")).alias("s")) for i, c in enumerate(columns)]
    found = {r["i"]: r["v"] for r in df.agg(F.array(*lists).alias("l")).select(F.inline("l")).selectExpr("i", f"{value} AS v").collect()}
    return {c: found[i] for i, c in enumerate(columns)}


def moments(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(g, column, n, mean, std, low, high) of every group and column, also of those without values: one scan."""
    cells = []
    for c in columns:
        v = f"CAST({ident(c)} AS DOUBLE)"
        cells.append(
            f"named_struct('column', {quoted(c)}, 'n', count({v}), 'mean', avg({v}), 'std', stddev_samp({v}), 'low', min({v}), 'high', max({v}))"
        )
    grouped = df.groupBy(_group(list(by)).alias("g")) if by else df.groupBy()
    row = grouped.agg(F.expr(f"array({', '.join(cells)})").alias("cells"))
    return row.select("g" if by else _group([]).alias("g"), F.inline("cells"))
