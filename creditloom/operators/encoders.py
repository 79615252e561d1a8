"""Feature preparation that is fitted on one frame and applied to any other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom import schemas as S
from creditloom.functions.rules import category_text, numeric_columns, prepare_frame, row_hash
from creditloom.operators.quantiles import exact_medians
from creditloom.runtime import local_table, materialize

#: A value that holds this share of a column's rows is looked up in the row itself; there are at most 1 / share.
COMMON_SHARE = 0.01
_SALTS = 1024


# --- imputation and scaling ------------------------------------------------------------------


def median_fill(train: DataFrame, df: DataFrame) -> DataFrame:
    """Numbers take the training median, everything else the missing category."""
    numeric = [c for c in numeric_columns(train) if c in df.columns]
    medians = exact_medians(train, numeric)
    out = {}
    for c in df.columns:
        if c in medians:
            value = F.col(c).cast("double")
            out[c] = value if medians[c] is None else F.coalesce(value, F.lit(medians[c]))
        else:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit(S.MISSING_CATEGORY))
    return df.select(*[c.alias(n) for n, c in out.items()])


@dataclass
class NumericScaler:
    """Median imputation, then standardisation with the population standard deviation."""

    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str], rows: int | None = None) -> "NumericScaler":
        """``rows``, if known, lets a small table take its medians in one job."""
        medians = {c: 0.0 if m is None else m for c, m in exact_medians(train, columns, rows).items()}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns}
        row = train.agg(
            *[F.avg(x).alias(f"mean_{c}") for c, x in filled.items()],
            *[F.stddev_pop(x).alias(f"std_{c}") for c, x in filled.items()],
        ).first()
        return cls(
            medians,
            {c: row[f"mean_{c}"] or 0.0 for c in columns},
            {c: row[f"std_{c}"] or 1.0 for c in columns},  # a constant column is only centred
        )

    def filled(self, column: str) -> Column:
        return F.coalesce(F.col(column).cast("double"), F.lit(self.medians[column]))

    def scaled(self, column: str) -> Column:
        return (self.filled(column) - self.means[column]) / self.stds[column]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.medians})


def impute_mode(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing categories take the most frequent training value, the smallest one on a tie."""
    counts = _category_counts(train, columns)
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value")
    )
    modes = {r["column"]: r["value"] for r in best.collect()}  # one row per column
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(modes[c])) for c in columns if c in modes}
    )


# --- categories ------------------------------------------------------------------------------


def _category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("count"))
    )


def _known(text: Column, common: dict[str, list], place: int = 0) -> Column:
    """The field of a common value, found inside the row; null for other texts."""
    if not common:
        return F.lit(None).cast("double")
    return F.get(F.create_map(*[x for v, found in common.items() for x in (F.lit(v), F.array(*[F.lit(y) for y in found]))])[text], F.lit(place))


def find_values(df: DataFrame, text: Column, table: DataFrame, fields: list[str], common: dict[str, list], complete: bool) -> DataFrame:
    """Add ``fields`` of ``table`` (value, *fields) for the category ``text`` of each row; null where it is not there.

    Common values come from ``common`` (value -> fields) inside the row, so a value that fills half of the table goes
    through no shuffle. The rest is joined unless ``common`` is ``complete``; rows that need no lookup are spread out.
    """
    known = F.create_map(*[x for v, found in common.items() for x in (F.lit(v), F.array(*[F.lit(y) for y in found]))]) if common else None
    here = known[text] if common else F.lit(None).cast("array<double>")
    out = df.withColumn("__here", here)
    if complete:
        return out.withColumns({f: F.get("__here", F.lit(i)) for i, f in enumerate(fields)}).drop("__here")
    settled = F.col("__here").isNotNull() | text.isNull()
    out = out.withColumn("__value", text).withColumn("__salt", F.when(settled, F.monotonically_increasing_id() % _SALTS).otherwise(F.lit(-1).cast("long")))
    other = table.select(F.col("value").alias("__value"), F.lit(-1).cast("long").alias("__salt"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = out.join(other, ["__value", "__salt"], "left")
    return out.withColumns({f: F.coalesce(F.get("__here", F.lit(i)), f"__{f}") for i, f in enumerate(fields)}).drop(
        "__here", "__value", "__salt", *[f"__{f}" for f in fields]
    )


@dataclass
class Categories:
    """Codes 0, 1, 2 ... of the categories of several columns, in sorted order within a column.

    The dictionary is a table of any size; the driver holds how many categories each column has and the codes of the
    common ones.
    """

    table: DataFrame  # column, value, code
    sizes: dict[str, int]
    common: dict[str, dict[str, float]]

    def values(self, column: str) -> list[str]:
        """All categories of a column, for reports and models that have a coefficient for each of them."""
        rows = self.table.where(F.col("column") == column).select("value", "code").collect()
        return [r["value"] for r in sorted(rows, key=lambda r: r["code"])]

    def add_codes(self, df: DataFrame, suffix: str) -> DataFrame:
        """Add ``<column><suffix>``: the code of each value, null for values not seen when fitting."""
        inside: dict[str, Column] = {}  # found without a join, all columns in one step
        for c, size in self.sizes.items():
            known = {v: [code] for v, code in self.common[c].items()}
            if len(known) == size:
                inside[c + suffix] = _known(F.col(c).cast("string"), known)
                continue
            part = self.table.where(F.col("column") == c).select("value", F.col("code").alias(c + suffix))
            df = find_values(df.withColumns(inside) if inside else df, F.col(c).cast("string"), part, [c + suffix], known, False)
            inside = {}
        return df.withColumns(inside) if inside else df


def fit_categories(frame: DataFrame, columns: list[str], min_count: int = 1) -> Categories:
    """Dictionary of all categories with at least ``min_count`` rows.

    Values are range-partitioned; a range's place in its column follows from the sizes of the ranges before it.
    """
    counts = _category_counts(frame, columns).where(F.col("count") >= min_count)
    ranged = materialize(counts.repartitionByRange("column", "value").withColumn("__range", F.spark_partition_id()), "categories")
    sizes = ranged.groupBy("column", "__range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("column").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("column", "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("column", "__range").orderBy("value")) - 1
    coded = ranged.withColumn("local", local).join(offsets, ["column", "__range"])
    table = materialize(coded.select("column", "value", "count", (F.col("before") + F.col("local")).cast("double").alias("code")), "category-codes")
    totals = {r["column"]: r for r in table.groupBy("column").agg(F.count("*").alias("n"), F.sum("count").alias("rows")).collect()}
    common: dict[str, dict[str, float]] = {c: {} for c in columns}
    least = F.create_map(*[x for c, r in totals.items() for x in (F.lit(c), F.lit(r["rows"] * COMMON_SHARE))]) if totals else None
    if totals:  # at most 1 / COMMON_SHARE rows of each column
        for r in table.where(F.col("count") >= least[F.col("column")]).collect():
            common[r["column"]][r["value"]] = r["code"]
    return Categories(table.drop("count"), {c: totals[c]["n"] if c in totals else 0 for c in columns}, common)


def ordinal_encode(df: DataFrame, categories: Categories, suffix: str = "_code") -> DataFrame:
    """Codes in sorted category order, -1 for values not seen when fitting."""
    out = categories.add_codes(df, suffix)
    return out.withColumns({c + suffix: F.coalesce(c + suffix, F.lit(-1.0)) for c in categories.sizes})


def _active_indicators(categories: Categories, suffix: str) -> list[Column]:
    """Per coded column the entry ``column__value`` -> 1, or null for a value outside its dictionary."""
    return [
        F.when(
            F.col(c + suffix).isNotNull(),
            F.struct(F.concat_ws("__", F.lit(c), F.col(c).cast("string")).alias("feature"), F.lit(1.0).alias("value")),
        )
        for c in categories.sizes
    ]


def one_hot_long(df: DataFrame, categories: Categories, keep: list[str]) -> DataFrame:
    """One row per active indicator ``column__value``; unknown values have none."""
    coded = categories.add_codes(df, "__index")
    entries = F.array_compact(F.array(*_active_indicators(categories, "__index")))
    return coded.select(*keep, F.inline(entries))


# --- tabular preprocessor ----------------------------------------------------------------------


@dataclass
class TabularPreprocessor:
    """Prepared lending features as one model vector.

    ``linear``: scaled numbers and one indicator per frequent category.
    ``tree``: filled numbers and ordinal codes.
    """

    mode: str
    numeric: list[str] = field(default_factory=lambda: list(S.LENDING_NUMERIC))
    categorical: list[str] = field(default_factory=lambda: list(S.LENDING_CATEGORICAL))
    min_category_count: int = 20
    scaler: NumericScaler | None = None
    categories: Categories | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("linear", "tree"):
            raise ValueError(f"unknown mode {self.mode!r}; linear and tree are supported")

    @property
    def raw_columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def _frame(self, df: DataFrame) -> DataFrame:
        other = [c for c in df.columns if c not in self.raw_columns]
        return prepare_frame(df, self.numeric, self.categorical, keep=other)

    def fit(self, train: DataFrame) -> "TabularPreprocessor":
        # medians, moments and dictionaries read the prepared columns several times
        frame = materialize(self._frame(train).select(*self.raw_columns), "prepared")
        self.scaler = NumericScaler.fit(frame, self.numeric, frame.count())
        least = self.min_category_count if self.mode == "linear" else 1
        self.categories = fit_categories(frame, self.categorical, least)
        return self

    @property
    def feature_names(self) -> list[str]:
        if self.mode == "tree":
            return self.raw_columns
        return [*self.numeric, *[f"{c}__{v}" for c in self.categorical for v in self.categories.values(c)]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Encoded columns: numbers in place, categories as indicators in long form or as codes."""
        frame = self._frame(df)
        if self.mode == "tree":
            frame = ordinal_encode(frame, self.categories, suffix="__code")
            frame = frame.withColumns({c: self.scaler.filled(c) for c in self.numeric})
            return frame.drop(*self.categorical).withColumnsRenamed(
                {f"{c}__code": c for c in self.categorical}
            )
        return self.scaler.transform(frame)

    def transform_long(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Non-zero entries of the encoded matrix as (row key, feature, value)."""
        done = self.transform(df)
        names = self.numeric if self.mode == "linear" else self.feature_names
        entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names]
        if self.mode == "linear":
            done = self.categories.add_codes(done, "__index")
            entries += _active_indicators(self.categories, "__index")
        return done.select(*keep, F.inline(F.array_compact(F.array(*entries))))

    def assemble(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the model vector and leave every column as it was; indicators stay sparse."""
        other = [c for c in df.columns if c not in self.raw_columns]
        done = self.transform(df.withColumn("__raw", F.struct(*self.raw_columns)))
        if self.mode == "tree":
            inputs = self.feature_names
        else:
            sizes = {c: n for c, n in self.categories.sizes.items() if n}
            used = list(sizes)
            done = self.categories.add_codes(done, "__index")
            for c, n in sizes.items():
                # the column says how many values it has; the last one, "not in the dictionary", is dropped
                nominal = {"ml_attr": {"type": "nominal", "name": f"{c}__index", "num_vals": n + 1}}
                done = done.withColumn(f"{c}__index", F.coalesce(f"{c}__index", F.lit(float(n))).alias(f"{c}__index", metadata=nominal))
            if used:
                done = OneHotEncoder(
                    inputCols=[f"{c}__index" for c in used], outputCols=[f"{c}__hot" for c in used], dropLast=True
                ).fit(done).transform(done)
            inputs = [*self.numeric, *[f"{c}__hot" for c in used]]
        done = VectorAssembler(inputCols=inputs, outputCol=output).transform(done)
        return done.select(*other, "__raw.*", output)


# --- target encoding -----------------------------------------------------------------------------


@dataclass
class TargetEncoder:
    """Category -> shrunken target mean; training rows are encoded from the other folds only.

    Shrinkage follows the within-category variance against the overall variance of the target.
    """

    columns: list[str]
    target: str
    key: list[str]
    folds: int = 5
    seed: int = 42

    def fit(self, train: DataFrame) -> "TargetEncoder":
        y = F.col(self.target).cast("double")
        self.mean = train.agg(F.avg(y)).first()[0]
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), category_text(train, c).alias("value")) for c in self.columns]
        )
        # sums of the centred target, so that variances do not cancel
        cells = (
            train.select(self._fold().alias("fold"), (y - self.mean).alias("d"), F.inline(pairs))
            .groupBy("column", "value", "fold")
            .agg(F.count("d").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
        )
        self.cells = materialize(cells, "target-cells")
        overall = (
            self.cells.where(F.col("column") == self.columns[0])
            .groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).collect()
        )
        whole = tuple(sum(r[c] for r in overall) for c in ("n", "s", "q"))
        self.rest = {  # statistics of all rows outside a fold
            r["fold"]: tuple(w - r[c] for w, c in zip(whole, ("n", "s", "q"))) for r in overall
        }
        self.whole = whole
        return self

    def _fold(self) -> Column:
        digits = F.substring(row_hash(self.key, f"{self.seed}:fold"), 1, 8)
        return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(self.folds)).cast("int")

    def _encoding(self, n: Column, s: Column, q: Column, base: tuple[Column, Column, Column]) -> Column:
        base_mean = base[1] / base[0]
        base_var = base[2] / base[0] - base_mean * base_mean
        within = F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
        share = F.try_divide(base_var * n, base_var * n + within)
        shrunk = F.coalesce(share * (s / n) + (1 - share) * base_mean, base_mean)
        return self.mean + F.when(n > 0, shrunk).otherwise(base_mean)

    def full_table(self) -> DataFrame:
        """column, value, encoding — for rows outside the training set."""
        sums = self.cells.groupBy("column", "value").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
        base = tuple(F.lit(float(v)) for v in self.whole)
        return sums.select("column", "value", self._encoding(F.col("n"), F.col("s"), F.col("q"), base).alias("encoding"))

    def fold_table(self) -> DataFrame:
        """column, value, fold, encoding — for the training rows of that fold."""
        totals = self.cells.groupBy("column", "value").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "s", "q")])
        rows = [(f, *(float(v) for v in stats)) for f, stats in self.rest.items()]
        rest = local_table(self.cells.sparkSession, rows, "fold int, rest_n double, rest_s double, rest_q double")
        joined = self.cells.join(totals, ["column", "value"]).join(rest, "fold")
        n, s, q = (F.col(f"all_{c}") - F.col(c) for c in ("n", "s", "q"))
        n = F.nullif(n.cast("double"), F.lit(0.0))
        base = tuple(F.col(f"rest_{c}") for c in ("n", "s", "q"))
        return joined.select("column", "value", "fold", self._encoding(n, s, q, base).alias("encoding"))

    def transform(self, df: DataFrame, training: bool = False, suffix: str = "_encoded") -> DataFrame:
        """Add one encoded column per category; unseen categories get the overall mean.

        Training rows are looked up by category and fold, others by category.
        """
        table = self.fold_table() if training else self.full_table()
        fold = F.concat(F.lit("|"), F.col("fold")) if training else F.lit("")
        table = materialize(table.withColumn("value", F.concat("value", fold)), "target-encoding")
        counts = self.cells.groupBy("column", "value").agg(F.sum("n").alias("n"))
        least = self.whole[0] * COMMON_SHARE
        # at most folds / COMMON_SHARE rows of each column
        often = counts.where(F.col("n") >= least).select("column", F.col("value").alias("often"))
        plain = F.col("value") if not training else F.regexp_replace("value", r"\|[0-9]+$", "")
        common: dict[str, dict[str, list]] = {c: {} for c in self.columns}
        for r in table.withColumn("often", plain).join(often, ["column", "often"]).collect():
            common[r["column"]][r["value"]] = [r["encoding"]]
        out = df.withColumn("__fold", F.concat(F.lit("|"), self._fold())) if training else df.withColumn("__fold", F.lit(""))
        # one row for each column
        sizes = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}
        inside: dict[str, Column] = {}
        for c in self.columns:
            text = F.concat(category_text(df, c), "__fold")
            if len(common[c]) == sizes.get(c, 0):
                inside[c + suffix] = F.coalesce(_known(text, common[c]), F.lit(self.mean))
                continue
            part = table.where(F.col("column") == c).select("value", F.col("encoding").alias(c + suffix))
            out = find_values(out.withColumns(inside) if inside else out, text, part, [c + suffix], common[c], False)
            out = out.withColumn(c + suffix, F.coalesce(c + suffix, F.lit(self.mean)))
            inside = {}
        return (out.withColumns(inside) if inside else out).drop("__fold")


# --- class weights -------------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("n"), F.count("*").alias("k")).first()
    weight = F.lit(float(total["n"] or 0)) / (F.lit(total["k"] or 1) * F.col("rows"))
    return counts.withColumn("weight", weight)


def positive_weight(df: DataFrame, label: str) -> float:
    """Weight of the positive class when the negative one weighs 1: rows / (2 * positives)."""
    row = df.agg(F.count(label).alias("n"), F.sum(label).alias("p")).first()
    return row["n"] / (2.0 * row["p"])
