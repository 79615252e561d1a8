"""What moves a prediction: permutation impact, partial dependence and additive attributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from creditloom import schemas as S
from creditloom.operators.profile import top_per_group
from creditloom.operators.ranking import permute_columns
from creditloom.runtime import local_table, quoted, to_long

# a model as a column expression: feature name -> Column  =>  prediction
Scorer = Callable[[dict[str, Column]], Column]

_TASK_CONTRIBUTIONS = 500_000


@dataclass
class LinearScorer:
    """Intercept, slopes of numeric features and effects of category values."""

    intercept: float
    slopes: dict[str, float] = field(default_factory=dict)
    effects: dict[str, dict[str, float]] = field(default_factory=dict)
    link: Callable[[Column], Column] = staticmethod(lambda c: c)

    @property
    def features(self) -> list[str]:
        return [*self.slopes, *self.effects]

    def term(self, name: str, value: Column) -> Column:
        """What one feature adds to the total."""
        if name in self.slopes:
            return F.lit(self.slopes[name]) * value.cast("double")
        if not self.effects[name]:
            return F.lit(0.0)
        # a map, not nested conditions: there may be thousands of categories
        effects = F.create_map(*[F.lit(x) for pair in self.effects[name].items() for x in pair])
        return F.coalesce(F.element_at(effects, value.cast("string")), F.lit(0.0))

    def total(self, columns: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a + b, [self.term(n, columns[n]) for n in self.features], F.lit(self.intercept))

    def __call__(self, columns: dict[str, Column]) -> Column:
        return self.link(self.total(columns))


def _versions(features: list[str], names: list[str | None]) -> Column:
    """Array of one record per name: the row with that feature permuted (None: the row as it is)."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                *[F.col(f"{c}__permuted" if c == name else c).alias(c) for c in features],
            )
            for name in names
        ]
    )


def permutation_impact(
    df: DataFrame,
    scorers: dict[tuple[str, str], LinearScorer],
    features: list[str],
    key: list[str],
    units: dict[str, str] | None = None,
    seed: int = 2027,
) -> DataFrame:
    """Mean absolute and mean signed change of each (model, target) prediction when one feature is
    permuted. All models and features share one shuffle and one aggregation.

    In a linear model one feature changes one term, so each row's total is computed once.
    """
    mixed = permute_columns(df, features, key, seed)
    plain = {c: F.col(c) for c in features}
    totals = mixed.withColumns({f"__total_{m}": s.total(plain) for m, s in enumerate(scorers.values())})
    changes, aggregates, records = {}, [], []
    unit = units or {}
    for m, ((model, target), scorer) in enumerate(scorers.items()):
        total = F.col(f"__total_{m}")
        for f, feature in enumerate(features):
            name = f"{m}_{f}"
            used = feature in scorer.features
            if used:
                step = scorer.term(feature, F.col(f"{feature}__permuted")) - scorer.term(feature, F.col(feature))
                changes[f"__delta_{name}"] = scorer.link(total + step) - scorer.link(total)
                aggregates += [f"avg(abs(__delta_{name})) AS abs_{name}", f"avg(__delta_{name}) AS signed_{name}"]
            records.append(
                {
                    "model_key": quoted(model), "target": quoted(target), "feature": quoted(feature),
                    "feature_label": quoted(S.FEATURE_LABELS.get(feature, feature)),
                    "mean_absolute_impact": f"abs_{name}" if used else "0D",
                    "mean_signed_impact": f"signed_{name}" if used else "0D",
                    "unit": quoted(unit.get(target, "")),
                }
            )
    return to_long(totals.select(*[c.alias(n) for n, c in changes.items()]).selectExpr(*aggregates), records)


def model_permutation_impact(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    prediction: str,
    features: list[str],
    key: list[str],
    seed: int = 2027,
    encoded: tuple[Callable[[DataFrame], DataFrame], Callable[[np.ndarray], np.ndarray], list[str]] | None = None,
    changes: Callable[[np.ndarray, np.ndarray, list[int]], np.ndarray] | None = None,
) -> DataFrame:
    """Permutation impact of a fitted model: every row is scored once per permuted feature.

    The plain prediction comes first and travels with the row, so nothing has to be brought together afterwards.
    ``encoded`` names a model that scores arrays: how a frame gets its vector ``features``, the scores, and the names of
    the vector's places. A value's code does not depend on its row, so values are encoded once and codes permuted.
    ``changes`` is for models that find the changes of the first score in fewer steps than scoring all versions: of rows,
    the other values of the features, and the places of these.
    """
    if encoded:
        return _encoded_impact(df, *encoded, features, key, seed, changes)
    mixed = predict(permute_columns(df, features, key, seed)).withColumnRenamed(prediction, "__base")
    versions = mixed.select(*key, "__base", F.inline(_versions(features, features)))
    scored = predict(versions.withColumnRenamed("feature", "__feature"))
    delta = F.col(prediction) - F.col("__base")
    return scored.groupBy(F.col("__feature").alias("feature")).agg(
        F.avg(F.abs(delta)).alias("mean_absolute_impact"), F.avg(delta).alias("mean_signed_impact")
    )


def _encoded_impact(
    df: DataFrame, assemble: Callable[[DataFrame], DataFrame], scores: Callable[[np.ndarray], np.ndarray], names: list[str],
    features: list[str], key: list[str], seed: int, changed: Callable[[np.ndarray, np.ndarray, list[int]], np.ndarray] | None,
) -> DataFrame:
    vector = assemble(df).select(*key, vector_to_array("features").alias("__x"))
    codes = vector.select(*key, *[F.get("__x", F.lit(i)).alias(c) for i, c in enumerate(names)])
    mixed = permute_columns(codes, features, key, seed)
    sent = df.sparkSession.sparkContext.broadcast((scores, changed, [names.index(c) for c in features]))

    @F.pandas_udf("array<double>")
    def changes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scores, changed, places = sent.value
        for plain, moved in batches:
            if not len(plain):
                yield pd.Series([], dtype=object)
                continue
            x, other = np.stack(plain.to_numpy()), np.stack(moved.to_numpy())
            if changed:
                yield pd.Series(list(changed(x, other, places)), dtype=object)
                continue
            base, out = scores(x)[:, 0], np.empty(other.shape)
            for i, place in enumerate(places):
                version = x.copy()
                version[:, place] = other[:, i]
                out[:, i] = scores(version)[:, 0] - base
            yield pd.Series(list(out), dtype=object)

    delta = changes(F.array(*[F.col(c) for c in names]), F.array(*[F.col(f"{c}__permuted") for c in features]))
    each = mixed.select(F.posexplode(delta).alias("i", "delta")).groupBy("i").agg(
        F.avg(F.abs("delta")).alias("mean_absolute_impact"), F.avg("delta").alias("mean_signed_impact")
    )
    labels = F.array(*[F.lit(c) for c in features])
    return each.select(F.get(labels, "i").alias("feature"), "mean_absolute_impact", "mean_signed_impact")


def top_impacts(impacts: DataFrame, k: int = 5) -> DataFrame:
    return top_per_group(
        impacts, ["model_key", "target"], [F.desc("mean_absolute_impact"), F.asc("feature")], k
    )


def linear_grid(low: float, high: float, points: int) -> list[float]:
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points)]


def pdp_curve(
    df: DataFrame, predict: Scorer | Callable[[DataFrame], DataFrame], moved: list[str], grid: list[float],
    prediction: str | None = None,
) -> DataFrame:
    """Average prediction with the ``moved`` features set to each grid point in turn.

    ``predict`` is a scorer, or with ``prediction`` named a fitted model's scoring function. The grid
    is a short fixed list; rows are expanded by it and averaged map-side. In a linear model the terms that stay are
    added up once for each row, before it is expanded.
    """
    points = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(float(g)).alias("value")) for i, g in enumerate(grid)])
    if prediction is None and isinstance(predict, LinearScorer):
        stay = [predict.term(n, F.col(n)) for n in predict.features if n not in moved]
        rest = df.select(reduce(lambda a, b: a + b, stay, F.lit(predict.intercept)).alias("__rest"))
        steps = [predict.term(n, F.col("value")) for n in predict.features if n in moved]
        total = reduce(lambda a, b: a + b, steps, F.col("__rest"))
        scored = rest.select("__rest", F.inline(points)).withColumn("__prediction", predict.link(total))
        return scored.groupBy("point", "value").agg(F.avg("__prediction").alias("prediction"))
    expanded = df.drop(*moved).select("*", F.inline(points)).withColumns({c: F.col("value") for c in moved})
    if prediction is None:
        prediction = "__prediction"
        scored = expanded.withColumn(prediction, predict({c: F.col(c) for c in expanded.columns}))
    else:
        scored = predict(expanded)
    return scored.groupBy("point", "value").agg(F.avg(prediction).alias("prediction"))


# --- additive attributions ---------------------------------------------------------------------


def linear_contributions(scorer: LinearScorer, background: DataFrame) -> dict[str, Column]:
    """Contribution of each feature against a background sample: slope * (x - background mean).

    Numeric features give one entry, categories one entry per indicator ``column__value``.
    """

    def active(c: str, value: str) -> Column:
        return F.coalesce((F.col(c) == value).cast("double"), F.lit(0.0))

    terms = {c: (slope, F.col(c).cast("double")) for c, slope in scorer.slopes.items()}
    for c, effects in scorer.effects.items():
        for value, effect in effects.items():
            terms[f"{c}__{value}"] = (effect, active(c, value))
    stats = background.agg(*[F.avg(x).alias(str(i)) for i, (_, x) in enumerate(terms.values())]).first()
    return {
        name: F.lit(weight) * (x - F.lit(stats[i])) for i, (name, (weight, x)) in enumerate(terms.items())
    }


def linear_attribution(
    df: DataFrame, scorer: LinearScorer, background: DataFrame, keep: list[str]
) -> DataFrame:
    """Contributions of a linear model, one row per (row, encoded feature)."""
    parts = [
        F.struct(F.lit(name).alias("feature"), value.alias("contribution"))
        for name, value in linear_contributions(scorer, background).items()
    ]
    return df.select(*keep, F.inline(F.array(*parts)))


def linear_drivers(
    df: DataFrame, scorer: LinearScorer, background: DataFrame, keep: list[str], k: int = 5
) -> DataFrame:
    """Strongest ``k`` base features per row of a linear model, found inside the row: no shuffle."""
    summed: dict[str, Column] = {}
    for name, value in linear_contributions(scorer, background).items():
        base = name.split("__", 1)[0].removesuffix("_encoded")
        summed[base] = summed[base] + value if base in summed else value
    # ascending on (-|score|, feature) puts the strongest first and breaks ties by name
    parts = [
        F.struct((-F.abs(v)).alias("weight"), F.lit(n).alias("feature"), v.alias("score")) for n, v in summed.items()
    ]
    ranked = df.select(*keep, F.posexplode(F.slice(F.array_sort(F.array(*parts)), 1, k)).alias("pos", "d"))
    return _described(ranked.select(*keep, (F.col("pos") + 1).alias("rank"), "d.feature", "d.score"), keep)


def base_feature(name: Column) -> Column:
    """Feature behind an encoded column: the part before ``__``, without an ``_encoded`` ending."""
    return F.when(name.contains("__"), F.split_part(name, F.lit("__"), F.lit(1))).otherwise(
        F.regexp_replace(name, "_encoded$", "")
    )


def attribution_rollup(contributions: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """Strongest ``k`` base features per row, with readable label and direction.

    A row's contributions are brought together once, for the sums and the ranking. Nearly every contribution is a group
    of its own, so the number of tasks follows their count and a task's groups stay few.
    """
    tasks = max(1, -(-contributions.count() // _TASK_CONTRIBUTIONS))
    summed = contributions.repartition(tasks, *key).groupBy(*key, base_feature(F.col("feature")).alias("feature")).agg(
        F.sum("contribution").alias("score")
    )
    ranked = top_per_group(summed, key, [F.abs("score").desc(), F.asc("feature")], k)
    return _described(ranked, key)


def _described(ranked: DataFrame, keep: list[str]) -> DataFrame:
    label = F.initcap(F.regexp_replace("feature", "_", " "))
    for name, text in S.FEATURE_LABELS.items():
        label = F.when(F.col("feature") == name, F.lit(text)).otherwise(label)
    return ranked.select(
        *keep, "rank", "feature", label.alias("label"), F.bround("score", 4).alias("value"),
        F.when(F.col("score") >= 0, "increases estimate").otherwise("decreases estimate").alias("direction"),
    )


def sampled_attribution(
    df: DataFrame,
    background: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    prediction: str,
    features: list[str],
    key: list[str],
    background_rows: int = 100,
) -> DataFrame:
    """Additive attribution of any fitted model by switching features from background to row.

    Each (row, background row) pair walks through the features once forwards and once backwards;
    a feature's contribution is the average change at its own step. The background is a bounded
    sample, so it travels as an array inside the plan.
    """
    rows = background.select(*features).limit(background_rows + 1).collect()
    if len(rows) > background_rows:
        raise ValueError(f"background sample exceeds {background_rows} rows")
    table = local_table(df.sparkSession, [(0, rows)], _background_schema(background, features))
    # one broadcast record that carries the whole bounded sample
    paired = df.select(*key, *features).withColumn("__one", F.lit(0)).join(table, "__one")
    paired = paired.withColumn("__b", F.explode("__background"))
    n = len(features)
    steps = []
    for order, walk in enumerate((features, features[::-1])):
        for taken in range(n + 1):
            from_row = set(walk[:taken])
            steps.append(
                F.struct(
                    F.lit(order).alias("__order"), F.lit(taken).alias("__taken"),
                    *[(F.col(c) if c in from_row else F.col(f"__b.{c}")).alias(c) for c in features],
                )
            )
    expanded = paired.select(*key, F.inline(F.array(*steps)))
    scored = predict(expanded)
    # averages per step are additive: the feature added at a step gets the difference to the step before
    means = scored.groupBy(*key, "__order", "__taken").agg(F.avg(prediction).alias("p"))
    before = F.lag("p").over(Window.partitionBy(*key, "__order").orderBy("__taken"))
    names = F.array(*[F.array(*[F.lit(c) for c in walk]) for walk in (features, features[::-1])])
    return (
        means.withColumn("__delta", F.col("p") - before)
        .where(F.col("__taken") > 0)
        .withColumn("feature", F.get(F.get(names, F.col("__order")), F.col("__taken") - 1))
        .groupBy(*key, "feature").agg(F.avg("__delta").alias("contribution"))
    )


def array_attribution(
    df: DataFrame, background: DataFrame, scores: Callable[[np.ndarray], np.ndarray], names: list[str], keep: list[str],
    features: str = "features", background_rows: int = 100, prepare: Callable[[np.ndarray], np.ndarray] = np.asarray,
    switched: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None,
) -> DataFrame:
    """The attribution of :func:`sampled_attribution` for a model that scores arrays, one row per (row, feature).

    ``df`` has the model vector in ``features``, ``background`` the bounded sample as arrays ``x``. All switched
    versions of a row are scored as one array within its Arrow batch and only the contributions leave it: no shuffle.
    ``prepare`` turns values into what ``scores`` reads, each by itself, so it is applied before the switching.
    ``switched`` is for models that know what their features add without scoring switched versions: of the prepared
    background it makes a function of prepared rows.
    """
    sample = background.limit(background_rows + 1).collect()
    if not 0 < len(sample) <= background_rows:
        raise ValueError(f"the background sample must have 1 to {background_rows} rows")
    z = prepare(np.array([r["x"] for r in sample], float))
    n = z.shape[1]
    # which features come from the row, after 0, 1, 2 ... steps forwards and backwards
    taken = np.tri(n + 1, n, -1, dtype=bool)
    taken = np.stack([taken, taken[:, ::-1]])
    sent = df.sparkSession.sparkContext.broadcast((z, taken, scores, prepare, switched(z) if switched else None))

    @F.pandas_udf("array<double>")
    def contributions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        z, taken, scores, prepare, added = sent.value
        for batch in batches:
            out = []
            if added and len(batch):
                yield pd.Series(list(added(prepare(np.stack(batch.to_numpy())))), dtype=object)
                continue
            for x in prepare(np.stack(batch.to_numpy())) if len(batch) else ():
                versions = np.where(taken[:, :, None, :], x, z)
                p = scores(versions.reshape(-1, z.shape[1]))[:, 0].reshape(versions.shape[:3]).mean(axis=2)
                steps = np.diff(p, axis=1)
                out.append((steps[0] + steps[1, ::-1]) / 2)
            yield pd.Series(out, dtype=object)

    labels = F.array(*[F.lit(c) for c in names])
    made = df.select(*keep, F.posexplode(contributions(vector_to_array(F.col(features)))).alias("__i", "contribution"))
    return made.select(*keep, F.get(labels, "__i").alias("feature"), "contribution")


def _background_schema(background: DataFrame, features: list[str]):
    item = background.select(*features).schema
    return T.StructType().add("__one", T.IntegerType()).add("__background", T.ArrayType(item))


# --- coefficients ------------------------------------------------------------------------------


def top_coefficients(table: DataFrame, k: int = 30, contains: str | None = None) -> DataFrame:
    """Largest coefficients by absolute size, optionally of features whose name contains a text."""
    if contains:
        table = table.where(F.col("feature").contains(contains))
    return (
        table.withColumn("abs_coefficient", F.abs("coefficient"))
        .orderBy(F.desc("abs_coefficient"), "feature").limit(k)
    )
