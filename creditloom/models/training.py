"""Stress, amount, term and rate models.

Defaults are the published settings. Boosted models take a validation frame and a patience; of their rounds the prefix
that scores best on the validation frame is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.functions import serving
from creditloom.functions.rules import (
    interaction_features, non_numeric_columns, numeric_columns, prepare_frame,
)
from creditloom.models.boosting import BoostedModel, Boosting, one_task
from creditloom.operators import explain
from creditloom.operators.encoders import TabularPreprocessor, TargetEncoder, class_weights, positive_weight
from creditloom.operators.explain import LinearScorer
from creditloom.runtime import checkpoint_root, local_table, materialize, side_by_side


@dataclass
class Bundle:
    """Preprocessor and fitted model that score a raw frame together."""

    preprocessor: TabularPreprocessor
    model: object
    name: str = ""

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        scored = self.model.transform(self.preprocessor.assemble(df))
        extra = [c for c in ("features", "rawPrediction", "probability") if c in scored.columns]
        if output != "prediction":
            scored = scored.withColumnRenamed("prediction", output)
        return scored.drop(*extra)

    def feature_importance(self) -> DataFrame:
        boosted = isinstance(self.model, BoostedModel)
        weights = (self.model.importances if boosted else self.model.featureImportances.toArray()).tolist()
        total = sum(weights) or 1.0
        rows = [(n, 100.0 * w / total) for n, w in zip(self.preprocessor.feature_names, weights)]
        return _session().createDataFrame(rows, "feature string, importance_pct double").orderBy(
            F.desc("importance_pct"), "feature"
        )

    def linear_scorer(self) -> LinearScorer:
        """A fitted linear model as a column expression over filled numbers and category texts."""
        prep, scaler = self.preprocessor, self.preprocessor.scaler
        weights = dict(zip(prep.feature_names, self.model.coefficients.toArray().tolist()))
        slopes = {c: weights[c] / scaler.stds[c] for c in prep.numeric}
        shift = sum(slopes[c] * scaler.means[c] for c in prep.numeric)
        effects = {c: {v: weights[f"{c}__{v}"] for v in prep.categories.values(c)} for c in prep.categorical}
        return LinearScorer(self.model.intercept - shift, slopes, effects)

    def filled(self, df: DataFrame) -> DataFrame:
        """The frame a :meth:`linear_scorer` reads."""
        other = [c for c in df.columns if c not in self.preprocessor.raw_columns]
        frame = prepare_frame(df, self.preprocessor.numeric, self.preprocessor.categorical, keep=other)
        return frame.withColumns({c: self.preprocessor.scaler.filled(c) for c in self.preprocessor.numeric})

    def attribution(self, df: DataFrame, background: DataFrame, keep: list[str]) -> DataFrame:
        """Additive contributions of a boosted model, one row per (row, feature), against a bounded background sample."""
        prep = self.preprocessor
        sample = prep.assemble(background).select(vector_to_array("features").alias("x"))
        switched = self.model.switched if self.model.loss == "squared" else None  # other losses do not add up
        return explain.array_attribution(
            prep.assemble(df), sample, self.model.binned_scores, prep.feature_names, keep, prepare=self.model.binned, switched=switched
        )

    def coefficients(self) -> DataFrame:
        names = self.preprocessor.feature_names
        rows = list(zip(names, self.model.coefficients.toArray().tolist()))
        return _session().createDataFrame(rows, "feature string, coefficient double")


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def _cached_fit(estimator, df: DataFrame):
    """Fit on a cached copy: every iteration scans the data, and lost blocks are recomputed.

    Logistic regression caches its own blocks of rows; a second copy of the vectors would only push them out of memory,
    so its input is written instead.
    """
    checkpoint_root(df.sparkSession)  # long tree lineages are cut in the shared folder
    if isinstance(estimator, LogisticRegression):
        return estimator.fit(materialize(df, "fit"))
    df = df.persist()
    try:
        return estimator.fit(df)
    finally:
        df.unpersist()


def _with_validation(train: DataFrame, valid: DataFrame | None) -> tuple[DataFrame, str | None]:
    if valid is None:
        return train, None
    tagged = train.withColumn("is_valid", F.lit(False)).unionByName(valid.withColumn("is_valid", F.lit(True)))
    return tagged, "is_valid"


# --- stress model -----------------------------------------------------------------------------------


def stress_frame(df: DataFrame, label: str = "stress_flag") -> tuple[DataFrame, list[str], list[str]]:
    """Features and label of the stress model, without period columns, plus the column groups."""
    out = df.drop(*S.TIME_COLUMNS).where(F.col(label).isNotNull())
    numeric = [c for c in numeric_columns(out) if c != label]
    return out, numeric, non_numeric_columns(out)


def _fit_stress_preprocessor(train: DataFrame, mode: str) -> TabularPreprocessor:
    _, numeric, categorical = stress_frame(train)
    return TabularPreprocessor(mode, numeric, categorical, min_category_count=1).fit(train)


def train_stress_logistic(train: DataFrame, label: str = "stress_flag", max_iter: int = 1000, c: float = 1.0) -> Bundle:
    """L2-regularised logistic regression with balanced class weights on scaled and one-hot columns."""
    frame, _, _ = stress_frame(train, label)
    prep = _fit_stress_preprocessor(frame, "linear")
    weights = class_weights(frame, label).select(label, "weight").collect()  # one row per class
    weighted = frame.join(
        local_table(frame.sparkSession, [(r[0], r[1]) for r in weights], f"{label} int, class_weight double"), label
    )
    total = frame.count()  # balanced weights add up to the number of rows
    model = LogisticRegression(
        labelCol=label, weightCol="class_weight", maxIter=max_iter,
        regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False,
    )
    return Bundle(prep, _cached_fit(model, prep.assemble(weighted).select("features", label, "class_weight")), "logistic")


def train_stress_boosting(
    train: DataFrame, valid: DataFrame | None, label: str = "stress_flag",
    rounds: int = 500, depth: int = 10, learning_rate: float = 0.05, patience: int | None = 30,
) -> Bundle:
    """Boosted trees with a weighted positive class; the prefix with the best validation AUC is kept."""
    frame, _, _ = stress_frame(train, label)
    prep = _fit_stress_preprocessor(frame, "tree")
    weight = F.when(F.col(label) == 1, F.lit(positive_weight(frame, label))).otherwise(F.lit(1.0))
    both, flag = _with_validation(frame, None if valid is None else stress_frame(valid, label)[0])
    model = Boosting("logistic", rounds, depth, learning_rate, l2=3.0, patience=patience, metric="auc")
    return Bundle(prep, model.fit(prep.assemble(both), label=label, weight=weight, validation=flag), "boosting")


def stress_scores(bundle: Bundle, df: DataFrame, label: str = "stress_flag", keep: list[str] = ()) -> DataFrame:
    """Label, predicted class and probability of stress."""
    scored = bundle.model.transform(bundle.preprocessor.assemble(df))
    chances = F.col("probability") if isinstance(bundle.model, BoostedModel) else vector_to_array("probability")
    return scored.select(
        *keep, F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), chances[1].alias("score"),
    )


# --- lending models ------------------------------------------------------------------------------------


def ridge(df: DataFrame, alpha: float, label: str = "target", features: str = "features", solver: str = "normal"):
    """Ridge with an unpenalised intercept: minimises squared error + alpha * |w|^2.

    ``solver`` "normal" is the closed form, for up to 4,096 features; "l-bfgs" iterates and takes any number.
    """
    row = df.agg(F.count("*").alias("n"), F.stddev_pop(label).alias("sd")).first()
    # MLlib divides the loss by n and works on a target scaled by its standard deviation
    return LinearRegression(
        labelCol=label, featuresCol=features, solver=solver, elasticNetParam=0.0,
        regParam=alpha * (row["sd"] or 1.0) / row["n"], standardization=False,
    ).fit(df)


def train_linear_regressor(train: DataFrame, alpha: float = 10.0) -> Bundle:
    prep = TabularPreprocessor("linear").fit(train)
    ready = prep.assemble(train).select("features", "target").persist()
    try:
        return Bundle(prep, ridge(ready, alpha), "fast_linear")
    finally:
        ready.unpersist()


#: Rounds and patience of the two published regressors; the learning rate is 0.05, the depth 6.
PUBLISHED_ROUNDS = {"loan_amount": 1500, "interest_rate": 1200}
PUBLISHED_PATIENCE = 50


def train_tree_regressor(
    train: DataFrame, valid: DataFrame | None = None, rounds: int = 180, depth: int = 6, learning_rate: float = 0.08,
    patience: int | None = None, l2: float = 0.1,
) -> Bundle:
    """Boosted regression; with ``valid`` the best prefix of rounds is kept."""
    prep = TabularPreprocessor("tree").fit(train)
    both, flag = _with_validation(train, valid)
    model = Boosting("squared", rounds, depth, learning_rate, l2=l2, patience=patience)
    return Bundle(prep, model.fit(prep.assemble(both), label="target", validation=flag), "smart_tree")


def train_published_regressor(train: DataFrame, valid: DataFrame, objective: str) -> Bundle:
    return train_tree_regressor(train, valid, PUBLISHED_ROUNDS[objective], 6, 0.05, PUBLISHED_PATIENCE, l2=3.0)


def train_term_linear(train: DataFrame, max_iter: int = 1000) -> Bundle:
    """Multinomial logistic classifier of the loan term with balanced class weights."""
    labelled = train.withColumn("target", F.col("target").cast("int"))
    prep = TabularPreprocessor("linear").fit(labelled)
    weights = class_weights(labelled, "target").select("target", "weight").collect()  # one row per term
    weighted = labelled.join(
        local_table(train.sparkSession, [(r[0], r[1]) for r in weights], "target int, class_weight double"), "target"
    )
    # labels are months, far from 0..k-1, so they are indexed by sorted position
    terms = sorted(r[0] for r in weights)
    return TermBundle(
        prep,
        _cached_fit(
            LogisticRegression(labelCol="label", weightCol="class_weight", family="multinomial", maxIter=max_iter, tol=1e-3, regParam=1e-4, elasticNetParam=0.0),
            _term_frame(prep, weighted, terms).select("features", "label", "class_weight"),
        ),
        "fast_linear", terms,
    )


def train_term_boosting(
    train: DataFrame, valid: DataFrame | None = None, rounds: int = 500, depth: int = 6, learning_rate: float = 0.08,
    patience: int | None = None, l2: float = 3.0,
) -> Bundle:
    """Multiclass boosting of the loan term: one tree for each class and round on softmax gradients.

    Validation rows of a term that training does not know cannot be measured and are left out of the measure.
    """
    labelled = train.withColumn("target", F.col("target").cast("int")).where("target is not null")
    prep = TabularPreprocessor("tree").fit(labelled)
    terms = sorted(r[0] for r in labelled.groupBy("target").count().collect())  # one row per term
    both, flag = _with_validation(labelled, None if valid is None else valid.withColumn("target", F.col("target").cast("int")))
    model = Boosting("softmax", rounds, depth, learning_rate, l2=l2, classes=len(terms), patience=patience)
    ready = _term_frame(prep, both, terms).where("label >= 0")
    return TermBundle(prep, model.fit(ready, validation=flag), "smart_tree", terms)


def train_term_forest(train: DataFrame, trees: int = 160, depth: int = 10) -> Bundle:
    """Tree-ensemble classifier of the loan term (classes are the distinct targets)."""
    labelled = train.withColumn("target", F.col("target").cast("int"))
    prep = TabularPreprocessor("tree").fit(labelled)
    terms = sorted(r[0] for r in labelled.groupBy("target").count().where("target is not null").collect())
    model = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=42, cacheNodeIds=True, checkpointInterval=10)
    ready = _term_frame(prep, labelled, terms).select("features", "label")
    return TermBundle(prep, _cached_fit(model, ready), "smart_tree", terms)


def _term_frame(prep: TabularPreprocessor, df: DataFrame, terms: list[int]) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("target").cast("int")) - 1
    # the number of classes travels with the label; otherwise it would be guessed, up to a hundred
    nominal = {"ml_attr": {"type": "nominal", "name": "label", "vals": [str(t) for t in terms]}}
    return prep.assemble(df).withColumn("label", position.cast("double").alias("label", metadata=nominal))


@dataclass
class TermBundle(Bundle):
    """Classifier whose classes are listed term values."""

    terms: tuple = ()

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        scored = super().predict(df, "__class")
        values = F.array(*[F.lit(t) for t in self.terms])
        return scored.withColumn(output, F.get(values, F.col("__class").cast("int"))).drop("__class")


def term_class_target(df: DataFrame) -> DataFrame:
    """Replace the term in months by its class."""
    return df.withColumn("target", serving.term_class(F.col("target").cast("int")))


# --- proof of the optimum ------------------------------------------------------------------------------


def _gradient(bundle: Bundle, ready: DataFrame, penalty: float) -> DataFrame:
    """feature, gradient: sums of value x ``__slope`` over all rows, plus ``penalty`` x coefficient, by row count.

    ``ready`` has the raw columns and each row's derivative of the loss in ``__slope``. Zero at the optimum.
    """
    entries = bundle.preprocessor.transform_long(ready, ["__slope"])
    sums = entries.groupBy("feature").agg(F.sum(F.col("value") * F.col("__slope")).alias("s"))
    n = ready.count()
    return bundle.coefficients().join(sums, "feature", "left").select(
        "feature", ((F.coalesce("s", F.lit(0.0)) + F.lit(penalty) * F.col("coefficient")) / F.lit(float(n))).alias("gradient")
    )


def ridge_gradient(bundle: Bundle, train: DataFrame, alpha: float = 10.0) -> DataFrame:
    """What the normal equations of a fitted ridge leave over, per feature and row."""
    residual = bundle.predict(train, "__fit").withColumn("__slope", F.col("__fit") - F.col("target"))
    return _gradient(bundle, materialize(residual, "residuals"), alpha)


def logistic_gradient(bundle: Bundle, train: DataFrame, label: str = "stress_flag", c: float = 1.0) -> DataFrame:
    """The gradient of the balanced, penalised log loss of a fitted stress model, per feature and row."""
    frame, _, _ = stress_frame(train, label)
    weights = {r[label]: r["weight"] for r in class_weights(frame, label).collect()}  # one row per class
    scored = bundle.model.transform(bundle.preprocessor.assemble(frame))
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])[F.col(label)]
    slope = weight * (vector_to_array("probability")[1] - F.col(label))
    return _gradient(bundle, materialize(scored.select(*frame.columns, slope.alias("__slope")), "slopes"), 1.0 / c)


# --- stacking ------------------------------------------------------------------------------------------

ENGINEERED_NUMERIC = [*S.LENDING_NUMERIC, "dti_ltv_interaction", "credit_risk_multiplier"]
ENCODED = [f"{c}_encoded" for c in S.LENDING_CATEGORICAL]


def stacking_frame(df: DataFrame, unknown_msa: bool = False) -> DataFrame:
    """Null-as-zero numbers, text categories and interactions; other columns are kept."""
    other = [c for c in df.columns if c not in S.LENDING_FEATURES]
    frame = prepare_frame(df, keep=other).fillna(0.0, S.LENDING_NUMERIC)
    if unknown_msa:
        frame = frame.replace("0", S.MISSING_CATEGORY, subset=["msa"])
    return interaction_features(frame)


@dataclass
class StackedBundle:
    """Two boosted models blended by a ridge that was fitted on validation predictions.

    The first reads ordinal category codes, the second target encodings; both live in one row.
    """

    codes: TabularPreprocessor
    encoder: TargetEncoder
    first: object
    second: object
    blender: object = None

    def features(self, df: DataFrame, training: bool = False, unknown_msa: bool = False) -> DataFrame:
        frame = self.encoder.transform(stacking_frame(df, unknown_msa), training)
        frame = self.codes.assemble(frame, "features_a")
        return VectorAssembler(inputCols=[*ENGINEERED_NUMERIC, *ENCODED], outputCol="features_b").transform(frame)

    def base_predictions(self, df: DataFrame, unknown_msa: bool = False) -> DataFrame:
        ready = self.features(df, unknown_msa=unknown_msa)
        both = self.second.transform(self.first.transform(ready, "features_a", "pred_a"), "features_b", "pred_b")
        return VectorAssembler(inputCols=["pred_a", "pred_b"], outputCol="meta").transform(both)

    def predict(self, df: DataFrame, output: str = "prediction", unknown_msa: bool = False) -> DataFrame:
        scored = self.blender.transform(self.base_predictions(df, unknown_msa))
        return scored.withColumnRenamed("prediction", output).drop("features_a", "features_b", "meta", *ENCODED)


def train_stacked(
    train: DataFrame, valid: DataFrame, key: list[str], rounds: int = 1000, depth: int = 6,
    learning_rate: float = 0.05, alpha: float = 1.0, patience: tuple[int | None, int | None] = (40, None),
) -> StackedBundle:
    """Stacked amount model; ``key`` identifies rows for the encoder's cross-fitting folds.

    ``patience`` holds for the first and the second base model; without one a model has all its rounds.
    """
    frame = stacking_frame(train)
    codes = TabularPreprocessor("tree", numeric=ENGINEERED_NUMERIC).fit(frame)
    encoder = TargetEncoder(S.LENDING_CATEGORICAL, "target", key).fit(frame)
    bundle = StackedBundle(codes, encoder, None, None)
    both, flag = _with_validation(
        bundle.features(train, training=True).select("features_a", "features_b", "target"),
        bundle.features(valid).select("features_a", "features_b", "target"),
    )
    # both base models read the encoded rows
    both = materialize(both, "stacking")
    def base(side: str, wait: int | None, l2: float) -> BoostedModel:
        model = Boosting("squared", rounds, depth, learning_rate, l2=l2, patience=wait)
        return model.fit(both, f"features_{side}", "target", validation=flag) if wait else model.fit(both.where(~F.col(flag)), f"features_{side}", "target")

    jobs = [lambda: base("a", patience[0], 3.0), lambda: base("b", patience[1], 1.0)]
    bundle.first, bundle.second = side_by_side(train.sparkSession, jobs, one_task(both))
    bundle.blender = ridge(bundle.base_predictions(valid).select("meta", "target"), alpha, features="meta")
    return bundle


# --- batch scoring -------------------------------------------------------------------------------------


def score_applications(
    features: DataFrame, keep: list[str], amount: Bundle, term: Bundle, rate: Bundle, term_is_class: bool = False
) -> DataFrame:
    """Recommended amount, term and rate of each application row, in one pass over the batch."""
    scored = rate.predict(term.predict(amount.predict(features, "amount_log"), "term_raw"), "rate_raw")
    return recommendation(scored, keep, term_is_class)


@dataclass
class ModelSet:
    """The three models that one choice stands for."""

    amount: Bundle | StackedBundle
    term: Bundle
    rate: Bundle


def score_by_choice(features: DataFrame, keep: list[str], sets: dict[str, ModelSet], choice: str = "model_selection") -> DataFrame:
    """Every application is scored by the models it names; without a choice by the first of ``S.MODEL_CHOICES``.

    The batch is read once for each choice, each time only the rows of that choice. An unknown choice is an error.
    """
    picked = features.withColumn(choice, F.coalesce(choice, F.lit(S.MODEL_CHOICES[0])))
    unknown = picked.where(~F.col(choice).isin(list(sets))).select(choice).first()
    if unknown:
        raise ValueError(f"no models for the choice {unknown[0]!r}")

    def part(name: str, models: ModelSet) -> DataFrame:
        mine = picked.where(F.col(choice) == name)
        return score_applications(mine, [*keep, choice], models.amount, models.term, models.rate, name in S.CLASS_TERM_MODELS)

    # long plans and small lookups, that leave the cores idle
    parts = side_by_side(features.sparkSession, [lambda item=item: part(*item) for item in sets.items()])
    return reduce(DataFrame.unionByName, parts)


def recommendation(scored: DataFrame, keep: list[str], term_is_class: bool = False) -> DataFrame:
    months = serving.clean_term(F.col("term_raw"), F.lit(term_is_class))
    return scored.select(
        *keep,
        serving.clean_amount(F.col("amount_log")).alias("estimated_loan_amount"),
        months.alias("estimated_loan_term_months"),
        serving.term_years(months).alias("estimated_loan_term_years"),
        serving.clean_rate(F.col("rate_raw")).alias("estimated_interest_rate"),
    )
