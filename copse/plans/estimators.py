"""Estimators: settings in, a fitted model with everything that can be asked of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators import embed, forest, importance, impute, outlier, proximity, similar, votes
from copse.operators.prep import class_weights, dictionary, feature_indices, kinds, oob_counts, synthetic_union
from copse.plans.model import Model, load
from copse.plans.storage import materialised


class Fitted:
    """A fitted forest. All answers are DataFrames; rows are known by ``row_id``."""

    def __init__(self, model: Model, class_weight: Mapping[int, float] | None = None):
        self.model, self.class_weight = model, class_weight
        self.n_trees, self.features, self.kind = model.params.n_trees, model.features, model.kind
        self.nodes, self.bag, self.rows, self.leaves = (model.tables[t] for t in ("nodes", "bag", "rows", "leaves"))
        self.labels = model.tables.get("labels")

    @classmethod
    def load(cls, spark, path: str, class_weight: Mapping[int, float] | None = None):
        return cls(load(spark, path), class_weight)

    def save(self, path: str) -> None:
        self.model.save(path)

    @property
    def p(self) -> int:
        return len(self.features)

    @cached_property
    def n_rows(self) -> int:
        return self.rows.count()

    @cached_property
    def ends(self) -> DataFrame:
        return votes.with_leaf(self.leaves, self.nodes)

    def new_rows(self, df: DataFrame) -> DataFrame:
        return forest.feature_rows(df, self.features, None)

    def apply(self, df: DataFrame) -> DataFrame:
        """``tree_id, row_id, leaf_id`` of new rows."""
        return forest.route(self.new_rows(df), self.nodes)

    # similarity -------------------------------------------------------------------------

    def proximity(self, casewise: bool | None = None) -> DataFrame:
        return proximity.finished_proximity(self.leaves, self.model.params.casewise if casewise is None else casewise)

    def gap_proximity(self) -> DataFrame:
        return proximity.gap_proximity(self.leaves)

    def top_similar(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return similar.top_similar(self.leaves, queries, k)

    def top_similar_new(self, df: DataFrame, k: int = 10) -> DataFrame:
        return similar.top_similar_new(self.apply(df), self.leaves, k, self.n_trees)

    def explain(self, df: DataFrame, k: int = 5, n: int = 3):
        rows = self.new_rows(df)
        return similar.explained_new(forest.route(rows, self.nodes), self.leaves, forest.paths(rows, self.nodes), k, self.n_trees, n)

    def explain_training(self, queries: DataFrame, k: int = 5, n: int = 3) -> tuple[DataFrame, DataFrame]:
        found = importance.proximity_importance(self.rows, self.nodes, self.leaves, self.kind != "regress")
        return similar.top_similar_all_trees(self.leaves, queries, k, self.n_trees), similar.top_features(found, queries, n)

    def prototypes(self, k: int = 5) -> DataFrame:
        return similar.prototypes(self.leaves, k)

    def coordinates(self, k: int = 3) -> DataFrame:
        return embed.leaf_scaling(self.leaves, k, self.model.params.casewise)

    def factors(self, rank: int | None = None) -> DataFrame:
        return embed.leaf_factors(self.leaves, rank or (32 if self.kind == "classify" else 100), self.model.params.casewise)

    def cluster_labels(self, above: float = 0.5) -> DataFrame:
        return proximity.leaf_cluster_labels(self.leaves, above, self.model.params.casewise)

    # importance -------------------------------------------------------------------------

    @property
    def _task(self) -> str:
        return "regress" if self.kind == "regress" else "class"

    def feature_importances(self) -> DataFrame:
        """``feature, importance, sqsd`` for every feature, 0 where no tree uses it."""
        found = importance.permutation_importance(self.rows, self.nodes, self.leaves, importance.oob_donors(self.leaves), self._task)
        names = self.rows.sparkSession.createDataFrame(list(enumerate(self.features)), "feature int, name string")
        return names.join(found, "feature", "left").select("feature", "name", F.coalesce("importance", F.lit(0.0)).alias("importance"), F.coalesce("sqsd", F.lit(0.0)).alias("sqsd"))

    def local_importance(self) -> DataFrame:
        return importance.local_importance(self.rows, self.nodes, self.leaves, importance.oob_donors(self.leaves), self.n_trees, self._task)

    def predicted_importance(self, df: DataFrame, method: str = "path", repeats: int = 5) -> DataFrame:
        rows = self.new_rows(df)
        if method == "path":
            return importance.path_importance(rows, self.nodes, self.n_trees)
        return importance.predicted_permutation(rows, self.nodes, self.p, repeats, "unsupervised" if self.kind == "unsupervised" else self._task)

    def proximity_importance(self) -> DataFrame:
        return importance.proximity_importance(self.rows, self.nodes, self.leaves, self.kind != "regress")

    def overall_proximity_importance(self) -> DataFrame:
        return importance.overall(self.proximity_importance(), self.n_rows)

    def predicted_proximity_importance(self, df: DataFrame, repeats: int = 5) -> DataFrame:
        return importance.predicted_proximity_importance(self.new_rows(df), self.nodes, self.p, repeats)

    # outliers ---------------------------------------------------------------------------

    def outlier_scores(self, mode: str = "full", n_anchors: int = 100, anchors: str = "random") -> DataFrame:
        """``row_id, raw, score, centre, spread``, per class for a classifier."""
        if mode == "full":
            raw = outlier.full_scores(self.leaves, self.n_trees)
        elif mode == "greedy":
            chosen = outlier.random_anchors(self.rows, n_anchors) if anchors == "random" else outlier.diverse_anchors(self.leaves, n_anchors, self.n_trees)
            raw = outlier.anchor_scores(self.leaves, materialised(chosen, "anchors"), self.n_trees)
        elif mode == "mean":
            return outlier.mean_proximity_scores(self.leaves, self.leaves, self.n_trees)
        else:
            raise ValueError(f"unknown mode {mode!r}")
        if self.kind == "classify":
            return outlier.normalised(raw.join(self.rows.select("row_id", F.col("y").alias("class")), "row_id"), "class")
        return outlier.normalised(raw)

    def outliers(self, k: int = 10, **how) -> DataFrame:
        return outlier.top_outliers(self.outlier_scores(**how), k)

    def predicted_outlier_scores(self, df: DataFrame, stats: DataFrame) -> DataFrame:
        """Scores of new rows, normalised by what :meth:`outlier_scores` found, by predicted class for a classifier."""
        ends = self.apply(df)
        raw = outlier.predicted_raw(ends, self.leaves, self.n_trees)
        if self.kind != "classify":
            return outlier.predicted_scores(raw, stats)
        chosen = votes.argmax_class(votes.class_votes(votes.with_leaf(ends, self.nodes), self.model.params.casewise, self.class_weight))
        return outlier.predicted_scores(raw.join(chosen.select("row_id", F.col("prediction").cast("double").alias("class")), "row_id"), stats, "class")

    def oob_counts(self) -> DataFrame:
        return oob_counts(self.rows, self.bag, self.n_trees)


class FittedClassifier(Fitted):
    def _votes(self, ends: DataFrame) -> DataFrame:
        return votes.class_votes(ends, self.model.params.casewise, self.class_weight)

    def _named(self, df: DataFrame, column: str) -> DataFrame:
        return df.join(self.labels.select(F.col("code").cast("int").alias(column), "label"), column, "left")

    def predict(self, df: DataFrame) -> DataFrame:
        """``row_id, label``."""
        return self._named(votes.argmax_class(self._votes(votes.with_leaf(self.apply(df), self.nodes))), "prediction").select("row_id", "label")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``row_id, label, p``."""
        k = [r["code"] for r in self.labels.collect()]  # a row a class
        return self._named(votes.probabilities(self._votes(votes.with_leaf(self.apply(df), self.nodes)), sorted(k)), "class").select("row_id", "label", "p")

    def oob_predictions(self) -> DataFrame:
        found = votes.oob_predictions(self.ends, self.rows, casewise=self.model.params.casewise, class_weight=self.class_weight)
        return self._named(found, "prediction").select("row_id", "y", "prediction", "label")

    def oob_error(self) -> float | None:
        return votes.oob_error(self.ends, self.rows, casewise=self.model.params.casewise, class_weight=self.class_weight).first()["oob_error"]

    def class_prototypes(self, k: int = 3) -> DataFrame:
        return similar.prototypes(self.leaves.join(self.rows.select("row_id", "y"), "row_id"), k, "y")


class FittedRegressor(Fitted):
    def predict(self, df: DataFrame) -> DataFrame:
        return votes.mean_prediction(votes.with_leaf(self.apply(df), self.nodes), self.model.params.casewise)

    def oob_predictions(self) -> DataFrame:
        return self.rows.select("row_id", "y").join(votes.mean_prediction(self.ends.filter("is_oob"), self.model.params.casewise), "row_id", "left")

    def oob_mse(self) -> float | None:
        return votes.oob_mse(self.ends, self.rows, self.model.params.casewise).first()["oob_mse"]


class FittedUnsupervised(Fitted):
    """Rows and leaves are those of the real rows; synthetic ones served growth only."""

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``row_id, p_synthetic, p_real``."""
        p = votes.probabilities(votes.class_votes(votes.with_leaf(self.apply(df), self.nodes)), [0, 1])
        return p.groupBy("row_id").agg(F.max(F.when(F.col("class") == 0, F.col("p"))).alias("p_synthetic"), F.max(F.when(F.col("class") == 1, F.col("p"))).alias("p_real"))

    def predict(self, df: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """The cluster (or given ``row_id, label``) of the most similar training row."""
        known = self.cluster_labels() if labels is None else labels
        return votes.most_similar_label(similar.top_similar_new(self.apply(df), self.leaves, 1, self.n_trees), known)


class _Estimator:
    task, kind, fitted = "class", "classify", FittedClassifier

    def __init__(self, features: Sequence[str], categorical: Sequence[str | int] | None = None, **params):
        self.features, self.categorical = list(features), categorical
        self.params = forest.GrowParams(task=self.task, **params)

    def _with_kinds(self, df: DataFrame) -> forest.GrowParams:
        if self.categorical is not None:
            found = feature_indices(self.categorical, self.features)
        else:
            named = {r["feature"] for r in kinds(df, self.features, self.params.max_categories).filter("categorical").collect()}
            found = [i for i, c in enumerate(self.features) if c in named]
        return replace(self.params, categorical=tuple(sorted(found)))

    def _fit(self, df: DataFrame, rows: DataFrame, params: forest.GrowParams, classes: int, weights: DataFrame | None, real: DataFrame | None = None, **tables) -> Model:
        rows = materialised(rows, "rows")
        params = params.resolved(rows.count(), len(self.features))
        bag = materialised(forest.make_bag(rows, params, weights), "bag")
        nodes = materialised(forest.grow(rows, bag, params, len(self.features), classes), "nodes")
        if real is not None:
            rows = materialised(real, "rows")
            bag = bag.join(rows.select("row_id"), "row_id", "left_semi")
        ends = materialised(forest.leaves(rows, nodes, bag), "leaves")
        return Model(params, self.features, self.kind, {"nodes": nodes, "bag": bag, "rows": rows, "leaves": ends} | tables)


class ForestClassifier(_Estimator):
    """``class_weight``: None, 'balanced' or {label: weight}."""

    def __init__(self, features: Sequence[str], label: str, categorical=None, class_weight=None, **params):
        super().__init__(features, categorical, **params)
        self.label, self.class_weight = label, class_weight

    def fit(self, df: DataFrame, weights: DataFrame | None = None) -> FittedClassifier:
        """``df`` has row_id (dense from 0), features and label; rows without a label do not train."""
        labels = materialised(dictionary(df, self.label), "labels")
        known = labels.collect()  # a row a class
        coded = df.join(labels.select(F.col("label").alias("__l"), F.col("code").alias("__y")), F.col(self.label) == F.col("__l"), "left")
        model = self._fit(df, forest.feature_rows(coded, self.features, "__y"), self._with_kinds(df), len(known), weights, labels=labels)
        by_code = None
        if self.class_weight == "balanced":
            found = class_weights(model.tables["rows"].filter("y is not null"), "y").collect()
            by_code = {int(r["label"]): r["weight"] for r in found}
        elif self.class_weight:
            unknown = set(self.class_weight) - {r["label"] for r in known}
            if unknown:
                raise ValueError(f"weights for labels that do not occur: {sorted(map(str, unknown))}")
            by_code = {r["code"]: float(self.class_weight.get(r["label"], 1.0)) for r in known}
        return FittedClassifier(model, by_code)


class ForestRegressor(_Estimator):
    task, kind = "regress", "regress"

    def __init__(self, features: Sequence[str], target: str, categorical=None, **params):
        super().__init__(features, categorical, **params)
        self.target = target

    def fit(self, df: DataFrame, weights: DataFrame | None = None) -> FittedRegressor:
        return FittedRegressor(self._fit(df, forest.feature_rows(df, self.features, self.target), self._with_kinds(df), 1, weights))


class ForestUnsupervised(_Estimator):
    kind = "unsupervised"

    def __init__(self, features: Sequence[str], categorical=None, ratio: float = 1.0, **params):
        super().__init__(features, categorical, **params)
        self.ratio = ratio

    def fit(self, df: DataFrame, weights: DataFrame | None = None) -> FittedUnsupervised:
        if weights is not None:
            raise ValueError("an unsupervised forest takes no weights")
        both = synthetic_union(df, self.features, self.ratio, self.params.seed)
        real = forest.feature_rows(df.withColumn("__y", F.lit(1)), self.features, "__y")
        return FittedUnsupervised(self._fit(df, forest.feature_rows(both, self.features, "is_real"), self._with_kinds(df), 2, None, real))


class Imputer:
    """Fills learnt on one table and applied to others. Text columns are coded by their sorted labels; unknown ones are missing."""

    def __init__(self, features: Sequence[str], categorical: Sequence[str] | None = None, method: str = "rough", n_trees: int = 100, seed: int | str = 42, params: Mapping | None = None):
        self.features, self.categorical, self.method = list(features), list(categorical or []), method
        self.n_trees, self.seed, self.params = n_trees, seed, dict(params or {})
        self.dictionaries: dict[str, DataFrame] = {}

    def _coded(self, df: DataFrame, learn: bool) -> DataFrame:
        from copse.operators.prep import encode

        types = dict(df.dtypes)
        out = df
        for c in self.features:
            if learn and types[c] in ("string", "boolean"):
                self.dictionaries[c] = materialised(dictionary(df.withColumn(c, F.col(c).cast("string")), c), "labels")
            if c in self.dictionaries:
                out = encode(out.withColumn(c, F.col(c).cast("string")), c, self.dictionaries[c], "__code").withColumn(c, F.col("__code").cast("double")).drop("__code")
            else:
                out = out.withColumn(c, F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
        return out

    def fit(self, df: DataFrame) -> Imputer:
        coded = materialised(self._coded(df, True), "coded")
        self.cats = impute.observed_kinds(coded, self.features, [*self.categorical, *self.dictionaries])
        self.fills = impute.rough_fills(coded, self.features, self.cats)
        filled = materialised(impute.rough_impute(coded, self.features, self.cats) if self.method == "rough" else impute.random_impute(coded, self.features, self.seed), "filled")
        self.models = {}
        for c in self.features:
            seen = filled.join(coded.filter(F.col(c).isNotNull()).select("row_id"), "row_id", "left_semi")
            others = [f for f in self.features if f != c]
            is_class = c in self.cats
            if not others or seen.limit(impute.LEAST_ROWS).count() < impute.LEAST_ROWS or is_class and seen.select(c).distinct().limit(2).count() < 2:
                continue
            p = forest.GrowParams(**({"task": "class" if is_class else "regress", "n_trees": self.n_trees, "seed": f"{self.seed}:{c}", "categorical": tuple(i for i, f in enumerate(others) if f in self.cats)} | self.params))
            self.models[c] = impute._fit_one(seen, others, c, is_class, p)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Coded columns with their gaps filled, in one pass; :meth:`decode` gives the labels back."""
        coded = materialised(self._coded(df, False), "coded")
        filled = coded.select(*[F.coalesce(c, F.lit(self.fills[c])).alias(c) if c in self.features else F.col(c) for c in coded.columns])
        out = coded
        for c in self.features:
            if c not in self.models:
                out = out.withColumn(c, F.coalesce(c, F.lit(self.fills[c])))
                continue
            gaps = coded.filter(F.col(c).isNull()).select("row_id")
            nodes, labels = self.models[c]
            guess = impute._predict_one(forest.feature_rows(filled.join(gaps, "row_id", "left_semi"), [f for f in self.features if f != c], None), nodes, labels, c in self.cats)
            out = out.join(guess, "row_id", "left").withColumn(c, F.coalesce(c, "prediction", F.lit(self.fills[c]))).drop("prediction")
        return out.select(*df.columns)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def decode(self, df: DataFrame) -> DataFrame:
        from copse.operators.prep import decode

        out = df
        for c, labels in self.dictionaries.items():
            out = decode(out, c, labels, "__label").withColumn(c, F.col("__label")).drop("__label")
        return out.select(*df.columns)
