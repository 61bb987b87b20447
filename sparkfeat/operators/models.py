"""Models, cross-fitting and model-based evaluation on Spark ML
(MOD-1..7, ENS-2..5, EVL-5/6, CLU-1..3).

Training is distributed by Spark ML; the driver only loops over folds and
models (small, fixed counts) and keeps fitted model objects. Out-of-fold
and test predictions are long tables (id, model, fold, p) built with
``unionByName``, so voting and evaluation reuse ``operators.ensemble``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.hashing import uniform
from sparkfeat.functions.lookup import load_fitted, save_fitted
from sparkfeat.operators.ensemble import pivot_scores
from sparkfeat.session import fitted_rows, written


# ------------------------------------------------------------------ MOD-1..6
class PenalisedLogistic(Estimator):
    """Logistic regression with the penalty 1 / (C·Σw); Σw (rows, if unweighted) is taken from each fit's own rows."""

    def __init__(self, C: float = 1.0, weight: str | None = None, **params):
        super().__init__()
        self.C, self.weight, self.params_ = C, weight, params

    def _fit(self, df: DataFrame):
        total = df.agg(F.sum(F.col(self.weight).cast("double")) if self.weight else F.count("*")).first()[0]
        m = LogisticRegression(regParam=1.0 / (self.C * float(total or 1.0)), standardization=False, **self.params_)
        return (m.setWeightCol(self.weight) if self.weight else m).fit(df)


def replicate_by_weight(df: DataFrame, weight: str, id_col: str, copies: float = 1.0, seed: int = 42) -> DataFrame:
    """Rows repeated by weight × ``copies``: the whole part, and one more with the probability
    of the rest (a hash of the id, so a row's number is the same after any retry). The expected
    number of copies is exact; null, zero and negative weights give none."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) * F.lit(float(copies))
    times = (F.floor(w) + (uniform(id_col, seed, "replicas") < w - F.floor(w)).cast("int")).cast("int")
    return df.withColumn("__times", times).filter("__times > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times", "__copy")


class WeightedNetwork(Estimator):
    """A classifier without a weight column, fitted on rows replicated by their weight.

    ``copies`` rows stand for weight 1: more of them, finer weights.
    """

    def __init__(self, classifier, weight: str, id_col: str, copies: float = 4.0, seed: int = 42):
        super().__init__()
        self.classifier, self.weight, self.id_col, self.copies, self.seed = classifier, weight, id_col, copies, seed

    def _fit(self, df: DataFrame):
        return self.classifier.fit(replicate_by_weight(df, self.weight, self.id_col, self.copies, self.seed))


def make_model(kind: str, features: str = "features", label: str = "label", weight: str | None = None, **kw):
    """Spark ML classifier presets mirroring the reference's model families.

    Boosting: ``max_iter`` rounds (100), ``depth``, ``step``, ``subsample`` (rows a round),
    ``colsample`` (columns a split), ``validation_col`` (early stopping). ``boost_a``,
    ``boost_b`` and ``boost_c`` are its three set-ups: plain, row and column sampling,
    deeper with smaller steps. Forest: ``trees`` (100), ``depth``, ``min_leaf``.
    Logistic: ``C``, ``l1``, ``max_iter``. Network: ``layers``, ``max_iter``; with ``weight``
    its rows are replicated by weight (``id_col``, ``copies``).
    """
    common = {"featuresCol": features, "labelCol": label}
    setups = {"boost_a": {}, "boost_b": {"subsample": 0.8, "colsample": "0.8", "step": 0.1},
              "boost_c": {"subsample": 0.8, "depth": 6, "step": 0.05}}
    if kind in setups:
        kind, kw = "gbt", setups[kind] | kw
    if kind == "gbt":
        extra = ({"validationIndicatorCol": kw["validation_col"], "validationTol": 0.0}
                 if kw.get("validation_col") else {})
        m = GBTClassifier(maxIter=kw.get("max_iter", 100), maxDepth=kw.get("depth", 4),
                          stepSize=kw.get("step", 0.2), subsamplingRate=kw.get("subsample", 1.0),
                          featureSubsetStrategy=kw.get("colsample", "all"), seed=42, **extra, **common)
    elif kind == "rf":
        m = RandomForestClassifier(numTrees=kw.get("trees", 100), maxDepth=kw.get("depth", 6),
                                   minInstancesPerNode=kw.get("min_leaf", 16), seed=42, **common)
    elif kind == "lr":
        return PenalisedLogistic(kw.get("C", 1.0), weight, elasticNetParam=kw.get("l1", 0.0),
                                 maxIter=kw.get("max_iter", 100), **common)
    elif kind == "mlp":
        m = MultilayerPerceptronClassifier(layers=kw["layers"], maxIter=kw.get("max_iter", 200), seed=42,
                                           **common)
        if weight:      # it has no weight column
            return WeightedNetwork(m, weight, kw.get("id_col", "id"), kw.get("copies", 4.0))
    elif kind == "hgb":  # histogram boosting ≈ GBT with coarse bins
        m = GBTClassifier(maxIter=kw.get("max_iter", 100), maxDepth=kw.get("depth", 5), maxBins=32,
                          minInstancesPerNode=kw.get("min_leaf", 12), stepSize=0.1, seed=42, **common)
    else:
        raise ValueError(kind)
    return m.setWeightCol(weight) if weight else m


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def p_one(col: str = "probability"):
    """P(class 1) from a probability vector."""
    return vector_to_array(col)[1]


# ------------------------------------------------------------------ MOD-7
class EncodedClassifier(Estimator):
    """Target encoder and model fitted as one unit.

    The model learns from cross-fitted values (``cv`` hash folds: no row's value depends
    on its own label); rows to predict get the values fitted on all training rows.
    """

    def __init__(self, cat_cols, num_cols, classifier, label: str, id_col: str, cv: int = 5, seed: int = 42):
        super().__init__()
        self.cat_cols, self.num_cols, self.classifier = list(cat_cols), list(num_cols), classifier
        self.label, self.id_col, self.cv, self.seed = label, id_col, cv, seed

    def _fit(self, df: DataFrame) -> "EncodedClassifierModel":
        from sparkfeat.operators.encode import empirical_bayes, fit_empirical_bayes
        from sparkfeat.operators.folds import hash_fold
        folded = hash_fold(df, self.id_col, self.cv, self.seed, "__ef")
        train = empirical_bayes(folded, self.cat_cols, self.label, self.id_col, "__ef", "te")
        cols = self.num_cols + [f"{c}_te" for c in self.cat_cols]
        encoder = fit_empirical_bayes(df, self.cat_cols, self.label, "te")
        rows = fitted_rows(assemble(train, cols), len(cols))        # the encoding's joins run once, not in every pass
        return EncodedClassifierModel(encoder, self.classifier.fit(rows), cols, self.id_col)


class EncodedClassifierModel(Model):
    def __init__(self, encoder, model, cols, id_col):
        super().__init__()
        self.encoder, self.model, self.cols, self.id_col = encoder, model, cols, id_col

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(assemble(self.encoder.transform(df, self.id_col), self.cols))


def encoded_model(cat_cols, num_cols, kind: str, label: str = "label", id_col: str = "doc_id", **kw) -> EncodedClassifier:
    """MOD-7: encoder + model, refitted as one unit in every fold."""
    return EncodedClassifier(cat_cols, num_cols, make_model(kind, label=label, **kw), label, id_col)


# ------------------------------------------------------------------ ENS-3
PARALLEL = 8      # fits that run at the same time; each is many small Spark jobs


def run_jobs(spark, jobs: dict, parallel: int = PARALLEL) -> tuple[dict, dict]:
    """Run independent driver jobs (key -> callable) side by side: (results, errors) by key.

    A job that fails ends alone; its error is kept and the others finish.
    """
    results, errors = {}, {}
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(jobs)))) as pool:
        waiting = {pool.submit(inheritable_thread_target(spark)(job)): key for key, job in jobs.items()}
        for done in as_completed(waiting):
            try:
                results[waiting[done]] = done.result()
            except Exception as error:  # noqa: BLE001 - any failure of a fit is the model's own
                errors[waiting[done]] = error
    return results, errors


def oof_predictions(train: DataFrame, test: DataFrame | None, estimators: dict, id_col: str,
                    label: str, fold_col: str, k: int, failures: dict | None = None,
                    parallel: int = PARALLEL) -> tuple[DataFrame, DataFrame | None]:
    """Cross-fitted P(class 1): OOF rows (id, model, fold, p, label) and test
    rows averaged over the k fold models (id, model, p).

    Every model × fold is a job of its own, ``parallel`` at a time, that fits and writes its
    predictions, so no later step predicts again. With ``failures``, a model of which a fold
    fails has no predictions and its message is put there; without, the error is raised.
    """
    spark = train.sparkSession

    def job(name, est, f):
        def run():
            model = est.copy().fit(train.filter(F.col(fold_col) != f))
            va = written(model.transform(train.filter(F.col(fold_col) == f)).select(
                id_col, F.lit(name).alias("model"), F.lit(f).alias("fold"), p_one().alias("p"),
                F.col(label).cast("int").alias("label")), "oof")
            te = None if test is None else written(model.transform(test).select(
                id_col, F.lit(name).alias("model"), p_one().alias("p")), "scores")
            return va, te
        return run

    done, errors = run_jobs(spark, {(name, f): job(name, est, f) for name, est in estimators.items() for f in range(k)}, parallel)
    if errors and failures is None:
        raise next(iter(errors.values()))
    for (name, f), error in sorted(errors.items(), key=str):
        failures.setdefault(name, f"fold {f}: {str(error).splitlines()[0]}")
    parts = [v for (name, f), v in sorted(done.items()) if name not in (failures or {})]
    if not parts:
        raise RuntimeError(f"no model could be fitted: {failures}")
    oof = reduce(DataFrame.unionByName, [va for va, _ in parts])
    tst = None
    if test is not None:
        tst = reduce(DataFrame.unionByName, [te for _, te in parts]).groupBy(id_col, "model").agg(F.avg("p").alias("p"))
    return oof, tst


# ------------------------------------------------------------------ ENS-4
def blend(oof: DataFrame, test: DataFrame | None, models, id_col: str, C: float = 0.01):
    """Logistic regression on the OOF probability columns; returns
    (coefficients DataFrame, blended test DataFrame or None)."""
    cols = [f"p_{m}" for m in models]
    wide = pivot_scores(oof, models, id_col)
    meta = make_model("lr", C=C).fit(assemble(wide, cols))
    coefs = oof.sparkSession.createDataFrame(
        [(m, float(c)) for m, c in zip(models, meta.coefficients.toArray())] + [("intercept", float(meta.intercept))],
        "term string, coef double")
    out = None
    if test is not None:
        out = meta.transform(assemble(pivot_scores(test, models, id_col, keep=()), cols)).select(id_col, p_one().alias("p"))
    return coefs, out


# ------------------------------------------------------------------ ENS-2
def weighted_vote(train: DataFrame, test: DataFrame, kinds, feature_cols, id_col: str, label: str,
                  weight: str, params: dict | None = None) -> DataFrame:
    """Each model (kind: its ``params``) fitted with sample weights, then probabilities averaged."""
    tr = assemble(train, feature_cols)
    te = assemble(test, feature_cols)

    def job(kind):
        own = {"id_col": id_col} | (params or {}).get(kind, {})
        return lambda: written(make_model(kind, label=label, weight=weight, **own).fit(tr).transform(te).select(
            id_col, F.lit(kind).alias("model"), p_one().alias("p")), "vote")

    parts, errors = run_jobs(train.sparkSession, {kind: job(kind) for kind in kinds})
    if errors:
        raise next(iter(errors.values()))
    return reduce(DataFrame.unionByName, parts.values()).groupBy(id_col).agg(F.avg("p").alias("p"))


# ------------------------------------------------------------------ EVL-5
def importances(model, feature_cols, spark) -> DataFrame:
    """featureImportances (driver-side vector of length #features)."""
    vals = model.featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(feature_cols, vals)],
                                 "feature string, importance double")


# ------------------------------------------------------------------ EVL-6
def auc_rank_sum(scored: DataFrame, label: str = "label", p: str = "p", by: str | None = None) -> DataFrame:
    """AUC by the Mann-Whitney rank sum (ties averaged), fully distributed:
    scores are counted per distinct value (and group), ranked with
    ``cumulative``; each positive beats the negatives below it and half of
    the tied ones."""
    from sparkfeat.functions.ordered import cumulative
    g = F.col(by).cast("string") if by else F.lit("auc")
    counts = scored.groupBy(g.alias("g"), F.col(p).cast("double").alias("value")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    cum = cumulative(counts, ["g"], "value", ["pos", "neg"])
    out = cum.groupBy("g").agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("prev_neg") + F.col("neg") / 2.0)),
                     F.max("tot_pos") * F.max("tot_neg")).alias("auc"))      # null with one class only
    return out.withColumnRenamed("g", by) if by else out.select("auc")


def adversarial(train: DataFrame, test: DataFrame, feature_cols, id_col: str, k: int = 5, max_iter: int = 100) -> DataFrame:
    """Can a classifier tell the two tables apart? OOF AUC near 0.5 = no drift."""
    from sparkfeat.operators.folds import hash_fold
    both = train.select(id_col, *feature_cols, F.lit(0).alias("is_test_label")).unionByName(
        test.select(id_col, *feature_cols, F.lit(1).alias("is_test_label")))
    both = hash_fold(assemble(both, feature_cols), id_col, k, 7)
    est = make_model("gbt", label="is_test_label", max_iter=max_iter, depth=3)
    oof, _ = oof_predictions(both, None, {"gbt": est}, id_col, "is_test_label", "fold", k)
    return oof


def adversarial_folds(scored: DataFrame, id_col: str, k: int = 5, score: str = "p", out: str = "fold") -> DataFrame:
    """EVL-6 ``make_cv``: k folds by quantile of the train/test classifier's score.

    Rows in rising order of (score, id) are cut into k runs whose sizes differ by one at
    most: fold k - 1 holds the rows most like the test rows. Rows without a score come first.
    """
    from sparkfeat.functions.ordered import row_positions
    placed = row_positions(scored.select(id_col, score), [score, id_col], "__at", "__n")
    return placed.select(id_col, score, F.floor(F.col("__at") * k / F.col("__n")).cast("int").alias(out))


def auc_builtin(oof: DataFrame) -> float:
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName="areaUnderROC")
    return ev.evaluate(oof.withColumn("label", F.col("label").cast("double")))


# ------------------------------------------------------------------ CLU-1..3
@dataclass
class KMeansColumns:
    """CLU-1/2 fitted: the scaling and the centres, in rising order so that ids are stable."""
    scaling: dict       # column: [mean, std]
    centres: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns, the distance to every centre and the nearest one (ties: the first); no action."""
        from sparkfeat.operators.encode import apply_standard
        zs = [f"{c}_z" for c in self.scaling]
        dist = {f"cluster_{i}_distance": F.sqrt(sum(((F.col(z) - F.lit(x)) ** 2 for z, x in zip(zs, centre)), F.lit(0.0)))
                for i, centre in enumerate(self.centres)}
        out = apply_standard(df, self.scaling, "z").withColumns(dist)
        nearest = F.array_position(F.array(*dist), F.least(*dist)) - 1
        return out.withColumn("cluster", nearest.cast("int"))

    def save(self, path: str, spark: SparkSession) -> None:
        save_fitted(path, spark, **vars(self))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "KMeansColumns":
        return cls(**load_fitted(path, spark))


def _scaled(df: DataFrame, cols):
    from sparkfeat.operators.encode import apply_standard, fit_standard
    params = fit_standard(df, cols)
    return params, assemble(apply_standard(df, params, "z"), [f"{c}_z" for c in cols], "zvec")


def fit_kmeans(df: DataFrame, cols, k: int = 5, seed: int = 42) -> KMeansColumns:
    params, vec = _scaled(df, cols)
    model = KMeans(k=k, seed=seed, featuresCol="zvec").fit(vec)
    return KMeansColumns(params, sorted([float(x) for x in c] for c in model.clusterCenters()))


def kmeans_features(df: DataFrame, cols, k: int = 5, seed: int = 42, fit_on: DataFrame | None = None) -> DataFrame:
    """Cluster id and distance to every centre, fitted on ``fit_on`` (the training rows; default: all rows)."""
    return fit_kmeans(df if fit_on is None else fit_on, cols, k, seed).transform(df)


@dataclass
class PcaColumns:
    """CLU-3 fitted: the scaling, the loadings of each component and the explained shares of variance."""
    scaling: dict       # column: [mean, std]
    loadings: list
    explained: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled columns and ``pca_0 ...``; no action."""
        from sparkfeat.operators.encode import apply_standard
        zs = [f"{c}_z" for c in self.scaling]
        return apply_standard(df, self.scaling, "z").withColumns({
            f"pca_{i}": sum((F.col(z) * F.lit(x) for z, x in zip(zs, load)), F.lit(0.0)) for i, load in enumerate(self.loadings)})

    def save(self, path: str, spark: SparkSession) -> None:
        save_fitted(path, spark, **vars(self))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "PcaColumns":
        return cls(**load_fitted(path, spark))


def fit_pca(df: DataFrame, cols, k: int = 3) -> PcaColumns:
    """First k principal components of standardised, centred columns; each component's
    sign makes its largest loading positive."""
    params, vec = _scaled(df, cols)
    model = PCA(k=k, inputCol="zvec", outputCol="pcs").fit(vec)
    loads = model.pc.toArray().T  # (k × #features), small
    signed = [load if load[abs(load).argmax()] >= 0 else -load for load in loads]
    return PcaColumns(params, [[float(x) for x in load] for load in signed],
                      [float(v) for v in model.explainedVariance.toArray()])


def pca_features(df: DataFrame, cols, k: int = 3, fit_on: DataFrame | None = None):
    """(components of ``df``, explained shares), fitted on ``fit_on`` (the training rows; default: all rows)."""
    model = fit_pca(df if fit_on is None else fit_on, cols, k)
    return model.transform(df), model.explained


__all__ = ["make_model", "assemble", "oof_predictions", "blend", "weighted_vote", "importances",
           "adversarial", "auc_rank_sum", "kmeans_features", "pca_features", "encoded_model"]
