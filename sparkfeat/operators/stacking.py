"""Stacking with nested cross-fitting (ENS-5).

A meta model learns from base probabilities that no base model gave to its own training
rows, and is itself scored on rows that neither it nor its inputs were fitted on. One set of
k folds serves both levels: a base fitted without folds i and j gives fold j's inputs when
fold i is held out, and fold i's when fold j is. So each base needs k (k - 1) / 2 fits for
the inner level, k for the outer one and one on all rows, instead of k times an inner
cross-validation. Every fit is a job of its own and writes its predictions.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.operators.ensemble import correct
from sparkfeat.operators.models import PARALLEL, assemble, p_one, run_jobs
from sparkfeat.session import fitted_rows, written

META = ("meta",)      # the winner's job among those of the bases


def _inputs(models) -> list[str]:
    return [f"p_{m}" for m in models]


def base_views(train: DataFrame, bases: dict, id_col: str, label: str, fold_col: str, k: int,
               parallel: int = PARALLEL) -> tuple[DataFrame, dict]:
    """(id, label, fold, held, seen, p_<base>...), k rows per training row, and the bases that failed.

    ``held`` is the outer fold a row's probabilities may be used under: their bases were
    fitted without folds ``held`` and ``fold``. ``seen`` lists the folds they were fitted on.
    A base of which any fit fails is left out, with its message in the second result.
    """
    left_out = [(f,) for f in range(k)] + list(combinations(range(k), 2))

    def job(name, est, out):
        def run():
            model = est.copy().fit(train.filter(~F.col(fold_col).isin(*out)))
            held = F.when(F.col(fold_col) == out[0], F.lit(out[-1])).otherwise(F.lit(out[0]))
            return written(model.transform(train.filter(F.col(fold_col).isin(*out))).select(
                F.col(id_col), F.col(label).cast("int").alias("label"), F.col(fold_col).cast("int").alias("fold"),
                held.cast("int").alias("held"), F.array(*[F.lit(f) for f in range(k) if f not in out]).alias("seen"),
                F.lit(name).alias("model"), p_one().alias("p")), "stack")
        return run

    done, errors = run_jobs(train.sparkSession, {(n, out): job(n, e, out) for n, e in bases.items() for out in left_out}, parallel)
    failed = {name: str(error).splitlines()[0] for (name, _), error in sorted(errors.items(), key=str)}
    kept = [n for n in bases if n not in failed]
    if not kept:
        raise RuntimeError(f"no base model could be fitted: {failed}")
    long = reduce(DataFrame.unionByName, [v for (n, _), v in sorted(done.items()) if n in kept])
    wide = long.groupBy(id_col, "label", "fold", "held", "seen").agg(
        *[F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"p_{m}") for m in kept])
    return written(wide, "views"), failed


class Stacking(Estimator):
    """Base models and candidate meta models to one fitted model.

    ``bases`` and ``metas`` map names to estimators over a vector column ``features`` and the
    label; ``fold_col`` holds k folds. Each meta is fitted k times on the views of the other
    folds and scored on the held one; the best mean accuracy wins (ties: first name), is fitted
    again on the single-fold views of all rows, and all bases are fitted on all rows.
    """

    def __init__(self, bases: dict, metas: dict, id_col: str, label: str = "label", fold_col: str = "fold",
                 k: int = 5, parallel: int = PARALLEL):
        super().__init__()
        self.bases, self.metas, self.id_col, self.label = bases, metas, id_col, label
        self.fold_col, self.k, self.parallel = fold_col, k, parallel

    def _fit(self, train: DataFrame) -> "StackingModel":
        spark, k = train.sparkSession, self.k
        views, failed = base_views(train, self.bases, self.id_col, self.label, self.fold_col, k, self.parallel)
        kept = [n for n in self.bases if n not in failed]
        vec = fitted_rows(assemble(views, _inputs(kept), "features"), len(kept))
        own = F.col("held") == F.col("fold")            # fitted without the row's fold alone

        def outer(name, est, f):
            def run():
                # the other folds' rows as seen by bases that knew neither fold f nor their own
                meta = est.copy().fit(vec.filter((F.col("held") == f) & ~own))
                held = meta.transform(vec.filter((F.col("fold") == f) & own)).select(p_one().alias("p"), "label")
                return held.agg(F.count("*").alias("n"), F.avg(correct(F.col("p"))).alias("acc")).first()
            return run

        scores, errors = run_jobs(spark, {(n, f): outer(n, e, f) for n, e in self.metas.items() for f in range(k)}, self.parallel)
        failed |= {n: str(e).splitlines()[0] for (n, _), e in sorted(errors.items(), key=str)}
        table = [(n, f, int(r["n"]), r["acc"]) for (n, f), r in sorted(scores.items()) if n not in failed and r["n"]]
        means = {n: sum(a for m, _, _, a in table if m == n) / sum(m == n for m, *_ in table) for n, *_ in table}
        if not means:
            raise RuntimeError(f"no meta model could be fitted: {failed}")
        winner = min(means, key=lambda n: (-means[n], n))
        final = {n: (lambda e=self.bases[n]: e.copy().fit(train)) for n in kept}
        final[META] = lambda: self.metas[winner].copy().fit(vec.filter(own))
        models, errors = run_jobs(spark, final, self.parallel)
        if errors:
            raise next(iter(errors.values()))
        meta = models.pop(META)
        return StackingModel({n: models[n] for n in kept}, meta, winner, table, failed, views)


class StackingModel(Model):
    """``transform`` adds ``p``: the winner's probability over all bases' probabilities.

    ``scores``: (meta, outer fold, rows, accuracy); ``winner``; ``failures``: models left out;
    ``views``: the training rows' base probabilities.
    """

    def __init__(self, models: dict, meta, winner: str, scores: list, failures: dict, views: DataFrame):
        super().__init__()
        self.models, self.meta, self.winner = models, meta, winner
        self.scores, self.failures, self.views = scores, failures, views

    def _transform(self, df: DataFrame) -> DataFrame:
        out, made = df, ["rawPrediction", "probability", "prediction"]
        for name, model in self.models.items():
            out = model.transform(out).withColumn(f"p_{name}", p_one()).drop(*made)
        out = self.meta.transform(assemble(out.drop("features"), _inputs(self.models), "features"))
        return out.withColumn("p", p_one()).drop("features", *made)
