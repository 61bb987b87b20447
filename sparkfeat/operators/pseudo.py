"""Pseudo-labelling (PSL-1..3) over scored unlabelled rows.

Selection is a filter plus, when a cap applies, an exact top-N on
(confidence desc, id) — an ordered limit for moderate caps, a bucketed
cut-off search for large ones — so the cap never gathers all candidates in
one place. Rounds of the iterative form
cut lineage with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.ordered import top_n
from sparkfeat.operators.clean import confidence
from sparkfeat.session import cut_lineage


def one_sided(scored: DataFrame, n_train: int, threshold: float = 0.85, max_ratio: float = 0.3,
              weight_factor: float = 0.8, id_col: str = "id", p_col: str = "p") -> DataFrame:
    """PSL-1: confidence ≥ t, at most int(n_train·ratio) most confident rows."""
    cap = int(n_train * max_ratio)
    cand = scored.select(id_col, p_col, confidence(p_col).alias("confidence")).filter(
        F.col("confidence") >= threshold)
    chosen = top_n(cand, "confidence", id_col, cap, descending=True)
    return chosen.select(id_col, (F.col(p_col) > 0.5).cast("int").alias("label"), "confidence",
                         (F.col("confidence") * weight_factor).alias("weight"))


def two_sided(scored: DataFrame, threshold: float = 0.85, id_col: str = "id",
              p_col: str = "p") -> DataFrame:
    """PSL-3: p ≥ t or p ≤ 1 − t; class at 0.5; weight = confidence."""
    keep = (F.col(p_col) >= threshold) | (F.col(p_col) <= 1 - threshold)
    return scored.filter(keep).select(
        id_col, (F.col(p_col) >= 0.5).cast("int").alias("label"),
        confidence(p_col).alias("weight"), F.lit(True).alias("is_pseudo"))


def augment(train: DataFrame, pseudo: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """Originals weight 1, flag False; append pseudo rows by name."""
    base = train.select(id_col, label).withColumns({"weight": F.lit(1.0), "is_pseudo": F.lit(False)})
    return base.unionByName(pseudo.select(id_col, label, "weight", "is_pseudo"))


def iterative(train: DataFrame, pool: DataFrame, score_fn, rounds: int = 2, threshold: float = 0.9,
              step: float = 0.05, floor: float = 0.75, ratio: float = 0.1, weight: float = 0.7,
              id_col: str = "id") -> DataFrame:
    """PSL-2: lower the threshold each round, add ≤ ratio·current rows, stop
    when nothing qualifies; chosen ids leave the pool (T11).

    ``score_fn(current_train, pool) -> DataFrame(id, p)`` refits and scores.
    """
    current = train.select(id_col, "label").withColumns({"weight": F.lit(1.0), "is_pseudo": F.lit(False)})
    remaining = pool
    n_current = current.count()
    for r in range(rounds):
        t = max(threshold - r * step, floor)
        scored = score_fn(current, remaining)
        chosen = one_sided(scored, n_current, t, ratio, 1.0, id_col)
        chosen = cut_lineage(chosen)
        k = chosen.count()
        if k == 0:
            break
        add = chosen.select(id_col, "label", F.lit(weight).alias("weight"), F.lit(True).alias("is_pseudo"))
        current = cut_lineage(current.unionByName(add))
        remaining = remaining.join(chosen.select(id_col), id_col, "left_anti")
        n_current += k
    return current
