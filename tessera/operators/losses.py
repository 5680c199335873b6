"""Training losses over the batches of a plan, as aggregates: each batch's targets hold ``k`` actives and ``k`` inactives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def batch_losses(plan: DataFrame, y: str, logit: str, k: int, weight: str | None = None) -> DataFrame:
    """``(batch, bce, ranknet, listwise)``: means over the targets of a batch.

    ``plan`` has ``batch`` and ``slot`` as made by balance.batch_plan, and the logit of each slot. Per target the cross-entropy is
    weighted by ``weight`` where one is named; the pairwise loss is the mean over its actives and inactives; the
    listwise one spreads the mass over its actives. A target that fills up a short last batch counts as often as it is there.
    Groups are of 2k slots, whatever the size of a target.
    """
    x, lab = F.col(logit).cast("double"), F.col(y).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    bce = F.sum(w * (softplus(x) - x * lab)) / F.greatest(F.sum(w), F.lit(1e-8))
    cells = plan.withColumn("_place", F.floor(F.col("slot") / (2 * k)))
    per = cells.groupBy("batch", "_place").agg(bce.alias("bce"), F.collect_list(F.when(lab > 0.5, x)).alias("_p"), F.collect_list(F.when(lab <= 0.5, x)).alias("_n"))
    pairs = F.flatten(F.transform("_p", lambda p: F.transform("_n", lambda n: softplus(n - p))))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    every = F.concat("_p", "_n")
    top = F.array_max(every)
    mass = top + F.log(F.aggregate(F.transform(every, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))
    each = per.select("batch", "bce", mean(pairs).alias("ranknet"), (mass - mean(F.col("_p"))).alias("listwise"))
    return each.groupBy("batch").agg(*[F.avg(c).alias(c) for c in ("bce", "ranknet", "listwise")])


def masked_bce(df: DataFrame, y: str, logit: str, mask: Column, by: list[str]) -> DataFrame:
    """Mean cross-entropy of the cells that count, 0 where none does."""
    x, lab = F.col(logit).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(mask, softplus(x) - x * lab)), F.lit(0.0)).alias("loss"))


def masked_cross_entropy(df: DataFrame, logits: str, y_bin: str, head: str, weight: Column) -> DataFrame:
    """``(loss)``: cross-entropy over bins, weighted by row and averaged within each head, then over the heads with rows."""
    top = F.array_max(logits)
    mass = top + F.log(F.aggregate(F.transform(logits, lambda v: F.exp(v - F.array_max(logits))), F.lit(0.0), lambda s, v: s + v))
    each = df.withColumn("_l", mass - F.get(F.col(logits), F.col(y_bin))).withColumn("_w", weight)
    per = each.groupBy(head).agg((F.sum(F.col("_l") * F.col("_w")) / F.sum("_w")).alias("l"), F.sum("_w").alias("w")).where("w > 0")
    return per.agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("loss"))
