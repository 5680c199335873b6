"""Ranking and threshold metrics with exact ties, per group and pooled, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import running_sum, unit_slot

NAMES = ["auroc", "auprc", "accuracy", "precision", "recall", "f1"]


def binary_metrics(df: DataFrame, group: list[str], y: str, score: str, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """One row per group: ``n, n_pos, n_neg`` and the metrics of 0/1 labels ``y`` and scores from 0 to 1.

    Rows are counted by group and score first, so ties are exact and a group of any size is as large as its
    distinct scores, which are then summed along in slots. A group with one class has AUROC 0.5 and its
    share of positives as AUPRC. A ratio over nothing is 0. Rows with a null label or score are left out. ``weight`` is a
    column of whole numbers of rows that each row stands for.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    counts = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*group, F.col(score).alias("_s")).agg(F.sum((F.col(y) > 0.5).cast("bigint") * w).alias("_p"), F.sum((F.col(y) <= 0.5).cast("bigint") * w).alias("_n"))
    low = running_sum(counts, group, {"_pb": F.col("_p"), "_nb": F.col("_n")}, unit_slot(F.col("_s")), ["_s"])
    hit = F.col("_s") >= threshold
    totals = counts.groupBy(*group).agg(
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("_tp"), F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("_fp")
    )
    keys = [F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]
    t = totals.select(*keys, "n_pos", "n_neg", "_tp", "_fp")
    j = low.join(t, [low[g].eqNullSafe(t[f"_k{i}"]) for i, g in enumerate(group)])
    tp, fp = F.col("n_pos") - F.col("_pb"), F.col("n_neg") - F.col("_nb")
    area = F.sum(F.col("_p") * (F.col("_nb") + F.col("_n") / 2))
    steps = F.sum(F.when(F.col("_p") > 0, F.col("_p") * tp / (tp + fp)).otherwise(0.0))
    g = j.groupBy(*group).agg(*[F.first(c).alias(c) for c in ("n_pos", "n_neg", "_tp", "_fp")], area.alias("_a"), steps.alias("_ap"))
    two = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    n = F.col("n_pos") + F.col("n_neg")
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = zero(F.col("_tp"), F.col("_tp") + F.col("_fp")), zero(F.col("_tp"), F.col("n_pos"))
    return g.select(
        *group,
        n.alias("n"),
        "n_pos",
        "n_neg",
        F.when(two, F.col("_a") / (F.col("n_pos") * F.col("n_neg"))).otherwise(0.5).alias("auroc"),
        F.when(two, F.col("_ap") / F.col("n_pos")).otherwise(F.col("n_pos") / n).alias("auprc"),
        ((F.col("_tp") + F.col("n_neg") - F.col("_fp")) / n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        zero(2 * precision * recall, precision + recall).alias("f1"),
    )


def pooled(df: DataFrame, y: str, score: str) -> DataFrame:
    return binary_metrics(df.withColumn("_all", F.lit(0)), ["_all"], y, score).drop("_all")


def macro(per_group: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over groups with both classes, and how many groups there are, count and are skipped.

    Without any such group AUROC is 0.5 and the rest 0.
    """
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    aggs = [F.coalesce(F.avg(F.when(ok, F.col(m))), F.lit(0.5 if m == "auroc" else 0.0)).alias(f"macro_{m}") for m in NAMES]
    return per_group.groupBy(*(by or [])).agg(F.count("*").alias("n_targets"), F.count_if(ok).alias("n_evaluable"), F.count_if(~ok).alias("n_skipped"), *aggs)


def novelty_cube(df: DataFrame, y: str, score: str, flags: tuple[str, str]) -> DataFrame:
    """The metrics overall, by each flag, and by both: nine rows, metrics null where a bucket has one class."""
    a, b = flags
    # Counted by flags, label and score first, so what is multiplied by four is counts, not rows.
    few = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(a, b, (F.col(y) > 0.5).cast("int").alias(y), score).agg(F.count("*").alias("_w"))
    each = F.array(*[F.struct(x.alias("a"), z.alias("b")) for x in (F.col(a), F.lit(None).cast("boolean")) for z in (F.col(b), F.lit(None).cast("boolean"))])
    long = few.select(F.col(y), F.col(score), "_w", F.explode(each).alias("_c")).select(y, score, "_w", F.col("_c.a").alias(a), F.col("_c.b").alias(b))
    got = binary_metrics(long, [a, b], y, score, weight="_w")
    three = "(VALUES (true), (false), (CAST(NULL AS boolean)))"
    frame = df.sparkSession.sql(f"SELECT x, z FROM {three} t(x) JOIN {three} u(z) ON true")
    out = frame.join(got, frame["x"].eqNullSafe(got[a]) & frame["z"].eqNullSafe(got[b]), "left")
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(F.col("x").alias(a), F.col("z").alias(b), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_pos", "n_neg")], *[F.when(ok, F.col(m)).alias(m) for m in NAMES])


def confusion(df: DataFrame, head: str, true: str, guess: str, bins: int) -> DataFrame:
    """``(head, true, guess, n)`` with every cell of every head that has rows."""
    seen = df.groupBy(head, true, guess).agg(F.count("*").alias("n"))
    cells = seen.select(head).distinct().withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    s = seen.select(F.col(head).alias("_h"), F.col(true).alias("_x"), F.col(guess).alias("_y"), "n")
    on = (cells[head] == s["_h"]) & (cells["_t"] == s["_x"]) & (cells["_g"] == s["_y"])
    return cells.join(s, on, "left").select(head, F.col("_t").alias(true), F.col("_g").alias(guess), F.coalesce("n", F.lit(0)).alias("n"))


def head_metrics(cells: DataFrame, head: str, true: str, guess: str, bins: int) -> DataFrame:
    """Accuracy, macro F1 over all bins (an absent bin counts 0) and mean distance of bins, per head."""
    hit = F.col(true) == F.col(guess)
    base = cells.groupBy(head).agg(F.sum("n").alias("n"), (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), (F.sum(F.col("n") * F.abs(F.col(true) - F.col(guess))) / F.sum("n")).alias("ordinal_mae"))
    both = cells.select(head, F.explode(F.array(F.struct(F.col(true).alias("b"), F.lit(True).alias("t")), F.struct(F.col(guess).alias("b"), F.lit(False).alias("t")))).alias("_e"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), "n")
    per = both.groupBy(head, F.col("_e.b").alias("_b")).agg(F.sum(F.when(F.col("_e.t"), F.col("tp")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    f1 = per.groupBy(F.col(head).alias("_h")).agg((F.sum(F.coalesce(F.try_divide(2 * F.col("tp"), F.col("both")), F.lit(0.0))) / bins).alias("macro_f1"))
    return base.join(f1, base[head] == f1["_h"]).select(head, "n", "accuracy", "macro_f1", "ordinal_mae")


def head_mean(per_head: DataFrame, metric: str = "macro_f1", out: str = "mean_head_f1") -> DataFrame:
    """One row: the mean of a metric over the heads where it is finite, null without any."""
    ok = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf"))
    return per_head.agg(F.avg(F.when(ok, F.col(metric))).alias(out), F.count_if(ok).alias("n_heads"))


def every_head(per_head: DataFrame, head: str, heads: int) -> DataFrame:
    """The metrics with a row for every head, NaN where a head has no rows."""
    frame = per_head.sparkSession.range(heads).select(F.col("id").cast(per_head.schema[head].dataType).alias("_h"))
    j = frame.join(per_head, frame["_h"] == per_head[head], "left")
    cells = [F.coalesce(c, F.lit(0)).alias(c) if c == "n" else F.coalesce(c, F.lit(float("nan"))).alias(c) for c in per_head.columns if c != head]
    return j.select(F.col("_h").alias(head), *cells)


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def rank_losses(df: DataFrame, group: str, y: str, logit: str) -> DataFrame:
    """Per group: mean binary cross-entropy, pairwise logistic loss of positives over negatives, listwise loss.

    An evaluation of whole groups: rows with equal label and logit are counted, not paired one by one, but a group's pairs are
    of its distinct logits. Training goes over losses.batch_losses, whose groups are of fixed size.
    """
    x, lab = F.col(logit), F.col(y)
    soft = F.greatest(x, F.lit(0.0)) - x * lab + F.log1p(F.exp(-F.abs(x)))
    base = df.groupBy(group).agg(F.avg(soft).alias("bce"), F.sum(lab).alias("n_pos"), F.sum(1 - lab).alias("n_neg"), F.max(x).alias("_m"))
    d = df.groupBy(group, y, logit).agg(F.count("*").alias("c"))
    pos = d.where(lab == 1).select(F.col(group).alias("_g"), F.col(logit).alias("_xp"), F.col("c").alias("_cp"))
    neg = d.where(lab == 0).select(F.col(group).alias("_gn"), F.col(logit).alias("_xn"), F.col("c").alias("_cn"))
    diff = F.col("_xp") - F.col("_xn")
    pairs = pos.join(neg, pos["_g"] == neg["_gn"]).groupBy("_g").agg((F.sum(F.col("_cp") * F.col("_cn") * (F.greatest(-diff, F.lit(0.0)) + F.log1p(F.exp(-F.abs(diff))))) / F.sum(F.col("_cp") * F.col("_cn"))).alias("ranknet"))
    b = base.select(F.col(group).alias("_b"), "_m")
    lists = d.join(b, d[group] == b["_b"]).groupBy(F.col(group).alias("_l")).agg((F.first("_m") + F.log(F.sum(F.col("c") * F.exp(x - F.col("_m")))) - F.sum(F.when(lab == 1, F.col("c") * x).otherwise(0.0)) / F.sum(F.when(lab == 1, F.col("c")).otherwise(0))).alias("listwise"))
    two = base.where("n_pos > 0 and n_neg > 0")
    return two.join(pairs, two[group] == pairs["_g"]).join(lists, two[group] == lists["_l"]).select(group, "n_pos", "n_neg", "bce", "ranknet", "listwise")
