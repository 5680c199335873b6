"""Rows balanced per target by weights, by leaving out or by repeating; all draws are hash ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import sampled_rank


def half_even(c: Column) -> Column:
    return F.rint(c).cast("bigint")


def goal_share(df: DataFrame, y: str, ratio: str | float) -> tuple[str, float]:
    """Name and share of actives that a ratio stands for: ``equal`` is a half, ``dataset`` the share among the rows, a number is
    itself. The share must lie between 0 and 1, both excluded."""
    key = ratio.strip().lower() if isinstance(ratio, str) else ratio
    if key == "equal":
        return "equal", 0.5
    if key == "dataset":
        got = df.agg(F.avg((F.col(y) > 0.5).cast("int"))).first()[0]
        if got is None or not 0 < got < 1:
            raise ValueError(f"share of actives among the rows must be between 0 and 1, not {got}")
        return "dataset", got
    try:
        share = float(key)
    except ValueError:
        raise ValueError(f"unknown ratio {ratio!r}") from None
    if not 0 < share < 1:
        raise ValueError(f"share must be between 0 and 1, not {share}")
    return "custom", share


def class_counts(df: DataFrame, target: str, y: str) -> DataFrame:
    return df.groupBy(target).agg(F.sum(F.col(y).cast("bigint")).alias("n_pos"), F.sum((1 - F.col(y)).cast("bigint")).alias("n_neg"))


def goal_counts(counts: DataFrame, pi: float, upsample: bool) -> DataFrame:
    """Counts per class that give the active share ``pi``: ``keep_pos, keep_neg``; one-class targets are dropped.

    Leaving out never drops below one row; repeating never drops a row. The order of operations fixes the
    rounding of halves.
    """
    p, n = F.col("n_pos"), F.col("n_neg")
    local = p / (p + n)
    pos, neg = half_even(n * pi / (1.0 - pi)), half_even(p * (1.0 - pi) / pi)
    same = F.abs(local - pi) < 1e-12
    if upsample:
        keep_pos = F.when(same | (local > pi), p).otherwise(F.greatest(p, pos))
        keep_neg = F.when(same | (local <= pi), n).otherwise(F.greatest(n, neg))
    else:
        keep_pos = F.when(same | (local <= pi), p).otherwise(F.greatest(F.lit(1), F.least(p, pos)))
        keep_neg = F.when(same | (local > pi), n).otherwise(F.greatest(F.lit(1), F.least(n, neg)))
    return counts.where("n_pos > 0 and n_neg > 0").withColumns({"keep_pos": keep_pos, "keep_neg": keep_neg})


def class_weights(df: DataFrame, target: str, y: str, row: str, pi: float) -> DataFrame:
    """``(row, target, y, weight)``: negatives weigh 1, positives so that they hold the share ``pi``."""
    c = class_counts(df, target, y).where("n_pos > 0 and n_neg > 0")
    odds = pi / (1.0 - pi)
    return df.join(c, target).select(row, target, y, F.when(F.col(y) == 1, F.lit(odds) * F.col("n_neg") / F.col("n_pos")).otherwise(1.0).alias("weight"))


def resample(df: DataFrame, target: str, y: str, row: str, pi: float, upsample: bool = False, seed: int = 42) -> DataFrame:
    """``(row, target, y, copy)``: rows kept, or repeated, to reach the share ``pi`` in each two-class target."""
    goals = goal_counts(class_counts(df, target, y), pi, upsample)
    ranked = sampled_rank(df.select(row, target, y), [target, y], row, "_rank", seed)
    j = ranked.join(goals, target)
    keep, have = F.when(F.col(y) == 1, F.col("keep_pos")).otherwise(F.col("keep_neg")), F.when(F.col(y) == 1, F.col("n_pos")).otherwise(F.col("n_neg"))
    # Row r of n stands for the places r, r + n, r + 2 n ... up to the goal.
    copies = F.greatest(F.floor((keep - F.col("_rank")) / have) + 1, F.lit(0))
    return j.withColumn("_copies", copies).where("_copies > 0").select(row, target, y, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))


def balance_summary(df: DataFrame, target: str, y: str, pi: float, upsample: bool = False) -> DataFrame:
    c = class_counts(df, target, y)
    goals = goal_counts(c, pi, upsample)
    after = goals.agg(F.sum(F.col("keep_pos") + F.col("keep_neg"))).scalar()
    return c.agg(
        F.count("*").alias("n_targets_total"),
        F.count_if((F.col("n_pos") > 0) & (F.col("n_neg") > 0)).alias("n_targets_kept"),
        F.count_if(F.col("n_neg") == 0).alias("n_targets_all_active"),
        F.count_if(F.col("n_pos") == 0).alias("n_targets_all_inactive"),
        F.sum(F.col("n_pos") + F.col("n_neg")).alias("n_rows_before"),
    ).withColumn("n_rows_after", F.coalesce(after, F.lit(0)))


def size_weights(df: DataFrame, target: str, row: str, alpha: float, weight: str | None = None) -> DataFrame:
    """``(row, target, weight)``: the target's number of rows to the power ``-alpha``, times the weights already there."""
    if alpha < 0:
        raise ValueError("alpha must be at least 0")
    c = df.groupBy(target).agg(F.count("*").alias("_n"))
    return df.join(c, target).select(row, target, (F.pow(F.col("_n").cast("double"), F.lit(-float(alpha))) * (F.col(weight) if weight else F.lit(1.0))).alias("weight"))


def cap_rows(df: DataFrame, target: str, row: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows per target, chosen by hash."""
    return sampled_rank(df, [target], row, "_rank", seed).where(F.col("_rank") <= most).drop("_rank")


def thin_prevalent(df: DataFrame, target: str, y: str, row: str, above: float, keep: float, seed: int = 42) -> DataFrame:
    """Targets with a share of actives above ``above`` keep the share ``keep`` of their rows, both classes."""
    c = class_counts(df, target, y)
    n, prev = F.col("n_pos") + F.col("n_neg"), F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    total = F.least(F.greatest(F.lit(2), half_even(n * keep)), n)
    pos = F.least(F.greatest(F.lit(1), half_even(total * prev)), F.col("n_pos"))
    neg = F.least(total - pos, F.col("n_neg"))
    pos = F.when(pos + neg < total, F.least(F.col("n_pos"), total - neg)).otherwise(pos)
    thin = (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (prev > above)
    goals = c.select(target, F.when(thin, pos).otherwise(F.col("n_pos")).alias("_kp"), F.when(thin, neg).otherwise(F.col("n_neg")).alias("_kn"))
    ranked = sampled_rank(df, [target, y], row, "_rank", seed).join(goals, target)
    return ranked.where(F.col("_rank") <= F.when(F.col(y) == 1, F.col("_kp")).otherwise(F.col("_kn"))).drop("_rank", "_kp", "_kn")


def negative_mask(long: DataFrame, label: str, y: str, row: str, share: float, seed: int = 42) -> DataFrame:
    """Cells ``(row, label, y)`` that count: all positives, and negatives until positives have about ``share``.

    A label at or above the share keeps every negative; one without positives keeps none.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    c = class_counts(long, label, y)
    p, n = F.col("n_pos"), F.col("n_neg")
    some = F.greatest(F.lit(0), F.least(n, half_even(p * ((1.0 - share) / share))))
    keep = F.when((p == 0) | F.lit(share >= 1.0), 0).when(p / (p + n) >= share, n).otherwise(some)
    ranked = sampled_rank(long.select(row, label, y), [label, y], row, "_rank", seed).join(c.select(label, keep.alias("_keep")), label)
    return ranked.where((F.col(y) == 1) | (F.col("_rank") <= F.col("_keep"))).select(row, label, y)


def batch_plan(df: DataFrame, target: str, y: str, row: str, targets: int, k: int, seed: int = 42) -> DataFrame:
    """``(batch, slot, target, y, row)``: batches of ``targets`` two-class targets with ``k`` rows of each class.

    Targets come in hash order; a short last batch is filled with the first targets again. A class with
    fewer than ``k`` rows repeats them. Slots run target by target, positives first.
    """
    from tessera.operators.prefix import running_sum, text_slot

    c = class_counts(df, target, y).where("n_pos > 0 and n_neg > 0")
    h = F.md5(F.concat_ws("|", F.lit("t"), F.col(target).cast("string"), F.lit(str(seed))))
    order = running_sum(c.withColumns({"_all": F.lit(0), "_md5": h}), ["_all"], {"_at": F.lit(1)}, text_slot(F.col("_md5")), ["_md5", target]).select(target, "n_pos", "n_neg", "_at")
    n = c.agg(F.count("*")).scalar()
    padded = order.withColumn("_total", n).withColumn("_pad", F.pmod(-F.col("_total"), F.lit(targets)))
    again = F.filter(F.transform(F.sequence(F.lit(0), F.lit(targets)), lambda i: F.col("_at") + i * F.col("_total")), lambda a: a < F.col("_total") + F.col("_pad"))
    place = padded.select(target, "n_pos", "n_neg", F.explode(again).alias("_place"))
    ranked = sampled_rank(df.select(row, target, y), [target, y], row, "_rank", seed).where(F.col("_rank") <= k)
    j = ranked.join(place, target)
    have = F.when(F.col(y) == 1, F.col("n_pos")).otherwise(F.col("n_neg"))
    places = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(i, have) == F.col("_rank") - 1)
    cells = j.select("_place", target, y, row, F.explode(places).alias("_i"))
    slot = F.pmod(F.col("_place"), F.lit(targets)) * 2 * k + F.when(F.col(y) == 1, 0).otherwise(k) + F.col("_i")
    return cells.select(F.floor(F.col("_place") / targets).cast("int").alias("batch"), slot.cast("int").alias("slot"), target, y, row)


def row_shards(df: DataFrame, row: str, size: int, shards: int) -> DataFrame:
    """``(shard, row)``: runs of ``size`` rows in the order of their ids, each starting where the last ended, wrapping around.

    Rows are numbered without gaps by running sums, and each row's shards follow from its number, so only rows that are in
    a shard are made.
    """
    from tessera.operators.prepare import dense_ids

    placed = dense_ids(df, row, row, "_at")
    n = placed.agg(F.count("*")).scalar()
    turns = F.expr(f"CASE WHEN _at < {size * shards} THEN sequence(_at, CAST({size * shards - 1} AS BIGINT), _rows) ELSE array() END")
    each = placed.withColumn("_rows", n).withColumn("_t", F.explode(turns))
    return each.select(F.floor(F.col("_t") / size).cast("int").alias("shard"), row)


def epoch_order(df: DataFrame, row: str, size: int, epoch: int, seed: int = 42) -> DataFrame:
    """``(batch, place, row)``: every row once, in the hash order of the epoch, cut into batches of ``size``."""
    from tessera.operators.prefix import running_sum, text_slot

    h = F.md5(F.concat_ws("|", F.col(row).cast("string"), F.lit(str(seed)), F.lit(str(epoch))))
    at = running_sum(df.select(row).withColumns({"_all": F.lit(0), "_md5": h}), ["_all"], {"_at": F.lit(1).cast("bigint")}, text_slot(F.col("_md5")), ["_md5", row])
    return at.select(F.floor(F.col("_at") / size).alias("batch"), (F.col("_at") % size).cast("int").alias("place"), row)
