"""Running sums inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_slot(h: Column) -> Column:
    """One of 1024 slots, in the order of a signed 64-bit hash."""
    return F.shiftright(h, 54)


def text_slot(h: Column) -> Column:
    """One of 4096 slots, in the order of a hash written in hexadecimal digits."""
    return F.substring(h, 1, 3)


def unit_slot(x: Column) -> Column:
    """One of 1025 slots, in the order of a number from 0 to 1; what lies outside joins the end slots."""
    return F.least(F.greatest(F.floor(x * 1024), F.lit(0)), F.lit(1024))


def running_sum(df: DataFrame, group: list[str], values: Mapping[str, Column], slot: Column, order: list[Column | str]) -> DataFrame:
    """Add for each of ``values`` the sum over the rows of the same group that come before this one, exclusive.

    ``slot`` must not fall along ``order``; ties in ``order`` must be broken by it. Totals of the slots are
    summed first; then each slot is summed by itself from its own offset, so a task holds a slot, not a
    group, and only the small table of totals has whole groups in a window. Rows with nulls in the
    group form a group of their own.
    """
    keys = [*group, "_slot"]
    tagged = df.withColumns({"_slot": slot, **{f"_v_{n}": c for n, c in values.items()}})
    totals = tagged.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = tagged.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    on = [summed[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = summed.join(offsets, on).withColumns({n: F.col(f"_o_{n}") + F.col(f"_i_{n}") for n in values})
    return joined.drop("_slot", *[f"_k{i}" for i in range(len(keys))], *[f"_{k}_{n}" for n in values for k in "voi"])


def sampled_rank(df: DataFrame, group: list[str], row: str, out: str, seed: int = 42) -> DataFrame:
    """Add ``out``: the row's place in its group, from 1, in the order of ``md5(row|seed)``."""
    h = F.md5(F.concat_ws("|", F.col(row).cast("string"), F.lit(str(seed))))
    got = running_sum(df.withColumn("_md5", h), group, {out: F.lit(1)}, text_slot(F.col("_md5")), ["_md5", row])
    return got.withColumn(out, F.col(out) + 1).drop("_md5")
