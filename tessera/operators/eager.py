"""Aggregation pushed below joins: both sides shrink to one compact state per key first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm_name(c: Column) -> Column:
    """Lower case, each run of white space one space, ends trimmed; null where nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(c), r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+", " "))
    return F.when(s != "", s)


def key_states(rows: DataFrame, keys: dict[str, Column], sums: dict[str, Column], keyless: bool = False) -> DataFrame:
    """One row per key: ``rows`` and for each of ``sums`` its count, sum, squared distance from the mean, least and most.

    Spark sums within each input split before it shuffles, so a key with any share of the rows arrives as
    one state per split. Rows with a null key fall into no group, or with ``keyless`` into one of their own. NaN and
    infinities count as missing.
    """
    real = {n: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), c.cast("double")) for n, c in sums.items()}
    flat = rows.select(*[c.alias(k) for k, c in keys.items()], *[c.alias(f"_v_{n}") for n, c in real.items()])
    flat = flat if keyless else flat.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    aggs = [F.count("*").alias("rows")]
    for n in sums:
        v = F.col(f"_v_{n}")
        aggs += [F.count(v).alias(f"{n}_count"), F.sum(v).alias(f"{n}_sum"), (F.var_pop(v) * F.count(v)).alias(f"{n}_spread"), F.min(v).alias(f"{n}_min"), F.max(v).alias(f"{n}_max")]
    return flat.groupBy(*keys).agg(*aggs)


def join_states(left: DataFrame, right: DataFrame, on: str, left_sums: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables given as states per key, as states of the joined rows.

    Counts multiply and the left side's sums are multiplied by the right side's count, which is what
    joining row by row and aggregating after would give. With ``how='left'`` a key without partner counts
    as having one empty partner row. Columns of ``right`` but for ``on`` and ``rows`` are carried.
    """
    r = right.withColumnRenamed("rows", "_rows")
    j = left.join(r, on, how)
    times = F.coalesce(F.col("_rows"), F.lit(1)).cast("bigint")
    scaled = {"rows": F.col("rows") * times}
    for n in left_sums:
        scaled |= {f"{n}_count": F.col(f"{n}_count") * times, f"{n}_sum": F.col(f"{n}_sum") * times, f"{n}_spread": F.col(f"{n}_spread") * times}
    return j.withColumns(scaled).drop("_rows")


def roll_up(states: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Merge states to coarser keys and finish them: mean and population deviation beside the sums."""
    aggs = [F.sum("rows").alias("rows")]
    out = {}
    for n in sums:
        count, total = F.sum(f"{n}_count"), F.sum(f"{n}_sum")
        # Squared distances within the states, and of their means from the common one.
        between = F.sum(F.try_divide(F.col(f"{n}_sum") * F.col(f"{n}_sum"), F.col(f"{n}_count"))) - F.try_divide(total * total, count)
        spread = F.sum(f"{n}_spread") + F.when(F.count_if(F.col(f"{n}_count") > 0) > 1, F.greatest(between, F.lit(0.0))).otherwise(0.0)
        aggs += [count.alias(f"{n}_count"), total.alias(f"{n}_sum"), F.min(f"{n}_min").alias(f"{n}_min"), F.max(f"{n}_max").alias(f"{n}_max"), spread.alias(f"_{n}_spread")]
        out |= {f"{n}_mean": F.try_divide(F.col(f"{n}_sum"), F.col(f"{n}_count")), f"{n}_dev": F.sqrt(F.try_divide(F.col(f"_{n}_spread"), F.col(f"{n}_count")))}
    return states.groupBy(*keys).agg(*aggs).withColumns(out).drop(*[f"_{n}_spread" for n in sums])
