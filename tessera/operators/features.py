"""Vectors per entity: cache misses, star join, assembly, column statistics, scoring, top lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.functions import scalars as S


def cache_misses(wanted: DataFrame, cached: DataFrame, entity: str, key: str) -> DataFrame:
    """Distinct entities whose SHA-1 isn't in the cache: ``(key, entity)``."""
    need = wanted.where(F.col(entity).isNotNull()).select(F.sha1(F.col(entity).cast("string").cast("binary")).alias(key), entity).distinct()
    return need.join(cached.select(key), key, "left_anti")


def fill_cache(wanted: DataFrame, cached: DataFrame, entity: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache with what was missing added; ``compute`` maps ``(key, entity)`` to the cache's columns."""
    return cached.unionByName(compute(cache_misses(wanted, cached, entity, key)))


def gather(fact: DataFrame, protein: DataFrame, ligand: DataFrame, p: str, q: str, extras: list[Column] | None = None) -> DataFrame:
    """Fact rows with ``x = [protein | ligand | extras]``; the narrow fact is joined last-minute with both sides.

    ``protein`` and ``ligand`` are ``(entity, vec)``; rows without either vector are dropped.
    """
    a = protein.select(F.col("entity").alias("_p"), F.col("vec").alias("_pv"))
    b = ligand.select(F.col("entity").alias("_q"), F.col("vec").alias("_qv"))
    j = fact.join(a, fact[p] == a["_p"]).join(b, fact[q] == b["_q"])
    parts = [F.col("_pv"), F.col("_qv"), *([F.array(*[e.cast("float") for e in extras])] if extras else [])]
    return j.withColumn("x", F.concat(*parts)).drop("_p", "_pv", "_q", "_qv")


def column_stats(df: DataFrame, vec: str) -> DataFrame:
    """``(dim, n, mean, dev)`` of a vector column, population deviation, summed per split before the shuffle."""
    long = df.select(F.posexplode(vec).alias("dim", "_x")).select("dim", F.col("_x").cast("double").alias("_x"))
    return long.groupBy("dim").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("dev"))


def standardize(df: DataFrame, vec: str, stats: DataFrame, floor: float = 1e-4) -> DataFrame:
    """The vectors centred and scaled; deviations below ``floor`` count as that. The statistics are one row per
    dimension, the vector's own width."""
    s = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "dev")))).scalar()
    scaled = F.transform(F.arrays_zip(F.col(vec).alias("v"), F.col("_s").alias("s")), lambda z: (z["v"] - z["s"]["mean"]) / F.greatest(z["s"]["dev"], F.lit(floor)))
    return df.withColumn("_s", s).withColumn(vec, scaled).drop("_s")


def bin_weights(df: DataFrame, head: str, y_bin: str, bins: int) -> DataFrame:
    """``(head, y_bin, n, weight)``: total over bins times count, an absent bin counted as one row."""
    seen = df.groupBy(F.col(head).alias("_h"), F.col(y_bin).alias("_b")).agg(F.count("*").alias("_n"))
    frame = df.select(head).distinct().withColumn(y_bin, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    j = frame.join(seen, (frame[head] == seen["_h"]) & (frame[y_bin] == seen["_b"]), "left").withColumn("n", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
    total = j.groupBy(F.col(head).alias("_t")).agg(F.sum("n").alias("_all"))
    return j.join(total, j[head] == total["_t"]).select(head, y_bin, "n", (F.col("_all") / (F.lit(bins) * F.col("n"))).alias("weight"))


def linear_score(vec: Column, weights: list[float], bias: float) -> Column:
    """Probability of a linear model, as an expression that stays in the JVM."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return S.sigmoid(F.aggregate(F.zip_with(vec, w, lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda s, x: s + x))


def top_rows(df: DataFrame, score: str, row: str, k: int) -> DataFrame:
    """The ``k`` best rows with their rank from 1; equal scores by row, NaN and null last."""
    s = F.when(~F.isnan(score), F.col(score))
    best = df.orderBy(s.desc_nulls_last(), row).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(s.desc_nulls_last(), row)))


def top_labels(df: DataFrame, key: str, probs: str, k: int) -> DataFrame:
    """``(key, rank, label_idx, p)``: the ``k`` likeliest labels of each row, by position on a tie."""
    ordered = F.slice(F.array_sort(F.transform(F.col(probs), lambda p, i: F.struct((-p).alias("o"), i.alias("i")))), 1, k)
    return df.select(key, F.posexplode(ordered).alias("_r", "_e")).select(key, (F.col("_r") + 1).alias("rank"), F.col("_e.i").alias("label_idx"), (-F.col("_e.o")).alias("p"))


def score_pairs(rows: DataFrame, valid: Column, score: Column) -> DataFrame:
    """Every row kept, its score NaN where its input isn't valid."""
    return rows.withColumn("p_active", F.when(valid, score).otherwise(float("nan")))


def every_pair(ligands: DataFrame, proteins: DataFrame, block: int = 10_000) -> DataFrame:
    """Each ligand with each protein of a stated query set, which is read in blocks of ``block`` proteins."""
    out = None
    rows: list = []

    def pairs(rows: list) -> DataFrame:
        listed = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, proteins.schema)]) for r in rows])
        return ligands.select("*", F.explode(listed).alias("_p")).select(*ligands.columns, "_p.*")

    for r in proteins.toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            out = pairs(rows) if out is None else out.unionByName(pairs(rows))
            rows = []
    if rows or out is None:
        last = pairs(rows) if rows else ligands.crossJoin(proteins.limit(0))
        out = last if out is None else out.unionByName(last)
    return out


def screen(library: DataFrame, query: DataFrame, score: Callable[[DataFrame], DataFrame], row: str, k: int, p: str = "p_active") -> DataFrame:
    """The ``k`` best of a library against each protein of a query set: ``score`` adds ``p`` to pairs; NaN scores come last."""
    return top_rows(score(every_pair(library, query)), p, row, k)


def decode_vectors(df: DataFrame, raw: str, out: str, width: int) -> DataFrame:
    """Little-endian 32-bit vectors out of bytes; bytes of another length than ``width`` numbers are an error."""
    @F.arrow_udf(ArrayType(FloatType()))
    def read(b: pa.Array) -> pa.Array:
        rows = []
        for x in b.to_pylist():
            if x is not None and len(x) != 4 * width:
                raise ValueError(f"{len(x)} bytes are no vector of {width}")
            rows.append(None if x is None else np.frombuffer(x, "<f4"))
        return pa.array(rows, pa.list_(pa.float32()))

    return df.withColumn(out, read(raw))


def put_cache(cached: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with ``new`` put in, which overwrites what it had under the same key."""
    return cached.join(new.select(key), key, "left_anti").unionByName(new)


def best_candidate(scores: DataFrame, candidate: str, score: str, fallback: str, order: str) -> DataFrame:
    """The candidate with the greatest score, first on a tie; one without a score counts with its fallback."""
    s = F.coalesce(F.col(score), F.col(fallback))
    return scores.agg(F.max(F.struct(s.alias("score"), (-F.col(order)).alias("o"), candidate)).alias("_b")).select(F.col(f"_b.{candidate}").alias(candidate), F.col("_b.score").alias("score"))
