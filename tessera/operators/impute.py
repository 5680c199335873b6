"""Missing values filled by label propagation over group and similarity edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.persist import cut

#: Weights of the edges to rows alike in kind and time, alike in kind, and of the same group.
WEIGHTS = (0.5, 0.3, 0.2)
#: Where only the time is shared: to rows alike in kind, and of the same time.
FAR_WEIGHTS = (0.6, 0.4)
#: Propagation ends when no label moves by more than this share of the largest.
TOLERANCE = 1e-11


def valid_between(c: Column, low: float, high: float) -> Column:
    """The number where it lies in the limits, else null; NaN and infinities are never valid."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & d.between(low, high), d)


def spread_labels(total: np.ndarray, observed: np.ndarray, missing: np.ndarray, levels: list[np.ndarray], weights: tuple[float, ...]) -> np.ndarray:
    """Labels of nodes, NaN in a group without any observed value.

    A node stands for equal rows: ``observed`` of them have a value, together ``total``, and ``missing`` have none and
    share a label. ``levels`` number the sets whose rows are joined by edges, finest first and the last the group; sets
    of one level lie within sets of the next, and nodes lie sorted by them. Every round each node takes the mean of its
    neighbours' values and labels, level by level with its weight, observed values staying as they are; then each group
    is moved as one by what its labels lack on the whole, so that rounds don't grow with the share missing. It ends
    when the labels stand still.
    """
    group = levels[-1]
    n = int(group[-1]) + 1 if len(group) else 0
    seen = np.bincount(group, observed, n)
    start = np.bincount(group, total, n) / np.where(seen > 0, seen, 1)
    x = np.where(seen > 0, start, np.nan)[group]
    live = (seen > 0)[group] & (np.bincount(group, missing, n) > 0)[group]
    out = x.copy()
    at = np.flatnonzero(live)
    while len(at):
        t, m, levels_at = total[at], missing[at], [np.unique(k[at], return_inverse=True)[1] for k in levels]
        size = observed[at] + m
        sums = [np.bincount(k, size) for k in levels_at]
        x, g = out[at], levels_at[-1]

        def step(x: np.ndarray) -> np.ndarray:
            mass = t + m * x
            return sum(w * (np.bincount(k, mass) / s)[k] for w, k, s in zip(weights, levels_at, sums))

        gain = sum(w * (np.bincount(k, m) / s)[k] for w, k, s in zip(weights, levels_at, sums)) - 1
        slope = np.bincount(g, m * gain)
        for _ in range(20):
            x = step(x)
            x = x - (np.bincount(g, m * (step(x) - x)) / slope)[g]
        moved = np.abs(step(x) - x)
        out[at] = x
        # Groups that stand still leave; the others go on.
        worst = np.zeros(int(g[-1]) + 1)
        np.maximum.at(worst, g, moved)
        scale = np.zeros_like(worst)
        np.maximum.at(scale, g, np.abs(x))
        at = at[(worst > TOLERANCE * np.maximum(scale, 1.0))[g]]
    return out


def _numbered(columns: list[pa.Array]) -> list[np.ndarray]:
    """For sorted columns the number of each row's set by the first, the first two ... of them; nulls are equal."""
    new = None
    out = []
    for c in columns:
        code = np.asarray(pc.dictionary_encode(c, null_encoding="encode").indices)
        turn = np.r_[False, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
        new = turn if new is None else new | turn
        out.append(np.cumsum(new))
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Batches sorted by their first column, joined so that no group is parted."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            first = _numbered([t.column(0).chunk(0)])[0]
            end = int(np.searchsorted(first, first[-1]))
            if end:
                yield t.slice(0, end).combine_chunks()
                held = t.slice(end).combine_chunks().to_batches()
                rows -= end
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _propagate(cells: DataFrame, by: list[str], names: list[str], weights: tuple[float, ...]) -> DataFrame:
    """``cells`` with ``_l_<name>``: labels spread within the groups of ``by[0]``, edges by all of ``by`` and each shorter
    beginning of it. Cells have ``_c_<name>`` observed rows summing to ``_s_<name>`` and ``_m_<name>`` missing ones.

    A group's cells meet in one task: they are its combinations of ``by``, kinds times years, however many rows it has.
    """
    ordered = cells.select(*by, *[c for c in cells.columns if c not in by])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + "".join(f", `_l_{n}` double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            levels = _numbered([t.column(i).chunk(0) for i in range(len(by))])[::-1]
            for n in names:
                col = lambda c: np.asarray(pc.fill_null(t[f"_{c}_{n}"].cast(pa.float64()), 0.0))  # noqa: B023, E731
                label = spread_labels(col("s"), col("c"), col("m"), levels, weights)
                t = t.append_column(f"_l_{n}", pa.array(label, mask=np.isnan(label)))
            yield from t.to_batches()

    return ordered.repartition(by[0]).sortWithinPartitions(*by).mapInArrow(run, schema)


def propagate_numeric(rows: DataFrame, key: str, fields: dict[str, Column], near: str, far: str, like: str) -> DataFrame:
    """Fill each of ``fields`` from rows of the same ``near`` group, else of the same ``far`` group.

    ``fields`` gives for each name the column with valid values and null elsewhere. Result: ``key``, and
    per field ``<name>`` (observed or filled), ``<name>_from``: ``near``'s column name, ``far``'s or
    ``none`` for a missing cell by where its label came from, null for an observed one, which is never changed.

    Edges join a row to its group, to the rows of the group that are alike in ``like``, and to those alike in ``like`` and
    ``far``. Rows with equal ``(near, far, like)`` have the same edges and thus the same label, so labels live on a table of
    such cells, each with the count and sum of its observed values; they are propagated until they stand still (see
    :func:`spread_labels`). Missing cells that no label of their near group reaches take part in the same way in the graph
    of their far group, with edges to the rows of one ``far`` and to those alike in ``like``.

    A null ``near`` or ``far`` groups nothing; a null ``like`` is a kind of its own. A cell without any source
    stays null, marked ``none``. Repeated rows count as often as they occur. Empty tables give empty
    results. Other columns, whatever their names, aren't carried.
    """
    names = list(fields)
    base = rows.select(F.col(key).alias("_key"), F.col(near).alias("_near"), F.col(far).alias("_far"), F.col(like).alias("_like"), *[c.alias(f"_x_{n}") for n, c in fields.items()])
    cell = ["_near", "_like", "_far"]
    sums = [e for n in names for e in (F.count(f"_x_{n}").alias(f"_c_{n}"), F.sum(f"_x_{n}").alias(f"_s_{n}"), (F.count("*") - F.count(f"_x_{n}")).alias(f"_m_{n}"))]
    cells = base.groupBy(*cell).agg(*sums)
    alone = cells.where("_near is null").select(*cells.columns, *[F.lit(None).cast("double").alias(f"_l_{n}") for n in names])
    labelled = cut(_propagate(cells.where("_near is not null"), cell, names, WEIGHTS).unionByName(alone), "labels")
    # What no label reached asks its far group; all observed values answer.
    left = [e for n in names for e in (F.sum(f"_c_{n}").alias(f"_c_{n}"), F.sum(f"_s_{n}").alias(f"_s_{n}"), F.sum(F.when(F.col(f"_l_{n}").isNull(), F.col(f"_m_{n}")).otherwise(0)).alias(f"_m_{n}"))]
    years = _propagate(labelled.where("_far is not null").groupBy("_far", "_like").agg(*left), ["_far", "_like"], names, FAR_WEIGHTS)
    years = years.select(F.col("_far").alias("_jf"), F.col("_like").alias("_jl"), *[F.col(f"_l_{n}").alias(f"_f_{n}") for n in names])
    both = labelled.join(years, (labelled["_far"] == years["_jf"]) & labelled["_like"].eqNullSafe(years["_jl"]), "left")
    missing = reduce(lambda a, b: a | b, [F.col(f"_m_{n}") > 0 for n in names])
    source = {n: F.when(F.col(f"_l_{n}").isNotNull(), near).when(F.col(f"_f_{n}").isNotNull(), far).otherwise("none") for n in names}
    labels = cut(both.where(missing).select(*[F.col(c).alias(f"_j{c}") for c in cell], *[c for n in names for c in (source[n].alias(f"_from_{n}"), F.coalesce(f"_l_{n}", f"_f_{n}").alias(f"_l_{n}"))]), "labels")
    done = base.join(labels, reduce(lambda x, y: x & y, [base[c].eqNullSafe(labels[f"_j{c}"]) for c in cell]), "left")
    return done.select(F.col("_key").alias(key), *[c for n in names for c in (F.coalesce(f"_x_{n}", f"_l_{n}").alias(n), F.when(F.col(f"_x_{n}").isNull(), F.col(f"_from_{n}")).alias(f"{n}_from"))])


def propagate_category(rows: DataFrame, key: str, field: Column, name: str, near: Column, far: Column, like: Column) -> DataFrame:
    """The same for a categorical ``field``: ``(key, name, name_from)``, from ``near`` or ``far``.

    Each cell holds the distribution of its observed categories, and every category's share is propagated like a number
    on the same edges; a missing cell takes the likeliest of its label (ties: the smallest text). A group's categories and
    cells meet in one task, never its rows.
    """
    base = rows.select(F.col(key).alias("_key"), near.alias("_near"), far.alias("_far"), like.alias("_like"), field.cast("string").alias("_x"))

    def spread(cells: DataFrame, by: list[str], weights: tuple[float, ...], out: str) -> DataFrame:
        """``by`` and ``out``: the likeliest category of each cell; cells have ``_x``, ``_n`` and ``_m``."""
        schema = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by) + f", `{out}` string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _whole_groups(batches):
                *most, finest = _numbered([t.column(i).chunk(0) for i in range(len(by))])
                words, n, m = t["_x"].to_pylist(), np.asarray(t["_n"].cast(pa.float64())), np.asarray(t["_m"].cast(pa.float64()))
                first = np.flatnonzero(np.r_[True, finest[1:] != finest[:-1]])
                group = most[0] if most else finest
                missing, seen = np.bincount(finest, m), np.bincount(finest, np.where([w is not None for w in words], n, 0.0))
                cats: dict[int, dict[str, int]] = {}
                for g, w in zip(group.tolist(), words):
                    if w is not None:
                        cats.setdefault(g, {}).setdefault(w, len(cats[g]) if g in cats else 0)
                of = group[first]
                ends = np.searchsorted(of, np.arange(int(group[-1]) + 1), side="right")
                starts = np.r_[0, ends[:-1]]
                best: list[str | None] = [None] * len(first)
                for g, known in cats.items():
                    lo, hi = int(starts[g]), int(ends[g])
                    total = np.zeros((len(known), hi - lo))
                    a, b = int(np.searchsorted(group, g)), int(np.searchsorted(group, g, side="right"))
                    for i in range(a, b):
                        if words[i] is not None:
                            total[known[words[i]], finest[i] - lo] += n[i]
                    levels = [(k[first[lo:hi]] - k[first[lo]]) for k in [finest, *most[::-1]]]
                    share = [spread_labels(row, seen[lo:hi], missing[lo:hi], levels, weights) for row in total]
                    order = sorted(known)
                    top = np.argmax(np.round(np.array([share[known[w]] for w in order]), 9), axis=0)
                    best[lo:hi] = [order[k] for k in top]
                yield pa.RecordBatch.from_arrays([t.column(i).chunk(0).take(pa.array(first)) for i in range(len(by))] + [pa.array(best, pa.string())], names=[*by, out])

        return cells.select(*by, "_x", "_n", "_m").repartition(by[0]).sortWithinPartitions(*by).mapInArrow(run, schema)

    cell = ["_near", "_like", "_far"]
    counts = cut(base.groupBy(*cell, "_x").agg(F.count("*").alias("_n")).withColumn("_m", F.when(F.col("_x").isNull(), F.col("_n")).otherwise(0)), "counts")
    got = cut(spread(counts.where("_near is not null"), cell, WEIGHTS, "_bn"), "labels")
    same = reduce(lambda x, y: x & y, [counts[c].eqNullSafe(F.col(f"_j{c}")) for c in cell])
    near_of = got.select(*[F.col(c).alias(f"_j{c}") for c in cell], "_bn")
    asking = counts.join(near_of, same, "left").withColumn("_m", F.when(F.col("_bn").isNull(), F.col("_m")).otherwise(0))
    years = asking.where("_far is not null").groupBy("_far", "_like", "_x").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    far_of = spread(years, ["_far", "_like"], FAR_WEIGHTS, "_bf").select(F.col("_far").alias("_jf"), F.col("_like").alias("_jl"), "_bf")
    j = base.join(near_of, reduce(lambda x, y: x & y, [base[c].eqNullSafe(near_of[f"_j{c}"]) for c in cell]), "left")
    j = j.join(far_of, (F.col("_far") == F.col("_jf")) & F.col("_like").eqNullSafe(F.col("_jl")), "left")
    source = F.when(F.col("_bn").isNotNull(), "near").when(F.col("_bf").isNotNull(), "far").otherwise("none")
    return j.select(F.col("_key").alias(key), F.coalesce("_x", "_bn", "_bf").alias(name), F.when(F.col("_x").isNull(), source).alias(f"{name}_from"))


def fills(filled: DataFrame, key: str, names: list[str], say: dict[str, str]) -> DataFrame:
    """One row per filled or unfillable cell: ``(key, field_name, fill_from)``; ``say`` renames sources."""
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"{n}_from").alias("fill_from")) for n in names])
    long = filled.select(F.col(key), F.explode(each).alias("_e")).select(key, "_e.*").where("fill_from is not null")
    return long.replace(say, subset=["fill_from"])
