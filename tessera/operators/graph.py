"""Connected components by min-hooking, pointer jumping and edge contraction, all as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.persist import cut, cut_counting, drop_cut


#: Edges between components that one task may finish; two whole numbers each, so some 16 MB.
LOCAL = 1 << 20


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same hooking and pointer jumping on the arrays of one task: ``(node, root)`` of all nodes of its edges."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    u, v = (np.asarray(t[c].combine_chunks()) for c in ("u", "v"))
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Component of each node that occurs in ``edges``: ``(node, component)``, component = smallest node.

    Each round every node points at its smallest neighbour, pointers are jumped until all point at roots, and the
    edges are relabelled by root and deduplicated. A node with a smaller neighbour is never a root, so every component
    with edges left loses nodes in each round, usually most of them; a star is done in two rounds whatever its
    centre. Every table is written to the shared folder once, then counted; pointers are jumped twice
    a write. After the first round, once no more than LOCAL edges are left between whole numbers, one task finishes them in the
    same way and with the same result. Edges with a null end are ignored; self loops only announce their node; repeated edges change nothing;
    an empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    first, left = cut_counting(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), F.count_if(F.col("u") < F.col("v")), "edges")
    live, labels = first.where("u < v"), None
    old: DataFrame | None = None
    whole = e.schema["u"].dataType.typeName() in ("long", "integer")
    while left:
        if labels is not None and left <= LOCAL and whole:
            last = cut(live.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInArrow(_finish, "node bigint, root bigint"), "parent")
            labels = _moved(labels, last)
            break
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "parent")
        moved = 1
        while moved:
            up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r")).where("_n <> _r")
            over = up.select(F.col("_n").alias("_m"), F.col("_r").alias("_s"))
            once = parent.join(up, parent["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
            twice = once.join(over, once["root"] == over["_m"], "left").select("node", F.coalesce("_s", "root").alias("root"), F.col("_s").isNotNull().alias("moved"))
            jumped, moved = cut_counting(twice, F.count_if("moved"), "parent")
            drop_cut(parent)
            parent = jumped.select("node", "root")
        nxt, left = cut_counting(
            live.join(parent.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
            .join(parent.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
            .where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct(),
            F.count("*"),
            "edges",
        )
        if labels is None:
            labels = parent
        else:
            grown = cut(_moved(labels, parent), "labels")
            drop_cut(labels)
            drop_cut(parent)
            labels = grown
        if old is not None:
            drop_cut(old)
        live = old = nxt
    if labels is None:
        labels = spark.createDataFrame([], e.selectExpr("u as node", "u as root").schema)
    alone = first.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    out = labels.unionByName(alone.join(labels.select("node"), "node", "left_anti"))
    return out.select("node", F.col("root").alias("component"))


def _moved(labels: DataFrame, parent: DataFrame) -> DataFrame:
    step = parent.select(F.col("node").alias("component"), F.col("root").alias("_to"))
    return labels.join(step, labels["root"] == step["component"], "left").select("node", F.coalesce("_to", "root").alias("root"))


def hubs(ties: DataFrame, member: str, group: str) -> DataFrame:
    """``(group, hub)``: the smallest member of each group; rows with a null in either give none."""
    return ties.where(F.col(member).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.min(member).alias("hub"))


def star_edges(ties: DataFrame, hub: DataFrame, member: str, group: str) -> DataFrame:
    """Edges ``(src, dst)`` from the hub of each group to every member, and from every member to itself.

    A group of any size costs its number of distinct members, never their pairs. ``ties`` is distinct.
    """
    stars = ties.where(F.col(member).isNotNull()).join(hub, group).select(F.col("hub").alias("src"), F.col(member).alias("dst"))
    return stars.unionByName(ties.where(F.col(member).isNotNull()).select(F.col(member).alias("src"), F.col(member).alias("dst")))


def tied_units(rows: DataFrame, row: str, member: str, group: str) -> DataFrame:
    """``(row, unit_kind, unit)``: what each row has to stay with, as members and groups that occur together are tied.

    A row with a member belongs to its component; one without to its group's component, or to the group alone where
    no member has it, or else stands alone. A missing group is null.
    """
    ties = rows.select(F.col(member).alias("_m"), F.col(group).alias("_g")).distinct()
    hub = hubs(ties, "_m", "_g")
    of = cut(connected_components(star_edges(ties, hub, "_m", "_g")), "components")
    groups = hub.join(of, hub["hub"] == of["node"]).select("_g", F.col("component").alias("_cg"))
    return units_of(rows, row, F.col(member), F.col(group), of.select(F.col("node").alias("_m"), F.col("component").alias("_cm")), groups)


def units_of(rows: DataFrame, row: str, member: Column, group: Column, members: DataFrame, groups: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """The same from the components ``members`` ``(_m, _cm)`` and ``groups`` ``(_g, _cg)``, with the columns ``carry``."""
    base = rows.select(F.col(row).alias("_row"), member.alias("_m"), group.alias("_g"), *[c.alias(n) for n, c in (carry or {}).items()])
    keep = list(carry or {})
    whole = base.where("_m is not null").join(members, "_m").select("_row", *keep, F.lit("component").alias("unit_kind"), F.col("_cm").cast("bigint").alias("unit"))
    rest = base.where("_m is null").join(groups, "_g", "left")
    kind = F.when(F.col("_cg").isNotNull(), "component").when(F.col("_g").isNotNull(), "group").otherwise("row")
    return whole.unionByName(rest.select("_row", *keep, kind.alias("unit_kind"), F.coalesce("_cg", "_g", "_row").cast("bigint").alias("unit")))
