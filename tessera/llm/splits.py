"""Train, validation and test splits in which related records stay together.

Proteins and scaffolds that occur in one record are related, and so on from record to record. The table of
components is kept and grown, version by version: new records only merge what they tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components, hubs, star_edges, units_of
from tessera.operators.placement import place
from tessera.persist import Versions, cut

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def scaffold(c):  # noqa: ANN001, ANN201
    """Scaffold, or null where it is missing."""
    return F.when(c >= 0, c)


def grow(rows: DataFrame, before: DataFrame | None = None, protein: str = "protein_ids", group: str = "scaffold_groups") -> DataFrame:
    """Components after ``rows``: ``(kind, id, component)`` for each protein and each scaffold, written to the
    shared folder; ``component`` is the smallest protein in it.

    ``before`` is an earlier result. Its members stand for themselves, so the merge works on components, not
    on old records: new ties are relabelled by component, their components found by pointer jumping, and
    the labels of merged ones replaced. A scaffold that never comes with a protein is left out; missing
    scaffolds tie nothing; repeated rows change nothing.
    """
    ties = rows.select(F.col(protein).cast("bigint").alias("p"), scaffold(F.col(group)).cast("bigint").alias("s")).where("p is not null").distinct()
    if before is None:
        ties = cut(ties, "ties")
        hub = hubs(ties, "p", "s")
        of = cut(connected_components(star_edges(ties, hub, "p", "s")), "components")
        scaffolds = hub.join(of, hub["hub"] == of["node"]).select(F.lit("scaffold").alias("kind"), F.col("s").alias("id"), "component")
        return cut(of.select(F.lit("protein").alias("kind"), F.col("node").alias("id"), "component").unionByName(scaffolds), "components")
    old_p = before.where("kind = 'protein'").select(F.col("id").alias("p"), F.col("component").alias("cp"))
    old_s = before.where("kind = 'scaffold'").select(F.col("id").alias("s"), F.col("component").alias("cs"))
    tied = ties.join(old_p, "p", "left").join(old_s, "s", "left").select("s", F.col("p"), F.coalesce("cp", "p").alias("c"), "cs")
    tied = cut(tied, "tied")
    hub = tied.where("s is not null").groupBy("s").agg(F.least(F.min("c"), F.min("cs")).alias("hub"))
    edges = tied.join(hub, "s").select(F.col("hub").alias("src"), F.explode(F.array("c", F.coalesce("cs", "c"))).alias("dst"))
    of = cut(connected_components(edges.unionByName(tied.select(F.col("c").alias("src"), F.col("c").alias("dst")))), "merged")
    all_p = before.where("kind = 'protein'").select("id", "component").unionByName(tied.join(old_p, "p", "left_anti").select(F.col("p").alias("id"), F.col("p").alias("component")).distinct())
    all_s = old_s.select(F.col("s").alias("id"), F.col("cs").alias("component")).unionByName(hub.join(old_s, "s", "left_anti").select(F.col("s").alias("id"), F.col("hub").alias("component")))
    both = all_p.select(F.lit("protein").alias("kind"), "id", "component").unionByName(all_s.select(F.lit("scaffold").alias("kind"), "id", "component"))
    new = of.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(both.join(new, "component", "left").select("kind", "id", F.coalesce("to", "component").alias("component")), "components")


class ComponentTable:
    """The table of components under a name of its own: every batch of rows is merged into the last version and committed
    as the next, so a later run, or one after a failure, goes on from where the last commit was.

    ``path`` is a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.versions = Versions(spark, path)

    def load(self, number: int | None = None) -> DataFrame | None:
        return self.versions.load(number)

    def extend(self, rows: DataFrame, protein: str = "protein_ids", group: str = "scaffold_groups") -> DataFrame:
        """Merge what ``rows`` tie into the last version; the new one, as committed."""
        return self.versions.load(self.versions.commit(grow(rows, self.load(), protein, group)))


def units(rows: DataFrame, components: DataFrame, row: str = "row_id", protein: str = "protein_ids", group: str = "scaffold_groups") -> DataFrame:
    """Each row's unit, the thing that is put into a split: ``(_row, _y, unit_kind, unit)``.

    A row with a protein belongs to its component; one without to its scaffold's component, or to the
    scaffold alone where no protein has it, or else stands alone.
    """
    members = components.where("kind = 'protein'").select(F.col("id").alias("_m"), F.col("component").alias("_cm"))
    groups = components.where("kind = 'scaffold'").select(F.col("id").alias("_g"), F.col("component").alias("_cg"))
    got = units_of(rows, row, F.col(protein).cast("bigint"), scaffold(F.col(group)).cast("bigint"), members, groups, {"_y": F.col("years")})
    return got.replace({"group": "scaffold"}, subset=["unit_kind"])


def assign(sized: DataFrame, shares: dict[str, float] | None = None, placed: DataFrame | None = None) -> DataFrame:
    """Split of each unit: ``(unit_kind, unit, rows, split, state)`` from ``(unit_kind, unit, rows)``.

    ``placed`` holds earlier assignments, ``(unit_kind, unit, split)``, its units already relabelled to the
    present components. A unit with one earlier split keeps it (``kept``); one that merges different splits
    is in none of them (``quarantined``). New units fill what each split lacks: largest first, equal ones in hash order,
    each into the split that lacks most.
    """
    shares = shares or SPLITS
    names = list(shares)
    if placed is None:
        state = sized.withColumns({"split": F.lit(None).cast("string"), "state": F.lit("new")})
    else:
        had = placed.where(F.col("split").isin(names)).groupBy("unit_kind", "unit").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        frozen = placed.where("split = 'quarantine'").select("unit_kind", "unit", F.lit(True).alias("frozen")).distinct()
        state = sized.join(had, ["unit_kind", "unit"], "left").join(frozen, ["unit_kind", "unit"], "left")
        bad = F.coalesce(F.col("frozen"), F.lit(False)) | F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
        state = state.select("unit_kind", "unit", "rows", F.when(bad, "quarantine").otherwise(F.col("lo")).alias("split"), F.when(bad, "quarantined").when(F.col("lo").isNotNull(), "kept").otherwise("new").alias("state"))
    state = cut(state, "units")
    have = {r["split"]: r["n"] for r in state.groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    total = sum(n for s, n in have.items() if s != "quarantine")
    lack = {s: shares[s] * total - have.get(s, 0) for s in names}
    new = place(state.where("state = 'new'"), ["unit_kind", "unit"], "rows", lack)
    out = state.where("state <> 'new'").unionByName(new.select("unit_kind", "unit", "rows", F.col("fold").alias("split"), F.lit("new").alias("state")))
    return cut(out, "assigned")


def relabel(assigned: DataFrame, components: DataFrame) -> DataFrame:
    """Earlier assignments with the units' present names: an old component is now its smallest protein's."""
    now = components.where("kind = 'protein'").select(F.col("id").alias("unit"), F.col("component").alias("_now"))
    moved = assigned.where("unit_kind = 'component'").join(now, "unit", "left").select("unit_kind", F.coalesce("_now", "unit").alias("unit"), "split")
    now_s = components.where("kind = 'scaffold'").select(F.col("id").alias("unit"), F.col("component").alias("_now"))
    lone = assigned.where("unit_kind = 'scaffold'").join(now_s, "unit", "left").select(F.when(F.col("_now").isNull(), "scaffold").otherwise("component").alias("unit_kind"), F.coalesce("_now", "unit").alias("unit"), "split")
    return moved.unionByName(lone).unionByName(assigned.where("unit_kind = 'row'").select("unit_kind", "unit", "split"))


def report(rows_units: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows, share, units and years of each split; a missing year counts as oldest and shows as -1."""
    year = F.when(F.col("_y") >= 0, F.col("_y")).otherwise(-1)
    by = rows_units.groupBy("unit_kind", "unit").agg(F.count("*").alias("n"), F.min(year).alias("y0"), F.max(year).alias("y1"))
    j = by.join(assigned.select("unit_kind", "unit", "split"), ["unit_kind", "unit"])
    out = j.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_units"), F.min("y0").alias("min_year"), F.max("y1").alias("max_year"))
    total = rows_units.agg(F.count("*")).scalar()
    return out.withColumn("share", F.col("n_rows") / total)
