"""Raw multi-valued activity tables to pairs: type flags, the quantitative and the class pass, molecules, protein sidecar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.prepare import explode_lists, first_by, union_all

# The type flags in the order in which one of several wins, and the columns that hold lists together.
TYPE_FLAGS = {"type_ki": "Ki", "type_kd": "Kd", "type_ic50": "IC50", "type_ec50": "EC50", "type_other": "Other"}
LISTS = [*TYPE_FLAGS, "relation", "pchembl_value"]


def flag(c: Column) -> Column:
    """True for a flag that is set."""
    return F.coalesce(F.lower(S.strip(c.cast("string"))).isin(S.FLAG_YES), F.lit(False))


def assay_of_flags(flags: dict[str, str] = TYPE_FLAGS) -> Column:
    """The assay of the first flag that is set, null where none is."""
    return F.coalesce(*[F.when(flag(F.col(c)), a) for c, a in flags.items()])


def exact_relation(df: DataFrame, relation: str = "relation") -> DataFrame:
    """Rows whose relation is ``=``; all rows where there is no such column."""
    return df.where(S.strip(F.col(relation)) == "=") if relation in df.columns else df


def activity_rows(raw: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``item``, the list columns and ``assay``: one row per activity with a type flag set.

    A row with ``;`` in a flag is exploded together with its relation and value, then held to an exact relation and a set
    flag; a simple row needs a set flag only, its relation being checked by the caller. A ``;`` in relation or value alone
    is no list. Simple rows have item null.
    """
    several = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").contains(";"), F.lit(False)) for c in TYPE_FLAGS])
    simple = raw.where(~several).select(*keep, F.lit(None).cast("int").alias("item"), *LISTS)
    parted = exact_relation(explode_lists(raw.where(several), LISTS, keep)).select(*keep, "item", *LISTS)
    return union_all([simple, parted]).withColumn("assay", assay_of_flags()).where("assay is not null")


def passes(rows: DataFrame, class_column: str, order: list[str], limit: int | None = None) -> DataFrame:
    """All columns and ``pass``: rows without class first, then those with one, up to a limit that both share."""
    both = rows.withColumn("pass", F.when(F.col(class_column).isNull(), "quantitative").otherwise("class"))
    if limit is None:
        return both
    if limit <= 0:
        raise ValueError("a limit must be above 0")
    return both.orderBy(F.desc("pass"), *order).limit(limit)


def count_passes(rows: DataFrame, class_column: str) -> DataFrame:
    """One row: how many rows have a class and how many don't."""
    return rows.agg(F.count_if(F.col(class_column).isNull()).alias("n_quantitative"), F.count_if(F.col(class_column).isNotNull()).alias("n_class"))


def with_molecules(activity: DataFrame, molecules: DataFrame, key: str, smiles: str = "smiles") -> DataFrame:
    """Activities of molecules with a known structure, ``smiles`` beside them; unknown and blank ones are skipped."""
    known = molecules.where(S.text(F.col(smiles)) != "").select(F.col(key).alias("_key"), S.text(F.col(smiles)).alias(smiles))
    return activity.join(known, activity[key] == known["_key"]).drop("_key")


def protein_sidecar(pairs: DataFrame, proteins: DataFrame, row: str, sequence: str, name: str) -> DataFrame:
    """``(sequence, name, ...)``: distinct sequences of a pair table with the name first seen, and what ``proteins`` (one row per
    ``sequence``) knows of them."""
    own = pairs.where(S.text(F.col(sequence)) != "").select(F.col(row), S.text(F.col(sequence)).alias("sequence"), S.text(F.col(name)).alias("name"))
    return first_by(own, "sequence", row, ["name"]).join(proteins, "sequence", "left")


def join_sidecar(pairs: DataFrame, sidecar: DataFrame, sequence: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """Pairs with their protein, and one row counting the pairs that have one and those that miss it."""
    sides = sidecar.withColumnRenamed("sequence", "_sequence")
    found = pairs.join(sides, pairs[sequence] == sides["_sequence"], "left").withColumn("_hit", F.col("_sequence").isNotNull())
    counts = found.agg(F.count_if("_hit").alias("n_found"), F.count_if(~F.col("_hit")).alias("n_missed"))
    return found.where("_hit").drop("_sequence", "_hit"), counts
