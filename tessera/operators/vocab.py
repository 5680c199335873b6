"""Set-valued labels per ligand, ranked vocabularies, multi-hot rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import running_sum


def label_sets(active: DataFrame, proteins: DataFrame, ligand: str, protein: str, year: str) -> DataFrame:
    """``(ligand, families, targets, year)``: sorted distinct labels of its active proteins, latest year.

    ``proteins`` is ``(protein, target, families)``. Distinct pairs are taken first, so repeats cost nothing. A
    ligand whose proteins have no label is still there, with empty lists. Missing years are null.
    """
    pairs = active.where(F.col(ligand).isNotNull()).groupBy(ligand, protein).agg(F.max(F.when(F.col(year) >= 0, F.col(year))).alias("_y"))
    j = pairs.join(proteins, protein)
    return j.groupBy(ligand).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("families"),
        F.array_sort(F.collect_set("target")).alias("targets"),
        F.max("_y").alias("year"),
    )


#: Labels of a vocabulary that may stand beside every row as one array.
MOST_LABELS = 20_000


def vocabulary(sets: DataFrame, labels: str, least: int, top: int | None = None) -> DataFrame:
    """``(idx, label, n_active)``: labels with at least ``least`` ligands, most first, then by name.

    Ranks are running sums in slots of count and first letters, so no task holds all labels.
    """
    counts = sets.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n_active")).where(F.col("n_active") >= least)
    if top:
        counts = counts.orderBy(F.desc("n_active"), "label").limit(top)
    slot = F.struct((-F.col("n_active")).alias("n"), F.substring("label", 1, 3).alias("s"))
    ranked = running_sum(counts.withColumns({"_all": F.lit(0)}), ["_all"], {"idx": F.lit(1).cast("bigint")}, slot, ["label"])
    return ranked.select(F.col("idx").cast("int").alias("idx"), "label", "n_active")


def _beside(vocab: DataFrame, value: Column) -> Column:
    """A vocabulary as one value beside every row, its size checked."""
    if vocab.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"a vocabulary of more than {MOST_LABELS} labels can't stand beside every row")
    return vocab.agg(value.alias("_w")).scalar()


def multi_hot(sets: DataFrame, key: str, labels: str, vocab: DataFrame) -> DataFrame:
    """``(key, hot)``: 0 or 1 for each label in vocabulary order; labels outside it are ignored.

    The row is as wide as the vocabulary, which has MOST_LABELS at most.
    """
    words = _beside(vocab, F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]))
    return sets.withColumn("_w", words).select(key, F.transform("_w", lambda w: F.array_contains(F.col(labels), w).cast("int")).alias("hot"))


def keep_known(sets: DataFrame, labels: str, vocab: DataFrame) -> DataFrame:
    """Label lists cut to the vocabulary, which has MOST_LABELS at most; ligands left without a label are dropped."""
    words = _beside(vocab, F.collect_list("label"))
    return sets.withColumn(labels, F.array_intersect(F.col(labels), words)).where(F.size(labels) > 0)
