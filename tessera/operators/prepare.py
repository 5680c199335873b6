"""Raw activity tables to prepared pairs: unpivot, explode, dimension tables, joins, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S

#: Wide columns of the prepared table by assay, in output order.
WIDE = {"IC50": "ic50_nm", "EC50": "ec50_nm", "Ki": "ki_nm", "Kd": "kd_nm", "Other": "other_nm"}


def unpivot_assays(wide: DataFrame, keep: list[str]) -> DataFrame:
    """One row per valid measurement: ``keep``, ``assay_type, assay_order, nm, pactivity``.

    Censored, junk, null and non-positive cells give no row. One pass: the five cells of a row are stacked, then each is
    parsed once.
    """
    cells = ", ".join(f"'{a}', {i}, `{c}`" for i, (a, c) in enumerate(WIDE.items()))
    long = wide.select(*keep, F.expr(f"stack({len(WIDE)}, {cells}) AS (assay_type, assay_order, _cell)")).where("_cell is not null")
    return long.select(*keep, "assay_type", "assay_order", S.activity_nm(F.col("_cell")).alias("nm")).where("nm is not null").withColumn("pactivity", S.pactivity(F.col("nm")))


def prepared_long(wide: DataFrame, key: str = "pair_id") -> DataFrame:
    """The long prepared table with typed conditions, label and year; rows without SMILES or chain are dropped."""
    base = wide.select(
        key,
        S.text(F.col("ligand_smiles")).alias("smiles"),
        S.text(F.col("target_chain_sequence")).alias("sequence"),
        F.coalesce(S.ph(F.col("ph")), F.lit(S.DEFAULT_PH)).alias("ph"),
        F.coalesce(S.temperature(F.col("temp_c")), F.lit(S.DEFAULT_TEMP)).alias("temp"),
        S.activity_label(F.col("activity_label")).alias("activity_label"),
        S.year(F.col("year")).alias("year"),
        *WIDE.values(),
    ).where("smiles <> '' and sequence <> ''")
    return unpivot_assays(base, [key, "smiles", "sequence", "ph", "temp", "activity_label", "year"])


def repivot(long: DataFrame, keep: list[str], assay: str, nm: str) -> DataFrame:
    """The measurement back in its assay's wide column, rounded to six significant digits; others null."""
    return long.select(*keep, *[F.when(F.col(assay) == a, S.significant(F.col(nm))).alias(c) for a, c in WIDE.items()])


def explode_lists(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Aligned explode of ``;``-parted texts: shorter lists repeat their last item; adds ``item`` from 0."""
    lists = {c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)) for c in columns}
    split = df.select(*keep, *[v.alias(f"_l_{c}") for c, v in lists.items()])
    longest = F.greatest(*[F.size(f"_l_{c}") for c in columns]) if len(columns) > 1 else F.size(f"_l_{columns[0]}")
    at = split.select(*keep, *[f"_l_{c}" for c in columns], F.explode(F.sequence(F.lit(0), longest - 1)).alias("item"))
    return at.select(*keep, "item", *[F.get(F.col(f"_l_{c}"), F.least(F.col("item"), F.size(f"_l_{c}") - 1)).alias(c) for c in columns])


def first_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the columns of its first row in ``order``."""
    return df.groupBy(key).agg(F.min(F.struct(F.col(order).alias("_o"), *columns)).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in columns])


def last_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the columns of its last row in ``order``."""
    return df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_o"), *columns)).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in columns])


def filled(c: str) -> Column:
    """The text without outer blanks, null where it is blank or ``nan``."""
    s = S.strip(F.col(c))
    return F.when((s != "") & (F.lower(s) != "nan"), s)


def protein_dimension(proteins: DataFrame) -> DataFrame:
    """``(target_id, name, organism, sequence)``: last row of each target wins; without sequence a row is dropped."""
    base = proteins.select("record_id", F.col("target_id"), F.coalesce(filled("tid"), filled("accession"), F.col("target_id")).alias("name"), S.text(F.col("organism")).alias("organism"), filled("chain_sequence").alias("sequence"))
    return last_by(base.where("sequence is not null and target_id is not null"), "target_id", "record_id", ["name", "organism", "sequence"])


def sequence_dimension(proteins: DataFrame) -> DataFrame:
    """``(sequence, target_id, n_targets)``: first row of each sequence wins; targets that share it are counted."""
    base = proteins.select("record_id", "target_id", filled("chain_sequence").alias("sequence")).where("sequence is not null and target_id is not null")
    first = base.groupBy("sequence").agg(F.min(F.struct("record_id", "target_id")).alias("_b"), F.countDistinct("target_id").alias("n_targets"))
    return first.select("sequence", F.col("_b.target_id").alias("target_id"), "n_targets")


def gpcr_reason(df: DataFrame) -> Column:
    """First reason why a raw row is skipped, null for one that is kept."""
    return (
        F.when(F.coalesce(S.strip(F.col("standard_relation")), F.lit("")) != "=", "relation")
        .when(F.coalesce(S.strip(F.col("standard_units")), F.lit("")) != "nM", "units")
        .when(S.assay_of_type(S.strip(F.col("standard_type"))).isNull(), "type")
        .when(F.coalesce(S.number(F.col("standard_value")), F.lit(0.0)) <= 0, "value")
        .when(S.text(F.col("accession")) == "", "accession")
        .when(S.text(F.col("parent_molecule_chembl_id")) == "", "ligand")
    )


def gpcr_pairs(raw: DataFrame, proteins: DataFrame) -> DataFrame:
    """Kept raw rows joined with their protein by accession in upper case: the protein's name, else the entry's."""
    ok = raw.where(gpcr_reason(raw).isNull()).select("row_id", F.upper(S.strip(F.col("accession"))).alias("accession"), S.text(F.col("entry_name")).alias("entry_name"), S.strip(F.col("parent_molecule_chembl_id")).alias("ligand"), S.assay_of_type(S.strip(F.col("standard_type"))).alias("assay_type"), S.number(F.col("standard_value")).alias("nm"))
    dim = last_by(proteins.select("record_id", F.upper(S.strip(F.col("accession"))).alias("accession"), filled("tid").alias("name"), filled("chain_sequence").alias("sequence")).where("accession is not null and sequence is not null"), "accession", "record_id", ["name", "sequence"])
    return ok.join(dim, "accession").select("row_id", "accession", F.coalesce("name", "entry_name").alias("name"), "ligand", "assay_type", "nm", F.length("sequence").alias("chain_length"))


def dense_ids(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """``(key, first, out)``: distinct keys numbered from 0 in the order they are first seen.

    The numbering sums along ranges of the order, of which there are at most 65536, so no task holds all keys and the table
    of ranges stays small.
    """
    from tessera.operators.prefix import running_sum

    seen = df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.min(order).alias("first")).withColumn("_all", F.lit(0))
    span = df.agg((F.max(order) - F.min(order)).alias("s")).scalar()
    width = F.greatest(F.lit(4096), F.ceil(F.coalesce(span, F.lit(0)) / 65536))
    got = running_sum(seen, ["_all"], {out: F.lit(1).cast("bigint")}, F.floor(F.col("first") / width), ["first", key])
    return got.drop("_all")


def counts_by_reason(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def column_or(df: DataFrame, column: str | None, default: object) -> Column:
    """The column with null cells filled by the default, or the default alone where there is no such column."""
    return F.coalesce(F.col(column), F.lit(default)) if column and column in df.columns else F.lit(default)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, columns by name, missing ones null; nothing is deduplicated."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def range_rows(long: DataFrame, key: str, weak: bool = False, weak_weight: float = 1.0) -> DataFrame:
    """Rows of the potency-range task: ``(key, head_idx, y_bin, loss_weight, from_binary)``.

    Measured IC50 (head 0) and EC50 (head 1) rows without class label; with ``weak``, class-labelled inactive
    rows too, in the last bin, an untyped one for both heads. Class-labelled active rows never.
    """
    head = F.when(F.col("assay_type") == "IC50", 0).when(F.col("assay_type") == "EC50", 1)
    measured = long.where(F.col("activity_label").isNull() & head.isNotNull()).select(key, head.alias("head_idx"), S.potency_bin(F.col("nm")).alias("y_bin"), F.lit(1.0).alias("loss_weight"), F.lit(False).alias("from_binary"))
    if not weak:
        return measured
    heads = F.when(F.col("assay_type") == "Other", F.array(F.lit(0), F.lit(1))).when(head.isNotNull(), F.array(head))
    soft = long.where(F.col("activity_label") == 0).select(key, F.explode(heads).alias("head_idx"), F.lit(len(S.BIN_EDGES)).alias("y_bin"), F.lit(weak_weight).alias("loss_weight"), F.lit(True).alias("from_binary"))
    return measured.unionByName(soft)
