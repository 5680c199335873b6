"""Folds without leakage: by year, by first year of the protein, by blocks, by components, nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import tied_units
from tessera.operators.placement import place
from tessera.persist import cut


def dated(c: Column) -> Column:
    """The year, -1 where it is missing."""
    return F.coalesce(F.when(c >= 0, c), F.lit(-1))


def year_cutoffs(df: DataFrame, year: str, val: float, test: float) -> DataFrame:
    """``(val_year, test_year)``: the first years at which the dated rows up to them reach the shares.

    A histogram of years is all that is ordered.
    """
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("shares must be at least 0 and sum to less than 1")
    hist = df.where(F.col(year) >= 0).groupBy(F.col(year).alias("_y")).agg(F.count("*").alias("_n"))
    run = hist.withColumns({"_cum": F.sum("_n").over(Window.orderBy("_y")), "_all": F.sum("_n").over(Window.partitionBy())})
    at = lambda share: F.coalesce(F.min(F.when(F.col("_cum") >= share * F.col("_all"), F.col("_y"))), F.max("_y"))
    two = run.agg(at(F.lit(1.0 - val - test)).alias("val_year"), at(F.lit(1.0 - test)).alias("test_year"))
    return two.select("val_year", F.greatest("val_year", "test_year").alias("test_year"))


def time_split(df: DataFrame, year: str, cutoffs: DataFrame, with_val: bool = True) -> DataFrame:
    """All columns and ``fold``: undated rows and those up to the first cutoff are train."""
    y, v, t = dated(F.col(year)), cutoffs.select("val_year").scalar(), cutoffs.select("test_year").scalar()
    fold = F.when(y > t, "test").when(y > v, "val" if with_val else "train").otherwise("train")
    return df.withColumn("fold", fold)


def time_protein_cutoff(df: DataFrame, protein: str, year: str, n_years: int = 1, least: int = 1) -> DataFrame:
    """One row ``(cutoff)``: the latest year, from ``n_years`` years of data back, with enough rows of proteins
    first seen in it or later; else the one with most such rows, the oldest of equals; null if there are
    fewer years than that."""
    first = df.groupBy(protein).agg(F.min(dated(F.col(year))).alias("_first"), F.count("*").alias("_n")).where("_first >= 0")
    new = first.groupBy("_first").agg(F.sum("_n").alias("_n"))
    years = df.where(F.col(year) >= 0).select(F.col(year).alias("_y")).distinct()
    per = years.join(new, F.col("_y") == F.col("_first"), "left").select("_y", F.coalesce("_n", F.lit(0)).alias("_n"))
    back = Window.orderBy(F.desc("_y"))
    ranked = per.withColumns({"_rank": F.row_number().over(back), "_cold": F.sum("_n").over(back)}).where(F.col("_rank") >= n_years)
    enough = F.max(F.when(F.col("_cold") >= least, F.col("_y")))
    return ranked.agg(F.coalesce(enough, F.max(F.struct(F.col("_cold"), (-F.col("_y")).alias("y")))["y"] * -1).alias("cutoff"))


def time_protein_split(df: DataFrame, protein: str, year: str, n_years: int = 1, least: int = 1) -> DataFrame:
    """All columns and ``fold``: ``val`` for rows of proteins first seen at or after the cutoff, undated rows
    counting as earliest."""
    cutoff = time_protein_cutoff(df, protein, year, n_years, least).scalar()
    first = df.groupBy(F.col(protein).alias("_p")).agg(F.min(dated(F.col(year))).alias("_first"))
    j = df.join(first, df[protein].eqNullSafe(first["_p"]))
    return j.withColumn("fold", F.when(F.col("_first") >= cutoff, "val").otherwise("train")).drop("_p", "_first")


def assign_blocks(sizes: DataFrame, block: str | list[str], n: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``(block, n, fold)``: whole blocks to folds near their shares of the rows.

    Blocks go largest first, equal ones in hash order, to the fold that lacks most, first name on a tie.
    """
    key = [block] if isinstance(block, str) else block
    sizes = cut(sizes.select(*key, n), "blocks")
    total = sizes.agg(F.sum(n)).first()[0] or 0
    return place(sizes, key, n, {s: share * total for s, share in shares.items()}, seed)


def cold_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """All columns and ``fold``, no value of ``key`` in two folds; the rows without it are one block, in the first fold."""
    sizes = df.groupBy(F.col(key).alias("_b")).agg(F.count("*").alias("_n"))
    folds = assign_blocks(sizes.where("_b is not null"), "_b", "_n", shares, seed)
    first = next(iter(shares))
    return df.join(folds.select("_b", F.col("fold").alias("_fold")), df[key] == folds["_b"], "left").withColumn("fold", F.coalesce("_fold", F.lit(first))).drop("_b", "_fold")


def double_cold_split(df: DataFrame, row: str, protein: str, scaffold: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """All columns and ``fold``, no protein and no scaffold in two folds; a missing scaffold ties nothing.

    A row without protein stays with its scaffold's proteins, or with its scaffold alone; one with neither stands
    alone. Row ids are unique.
    """
    units = cut(tied_units(df.withColumn(scaffold, F.when(F.col(scaffold) >= 0, F.col(scaffold))), row, protein, scaffold), "units")
    folds = assign_blocks(units.groupBy("unit_kind", "unit").agg(F.count("*").alias("_n")), ["unit_kind", "unit"], "_n", shares, seed)
    placed = units.join(folds, ["unit_kind", "unit"]).select(F.col("_row"), F.col("fold").alias("_fold"))
    return df.join(placed, df[row] == placed["_row"]).withColumn("fold", F.col("_fold")).drop("_row", "_fold")


def split_pool(df: DataFrame, strategy: str, shares: dict[str, float], row: str, protein: str, scaffold: str, year: str, seed: int = 42) -> DataFrame:
    """Partition by a named strategy: ``protein``, ``scaffold``, ``double-cold``, ``time`` or ``time-protein``."""
    names = list(shares)
    if strategy == "protein":
        return cold_split(df, protein, shares, seed)
    if strategy == "scaffold":
        return cold_split(df, scaffold, shares, seed)
    if strategy == "double-cold":
        return double_cold_split(df, row, protein, scaffold, shares, seed)
    if strategy == "time":
        held = shares[names[-1]]
        mid = shares[names[1]] if len(names) > 2 else 0.0
        got = time_split(df, year, year_cutoffs(df, year, mid, held), with_val=len(names) > 2)
        return got.withColumn("fold", F.when(F.col("fold") == "test", names[-1]).when(F.col("fold") == "val", names[1]).otherwise(names[0]))
    if strategy == "time-protein":
        least = int(max(1, shares[names[-1]] * df.count()))
        got = time_protein_split(df, protein, year, 1, least)
        return got.withColumn("fold", F.when(F.col("fold") == "val", names[-1]).otherwise(names[0]))
    raise ValueError(f"unknown strategy {strategy!r}")


def nested_split(df: DataFrame, test_by: str, val_by: str, val: float, test: float, row: str, protein: str, scaffold: str, year: str, seed: int = 42) -> DataFrame:
    """All columns and ``fold``: test is carved first, then validation from the rest, by its own strategy.

    Equal strategies are one joint partition. The validation share is of all rows, so it is scaled up for the
    smaller pool, to 0.99 at most.
    """
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("shares must be at least 0 and sum to less than 1")
    args = (row, protein, scaffold, year)
    if test_by == val_by and test_by != "time-protein":
        return split_pool(df, test_by, {"train": 1 - val - test, "val": val, "test": test}, *args, seed)
    one = cut(split_pool(df, test_by, {"train": 1 - test, "test": test}, *args, seed), "outer")
    held, pool = one.where("fold = 'test'"), one.where("fold <> 'test'").drop("fold")
    n, size = df.count(), pool.count()
    share = min(max(val * n / size if size else 0.0, 0.0), 0.99)
    return split_pool(pool, val_by, {"train": 1 - share, "val": share}, *args, seed + 1).unionByName(held)


def check_partition(folds: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """One row of counts that are all zero for a complete and disjoint partition of ``rows``."""
    got = folds.groupBy(row).agg(F.count("*").alias("_n"), F.countDistinct("fold").alias("_f"))
    all_rows = rows.select(row).distinct()
    j = all_rows.withColumn("_in", F.lit(True)).join(got, row, "full")
    return j.agg(F.count_if(F.col("_n") > 1).alias("n_repeated"), F.count_if(F.col("_f") > 1).alias("n_in_two_folds"), F.count_if(F.col("_n").isNull()).alias("n_missing"), F.count_if(F.col("_in").isNull()).alias("n_unknown"))


def usable_holdout(folds: DataFrame, share: float) -> DataFrame:
    """Whether a holdout will do: both sides there, at least a quarter of what was asked, no more than train."""
    n, v = F.count("*"), F.count_if(F.col("fold") == "val")
    ok = (n - v > 0) & (v >= F.greatest(F.lit(1), F.floor(n * (0.25 * share)))) & (n - v >= v)
    return folds.agg(n.alias("n"), v.alias("n_val"), ok.alias("usable"))


def holdout_cascade(df: DataFrame, share: float, row: str, protein: str, scaffold: str | None, year: str, seed: int = 42) -> tuple[str, DataFrame] | None:
    """Name and folds of the first holdout that will do: proteins first seen late, then double-cold, then cold proteins.

    Without scaffolds the second is left out. None where none will do, so a caller fits without early stopping.
    """
    n = df.count()
    least = max(1, int(share * n))
    ways = {"time-protein": lambda: time_protein_split(df, protein, year, 1, least)}
    shares = {"train": 1 - share, "val": share}
    if scaffold:
        ways["double-cold"] = lambda: double_cold_split(df, row, protein, scaffold, shares, seed)
    ways["protein"] = lambda: cold_split(df, protein, shares, seed)
    for name, make in ways.items():
        got = cut(make(), "holdout")
        if usable_holdout(got, share).first()["usable"]:
            return name, got
    return None


# Ready-made splits under their plain names.


def train_test_split(df: DataFrame, row: str, protein: str, scaffold: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    return double_cold_split(df, row, protein, scaffold, {"train": 1 - test, "test": test}, seed)


def train_val_test_split(df: DataFrame, row: str, protein: str, scaffold: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    return double_cold_split(df, row, protein, scaffold, {"train": 1 - val - test, "val": val, "test": test}, seed)


def percent_time_split(df: DataFrame, year: str, val: float = 0.1, test: float = 0.1) -> DataFrame:
    return time_split(df, year, year_cutoffs(df, year, val, test))


def scaffold_train_test_split(df: DataFrame, scaffold: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    return cold_split(df, scaffold, {"train": 1 - test, "test": test}, seed)
