"""Indexed snapshots of the pair table: whole numbers for ligands, proteins, scaffolds and assays, with their dimension tables.

A snapshot is a folder of Parquet tables and one manifest, which is written last and names the rows, the schema and the signature
of what the snapshot was made from. A snapshot without a manifest isn't one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.ligands import over_distinct, scaffold_key
from tessera.operators.prepare import dense_ids
from tessera.persist import cut
from tessera.sources.readers import exists, file_system, read_text
from tessera.sources.writers import signature, write_text

FORMAT = 1
#: Columns of the fact table that number rows of a dimension, and that dimension.
IDS = {"protein_ids": "proteins", "ligand_ids": "ligands", "scaffold_groups": "scaffolds"}


def index_rows(long: DataFrame, key: str = "pair_id", scaffold: Callable[[Column], Column] | None = scaffold_key) -> dict[str, DataFrame]:
    """``rows``, ``proteins``, ``ligands`` and ``scaffolds`` from the long prepared table.

    Sequences, SMILES and scaffolds are numbered in the order they are first seen; a ligand without scaffold has group -1, and
    without ``scaffold`` there are no groups. A row is labelled by its explicit label, else by its potency.
    """
    base = long.withColumn("row_id", F.col(key) * len(S.ASSAYS) + F.col("assay_order"))
    proteins = cut(dense_ids(base, "sequence", "row_id", "protein_ids").select("protein_ids", "sequence"), "proteins")
    ligands = dense_ids(base, "smiles", "row_id", "ligand_ids").select("ligand_ids", "smiles")
    ligands = cut(over_distinct(ligands, "smiles", "_key", scaffold) if scaffold else ligands.withColumn("_key", F.lit(None).cast("string")), "ligands")
    scaffolds = cut(dense_ids(ligands, "_key", "ligand_ids", "scaffold_groups").select("scaffold_groups", F.col("_key").alias("scaffold")), "scaffolds")
    ligands = ligands.join(scaffolds.withColumnRenamed("scaffold", "_key"), "_key", "left").select("ligand_ids", "smiles", F.coalesce("scaffold_groups", F.lit(-1)).cast("bigint").alias("scaffold_groups"))
    j = base.join(proteins, "sequence").join(ligands, "smiles")
    label = S.labelled_active(F.col("activity_label"), F.col("pactivity"))
    assay = F.array_position(F.array(*[F.lit(a) for a in S.ASSAYS]), F.col("assay_type")) - 1
    rows = j.select("row_id", "protein_ids", "ligand_ids", label.cast("int").alias("activity_labels"), "scaffold_groups", F.coalesce("year", F.lit(-1)).cast("int").alias("years"), assay.cast("int").alias("assay_idx"), F.col("ph").cast("float").alias("ph"), F.col("temp").cast("float").alias("temp"))
    return {"rows": rows, "proteins": proteins, "ligands": ligands, "scaffolds": scaffolds}


def save(spark: SparkSession, tables: dict[str, DataFrame], path: str, made_from: dict[str, object]) -> None:
    """Write all tables beside, check their numbers, write the manifest last, then rename the folder into place.

    The old snapshot is renamed aside before and deleted after.
    """
    path = path.rstrip("/")
    side, aside = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs, s = file_system(spark, side)
    try:
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{side}/{name}")
        written = {n: spark.read.parquet(f"{side}/{n}") for n in tables}
        check_ids(written)
        entry = {n: {"rows": df.count(), "schema": df.schema.simpleString()} for n, df in written.items()}
        write_text(spark, json.dumps({"format": FORMAT, "signature": signature(made_from), "tables": entry}), f"{side}/manifest.json")
        _, p = file_system(spark, path)
        _, a = file_system(spark, aside)
        if fs.exists(p) and not fs.rename(p, a):
            raise OSError(f"cannot move {path} aside")
        if not fs.rename(s, p):
            raise OSError(f"cannot rename {side} to {path}")
        fs.delete(a, True)
    finally:
        fs.delete(s, True)


def check_ids(tables: dict[str, DataFrame]) -> None:
    """Every number of the fact table lies within its dimension, which is numbered without gaps from 0."""
    for column, dim in IDS.items():
        if dim not in tables:
            continue
        n, low, high = tables[dim].agg(F.count("*"), F.min(column), F.max(column)).first()
        if n and (low, high) != (0, n - 1):
            raise ValueError(f"{dim} are numbered {low} to {high} but are {n}")
        wrong = tables["rows"].where((F.col(column) >= n) | (F.col(column) < (-1 if column == "scaffold_groups" else 0)) | F.col(column).isNull())
        if not wrong.isEmpty():
            raise ValueError(f"{column} out of range")


def load(spark: SparkSession, path: str, made_from: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, checked against its manifest: format, signature if given, schema and rows of each."""
    path = path.rstrip("/")
    if not exists(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"no snapshot at {path}")
    m = json.loads(read_text(spark, f"{path}/manifest.json"))
    if m["format"] != FORMAT:
        raise ValueError(f"snapshot of format {m['format']}, not {FORMAT}")
    if made_from is not None and m["signature"] != signature(made_from):
        raise ValueError("snapshot was made from something else")
    out = {}
    for name, entry in m["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.schema.simpleString() != entry["schema"] or df.count() != entry["rows"]:
            raise ValueError(f"table {name} isn't what the manifest says")
        out[name] = df
    return out


def ensure(spark: SparkSession, path: str, made_from: dict[str, object], make: Callable[[], dict[str, DataFrame]], rebuild: bool = False) -> dict[str, DataFrame]:
    """The snapshot if there is one that fits, else a new one; a stale one is an error, or is built anew with ``rebuild``."""
    try:
        return load(spark, path, made_from)
    except FileNotFoundError:
        pass
    except ValueError:
        if not rebuild:
            raise
    save(spark, make(), path, made_from)
    return load(spark, path, made_from)


def view(tables: dict[str, DataFrame], folds: DataFrame | None = None, fold: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The fact rows of a fold, with the columns asked for; nothing is read until it is used."""
    rows = tables["rows"]
    if fold is not None and folds is not None:
        rows = rows.join(folds.where(F.col("fold") == fold).select("row_id"), "row_id", "left_semi")
    return rows.select("row_id", *[c for c in columns if c != "row_id"]) if columns else rows
