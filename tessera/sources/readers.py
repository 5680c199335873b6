"""Readers: prepared tables by suffix, ligand and protein lists, vocabularies, spreadsheets."""

from __future__ import annotations

import json
import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# The prepared table's columns and the names by which columns are found.
PREPARED_COLUMNS = [
    "Ligand SMILES", "Target Name", "Target Source Organism According to Curator or DataSource", "Ki (nM)", "IC50 (nM)", "Kd (nM)", "EC50 (nM)",
    "Other (nM)", "Activity Label", "pH", "Temp (C)", "BindingDB Target Chain Sequence 1",
]
PREPARED = StructType([StructField(c, StringType()) for c in PREPARED_COLUMNS] + [StructField("Year", IntegerType())])
SHORT = dict(zip(PREPARED_COLUMNS, ["ligand_smiles", "target_name", "target_organism", "ki_nm", "ic50_nm", "kd_nm", "ec50_nm", "other_nm", "activity_label", "ph", "temp_c", "target_chain_sequence"])) | {"Year": "year"}
SMILES_COLUMNS = ["ligand smiles", "smiles", "canonical_smiles", "canonical smiles"]
SEQUENCE_COLUMNS = ["bindingdb target chain sequence 1", "sequence", "protein sequence", "protein", "fasta", "target sequence"]
SPREADSHEETS, SMILES_FILES, SDF_FILES, FASTA_FILES = (".csv", ".tsv", ".xls", ".xlsx"), (".smi", ".smiles"), (".sdf",), (".fasta", ".fa", ".faa", ".fna", ".txt")
#: Largest workbook that is read on the driver; a workbook is one zipped file and can't be read in parts.
MOST_WORKBOOK_BYTES = 256 << 20


def extension(path: str) -> str:
    """The file extension in lower case."""
    return os.path.splitext(path.rstrip("/"))[1].lower()


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of a path, and the path for it; local, HDFS or object store alike."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, source: str) -> bool:
    """Whether the source names a file or folder; a text that can't be a path, such as a chain, doesn't."""
    if not source.strip() or "\n" in source or len(source) > 4096:
        return False
    try:
        fs, p = file_system(spark, source)
        return bool(fs.exists(p))
    except Exception:  # noqa: BLE001  any text that Hadoop won't take as a path is a literal
        return False


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...], skip: str = "_predictions") -> list[str]:
    """Files of a folder with one of the extensions, sorted, without those whose stem ends with ``skip``."""
    fs, p = file_system(spark, folder)
    names = [f.getPath() for f in fs.listStatus(p) if f.isFile()]
    paths = sorted(x.toString() for x in names if extension(x.getName()) in extensions)
    return [x for x in paths if not (skip and os.path.splitext(x)[0].endswith(skip))]


def limited(df: DataFrame, limit: int | None, order: str | None = None) -> DataFrame:
    """The first ``limit`` rows in ``order``, all without a limit; a non-positive limit is an error."""
    if limit is None:
        return df
    if limit <= 0:
        raise ValueError("a limit must be above 0")
    return (df.orderBy(order) if order else df).limit(limit)


def read_prepared(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A prepared table in short column names, Parquet by suffix, else CSV with header and quoted line breaks."""
    if path.rstrip("/").lower().endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        df = spark.read.schema(PREPARED).csv(path, header=True, multiLine=True, escape='"')
    return df.select(*[F.col(f"`{c}`").alias(SHORT[c]) for c in [*PREPARED_COLUMNS, "Year"] if c in df.columns]) if limit is None else limited(df.select(*[F.col(f"`{c}`").alias(SHORT[c]) for c in [*PREPARED_COLUMNS, "Year"] if c in df.columns]), limit)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet by suffix: CSV, TSV or Parquet in the cluster, XLS and XLSX on the driver."""
    suffix = extension(path)
    if suffix in (".csv", ".tsv"):
        return spark.read.csv(path, header=True, sep="\t" if suffix == ".tsv" else ",", multiLine=True, escape='"')
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if suffix in (".xlsx", ".xls"):
        import pandas as pd

        fs, p = file_system(spark, path)
        size = fs.getFileStatus(p).getLen()
        if size > MOST_WORKBOOK_BYTES:
            raise ValueError(f"workbook of {size} bytes; save it as CSV or Parquet to read it in the cluster")
        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    raise ValueError(f"unknown kind of table: {path}")


def find_column(df: DataFrame, names: list[str]) -> str | None:
    """The first column that has one of the names, letter case and outer blanks apart."""
    have = {}
    for c in df.columns:
        have[c.strip().lower()] = c
    return next((have[n] for n in names if n in have), None)


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """``(smiles)``: the first word of each line that has one."""
    first = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return spark.read.text(path).select(first.alias("smiles")).where("smiles <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(file, entry, sequence)``: lines under a header joined; a file without header is one sequence.

    Records are parted at ``>`` while the file is read, so a task holds records, not files. A ``>`` inside a line is part of
    the header it stands in.
    """
    text = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r\n?", "\n").alias("t"))
    started = text.select("file", "_block", "_id", F.regexp_replace("t", r"^\s*>", "").alias("_e"), ((F.col("_block") > 0) | F.col("t").rlike(r"^\s*>")).alias("_head"))
    first = Window.partitionBy("file").orderBy("_block", "_id")
    numbered = started.withColumn("entry", F.row_number().over(first) - 1)
    body = F.when((F.col("entry") == 0) & ~F.col("_head"), F.col("_e")).otherwise(F.regexp_replace("_e", r"^[^\n]*", ""))
    return numbered.select("file", "entry", F.regexp_replace(body, r"(?m)^\s+|\s+$|\n", "").alias("sequence")).where("sequence <> ''")


def fasta_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """The same for FASTA texts that are cells of a table."""
    entries = F.split(F.regexp_replace(F.concat(F.lit("\n"), F.col(text)), r"\n\s*>", "\n>"), r"\n>")
    parts = df.select(F.col(key), F.posexplode(entries).alias("entry", "_e"))
    body = F.when(F.col("entry") == 0, F.col("_e")).otherwise(F.regexp_replace("_e", r"^[^\n]*", ""))
    return parts.select(key, "entry", F.regexp_replace(body, r"(?m)^\s+|\s+$|\n", "").alias("sequence")).where("sequence <> ''")


def read_sdf(spark: SparkSession, path: str, smiles_tag: str = "SMILES") -> DataFrame:
    """``(file, smiles)`` of the molecules of an SDF file; records that can't be read are skipped.

    Records are parted at ``$$$$`` while the file is read. A record with a data field named ``smiles_tag`` gives that text,
    any other the SMILES written from its atom and bond block (version 2000; charges and stereo marks are left out).
    """
    from pyspark.sql.types import StringType as Text

    from tessera.functions.smiles import is_molecule, write_smiles

    @F.arrow_udf(Text())
    def to_smiles(blocks: pa.Array) -> pa.Array:
        out = []
        for block in blocks.to_pylist():
            text = _sdf_field(block, smiles_tag) or write_smiles(*(_sdf_graph(block) or ([], [])))
            out.append(text if text and is_molecule(text) else None)
        return pa.array(out, pa.string())

    records = spark.read.text(path, lineSep="$$$$").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"^\n", "").alias("_b")).where(F.trim("_b") != "")
    return records.select("file", to_smiles("_b").alias("smiles")).where("smiles is not null")


def _sdf_field(block: str, tag: str) -> str | None:
    lines = block.split("\n")
    for at, line in enumerate(lines[:-1]):
        if line.startswith(">") and f"<{tag}>" in line:
            return lines[at + 1].strip() or None
    return None


def _sdf_graph(block: str) -> tuple[list[str], list[tuple[int, int, int]]] | None:
    """Symbols and bonds ``(atom, atom, order)`` of a connection table, None where it has none that can be read."""
    lines = block.split("\n")
    at = next((i for i, x in enumerate(lines) if x.rstrip().endswith("V2000")), None)
    if at is None:
        return None
    try:
        n, m = int(lines[at][:3]), int(lines[at][3:6])
        symbols = [lines[at + 1 + i][31:34].strip() for i in range(n)]
        bonds = [(int(x[:3]) - 1, int(x[3:6]) - 1, int(x[6:9])) for x in lines[at + 1 + n : at + 1 + n + m]]
    except (ValueError, IndexError):
        return None
    return (symbols, bonds) if all(0 <= a < n and 0 <= b < n for a, b, _ in bonds) else None


def read_ligands(spark: SparkSession, source: str) -> DataFrame:
    """``(smiles)`` from a literal, a file by its extension, or all such files of a folder in the order of their names."""
    if not exists(spark, source):
        return spark.createDataFrame([(source.strip(),)], "smiles string")
    fs, p = file_system(spark, source)
    if fs.getFileStatus(p).isDirectory():
        files = list_files(spark, source, SPREADSHEETS + SMILES_FILES + SDF_FILES)
        if not files:
            raise ValueError(f"no ligand files in {source}")
        return reduce(lambda a, b: a.unionByName(b), [read_ligands(spark, f) for f in files])
    if extension(source) in SPREADSHEETS:
        df = read_table(spark, source)
        column = find_column(df, SMILES_COLUMNS)
        if column is None:
            raise ValueError(f"no SMILES column in {source}")
        return df.select(F.col(f"`{column}`").cast("string").alias("smiles")).where("smiles is not null")
    if extension(source) in SDF_FILES:
        return read_sdf(spark, source).select("smiles")
    return read_smiles(spark, source)


def read_proteins(spark: SparkSession, source: str) -> DataFrame:
    """``(sequence)`` from a literal or FASTA text, a file by its extension, or all such files of a folder."""
    if not exists(spark, source):
        return fasta_entries(spark.createDataFrame([(0, source)], "k int, t string"), "k", "t").select("sequence")
    fs, p = file_system(spark, source)
    if fs.getFileStatus(p).isDirectory():
        files = list_files(spark, source, SPREADSHEETS + FASTA_FILES)
        if not files:
            raise ValueError(f"no protein files in {source}")
        return reduce(lambda a, b: a.unionByName(b), [read_proteins(spark, f) for f in files])
    if extension(source) in SPREADSHEETS:
        df = read_table(spark, source)
        column = find_column(df, SEQUENCE_COLUMNS)
        if column is None:
            raise ValueError(f"no sequence column in {source}")
        return df.select(F.trim(F.col(f"`{column}`").cast("string")).alias("sequence")).where("sequence is not null")
    return read_fasta(spark, source).select("sequence")


def read_labels(spark: SparkSession, path: str, ligand: str = "smiles", labels: tuple[str, ...] = ("families", "targets")) -> DataFrame:
    """A ligand table with label lists; a missing column or a blank ligand is an error."""
    df = spark.read.parquet(path)
    missing = [c for c in (ligand, *labels) if c not in df.columns]
    if missing:
        raise ValueError(f"label table lacks columns {missing}")
    if not df.where(F.coalesce(F.trim(F.col(ligand)), F.lit("")) == "").isEmpty():
        raise ValueError("label table has rows without a ligand")
    return df


def read_protein_dimension(spark: SparkSession, path: str, fallback: str = "sequence string, target_id string, name string, organism string, families string") -> DataFrame:
    """The protein sidecar's five columns, the last row of each sequence; an empty table where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], fallback)
    names = [c.split()[0] for c in fallback.split(", ")]
    df = spark.read.parquet(path)
    placed = df.select(*names, F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("at")).alias("_at")).where("sequence is not null")
    best = placed.groupBy("sequence").agg(F.max_by(F.struct(*names[1:]), "_at").alias("_b"))
    return best.select("sequence", *[F.col(f"_b.{c}").alias(c) for c in names[1:]])


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """A screening library ``(smiles, dataset, ligand_id)`` from tab-parted text; rows without SMILES are dropped."""
    df = spark.read.csv(path, header=True, sep="\t")
    need = {"Ligand SMILES": "smiles", "dataset": "dataset", "ligand_id": "ligand_id"}
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"library lacks columns {missing}")
    return df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(n) for c, n in need.items()]).where("smiles <> ''")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any file system."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, label, n_active)`` from the JSON that write_vocabulary makes; its size must agree."""
    v = json.loads(read_text(spark, path))
    if v["size"] != len(v["labels"]):
        raise ValueError(f"vocabulary of {v['size']} has {len(v['labels'])} labels")
    counts = v.get("active_counts", {})
    return spark.createDataFrame([(i, x, counts.get(x)) for i, x in enumerate(v["labels"])], "idx int, label string, n_active bigint")


def read_json_cache(spark: SparkSession, path: str) -> dict[str, object]:
    """A JSON key-value cache; empty where there is none or it can't be read."""
    try:
        return json.loads(read_text(spark, path)) if exists(spark, path) else {}
    except ValueError:
        return {}
