"""Writers: checked publishing of tables, predictions, vocabularies, folds bound to a signature."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import PREPARED, SHORT, file_system


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> int:
    """Write beside ``path``, check what was written, then rename it into place; returns its rows.

    The old table is renamed aside before the new one is renamed in and deleted after, so at every moment one of
    them is whole; :func:`recover` puts the old one back where a run died in between. A failed check leaves the old one.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    staged, aside = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs, s = file_system(spark, staged)
    _, p = file_system(spark, path)
    _, a = file_system(spark, aside)
    try:
        df.write.option("compression", "zstd").parquet(staged)
        back = spark.read.parquet(staged)
        if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the written schema differs")
        if check:
            check(back)
        n = back.count()
        if fs.exists(p) and not fs.rename(p, a):
            raise OSError(f"cannot move {path} aside")
        if not fs.rename(s, p):
            if fs.exists(a):
                fs.rename(a, p)
            raise OSError(f"cannot rename {staged} to {path}")
        fs.delete(a, True)
        return n
    finally:
        fs.delete(s, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back an old table that a run left aside before it could rename the new one in, and delete leftovers of tables
    that are in place; whether a table is there afterwards. Not for use while another run publishes the same path."""
    path = path.rstrip("/")
    fs, p = file_system(spark, path)
    parent, name = p.getParent(), p.getName()
    if not fs.exists(parent):
        return False
    left = sorted([(f.getModificationTime(), f.getPath()) for f in fs.listStatus(parent) if f.getPath().getName().startswith(f"{name}.old-")], key=lambda x: x[0])
    for _, old in reversed(left):
        if fs.exists(p):
            fs.delete(old, True)
        else:
            fs.rename(old, p)
    return bool(fs.exists(p))


def resume(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows in the new schema, and the new rows whose key isn't there yet."""
    cast = old.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema])
    return cast.unionByName(new.join(old.select(key), key, "left_anti"))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many digits after the point; NaN and null as empty text."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f"%.{digits}f", c)).otherwise("")


def write_predictions(df: DataFrame, path: str, score: str = "p_active", digits: int = 4) -> None:
    df.withColumn(score, fixed(F.col(score), digits)).write.mode("overwrite").csv(path, header=True)


def predictions_path(path: str, suffix: str = "_predictions") -> str:
    stem, ext = os.path.splitext(path)
    return f"{stem}{suffix}{ext}"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on any file system, written beside and renamed into place."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    fs, s = file_system(spark, staged)
    out = fs.create(s)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, p = file_system(spark, path)
    fs.delete(p, False)
    if not fs.rename(s, p):
        raise OSError(f"cannot rename {staged} to {path}")


def write_vocabulary(vocab: DataFrame, path: str, **meta: object) -> None:
    """Labels in order with their counts, as JSON, renamed into place; one text, so for vocabularies capped by their builder."""
    rows = vocab.orderBy("idx").collect()
    text = json.dumps({"labels": [r.label for r in rows], "size": len(rows), "active_counts": {r.label: r.n_active for r in rows}, **meta})
    write_text(vocab.sparkSession, text, path)


def write_json_cache(spark: SparkSession, cache: dict[str, object], path: str) -> None:
    """A JSON key-value cache, sorted by key."""
    write_text(spark, json.dumps(cache, sort_keys=True, default=str), path)


def prepared(df: DataFrame) -> DataFrame:
    """The thirteen columns of the prepared table under their own names and types, missing ones null."""
    by = {long: short for long, short in SHORT.items()}
    return df.select(*[(F.col(by[f.name]) if by[f.name] in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PREPARED])


def write_prepared(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> int:
    """Publish the prepared table with its fixed schema; returns its rows."""
    return publish(prepared(df), path, check)


def write_proteins(df: DataFrame, path: str) -> int:
    """Publish the protein sidecar ``(sequence, target_id, name, organism, families)``, one row per sequence."""

    def one_each(back: DataFrame) -> None:
        if not back.groupBy("sequence").count().where("count > 1").isEmpty():
            raise ValueError("a sequence occurs twice in the protein table")

    return publish(df.select("sequence", "target_id", "name", "organism", "families"), path, one_each)


def write_label_sets(df: DataFrame, path: str, ligand: str = "ligand") -> int:
    """Publish ligands with their label lists ``(ligand, families, targets, year)``."""
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("families", "targets")]
    return publish(df.select(ligand, *lists, F.col("year").cast("int").alias("year")), path)


def write_label_scores(scored: DataFrame, path: str, key: str, probs: str, vocab: list[str]) -> None:
    """One column per label of the vocabulary, six digits each; vocabularies are capped by their builder."""
    cells = [fixed(F.element_at(probs, i + 1), 6).alias(label) for i, label in enumerate(vocab)]
    scored.select(key, *cells).write.mode("overwrite").csv(path, header=True)


def write_top_labels(top: DataFrame, path: str, key: str, k: int) -> None:
    """``key, label_1, score_1 ... label_k, score_k`` from ``(key, rank, label, p)``; a short list leaves blanks."""
    by = top.groupBy(key).pivot("rank", list(range(1, k + 1))).agg(F.first("label").alias("label"), F.first("p").alias("score"))
    cells = [c for i in range(1, k + 1) for c in (F.coalesce(F.col(f"{i}_label"), F.lit("")).alias(f"label_{i}"), fixed(F.col(f"{i}_score"), 6).alias(f"score_{i}"))]
    by.select(key, *cells).write.mode("overwrite").csv(path, header=True)


def write_label_metrics(per_label: DataFrame, path: str) -> None:
    """Per-label metrics, most positives first, six digits."""
    cells = [fixed(F.col(c), 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in per_label.dtypes]
    per_label.orderBy(F.desc("n_pos"), per_label.columns[0]).select(*cells).write.mode("overwrite").csv(path, header=True)


def hits_markdown(hits: DataFrame, columns: list[str], digits: int = 4) -> str:
    """A Markdown table of a hit list, which is as long as its k."""
    rows = hits.select(*columns).collect()
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]])


def signature(config: dict[str, object]) -> str:
    """Sixteen hexadecimal digits that name a configuration."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def folds_once(spark: SparkSession, folder: str, config: dict[str, object], make: Callable[[], DataFrame], n_rows: int | None = None) -> DataFrame:
    """Folds kept under the signature of what they were made from: read if there, else made and published.

    With ``n_rows`` folds of another number of rows are an error.
    """
    path = f"{folder.rstrip('/')}/{signature(config)}.parquet"
    if not recover(spark, path):
        publish(make(), path)
    got = spark.read.parquet(path)
    if n_rows is not None and got.count() != n_rows:
        raise ValueError(f"folds at {path} are not those of {n_rows} rows")
    return got
