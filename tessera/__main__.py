"""Command line: build, label, index, split, train, search and predict over tables on any file system Spark reads."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import build, folds, models, prepare, vocab
from tessera.persist import drop_all
from tessera.sources import readers, snapshots, writers


def _vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """A table of ``(x, y, ...)`` and the width of its vectors."""
    first = df.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows")
    return df, first.n


def build_pairs(spark: SparkSession, a: argparse.Namespace) -> object:
    """Export rows joined with their proteins, published as pairs."""
    made = prepare.gpcr_pairs(readers.limited(spark.read.parquet(a.raw), a.limit, "row_id"), spark.read.parquet(a.proteins))
    return {"rows": writers.publish(made, a.out)}


def build_flagged(spark: SparkSession, a: argparse.Namespace) -> object:
    """Rows with type flags as one row per activity, those without class first, up to a shared limit."""
    rows = build.activity_rows(spark.read.parquet(a.raw), [a.key, "activity_class"])
    return {"rows": writers.publish(build.passes(rows, "activity_class", [a.key, "item"], a.limit), a.out)}


def label_sets(spark: SparkSession, a: argparse.Namespace) -> object:
    """Label lists of the active ligands, and the vocabulary of their targets."""
    sets = vocab.label_sets(spark.read.parquet(a.rows).where("activity_labels = 1"), spark.read.parquet(a.proteins), "ligand_ids", "protein_ids", "years")
    n = writers.write_label_sets(sets.withColumnRenamed("ligand_ids", "ligand"), f"{a.out.rstrip('/')}/ligands.parquet")
    writers.write_vocabulary(vocab.vocabulary(sets, "targets", a.least, a.top), f"{a.out.rstrip('/')}/targets.json")
    return {"ligands": n}


def index(spark: SparkSession, a: argparse.Namespace) -> object:
    """The prepared pair table as a snapshot of numbered rows."""
    long = prepare.prepared_long(readers.read_prepared(spark, a.pairs).withColumn("pair_id", F.monotonically_increasing_id()))
    made = snapshots.ensure(spark, a.out, {"pairs": a.pairs}, lambda: snapshots.index_rows(long), rebuild=a.rebuild)
    return {n: df.count() for n, df in made.items()}


def split(spark: SparkSession, a: argparse.Namespace) -> object:
    """Folds of a snapshot, kept under the signature of what was asked for."""
    rows = snapshots.load(spark, a.snapshot)["rows"]
    config = {"snapshot": a.snapshot, "test": a.test_by, "val": a.val_by, "shares": [a.val, a.test], "seed": a.seed}
    make = lambda: folds.nested_split(rows, a.test_by, a.val_by, a.val, a.test, "row_id", "protein_ids", "scaffold_groups", "years", a.seed).select("row_id", "fold")
    got = writers.folds_once(spark, a.out, config, make, rows.count())
    return {r.fold: r["count"] for r in got.groupBy("fold").count().collect()}


def train(spark: SparkSession, a: argparse.Namespace) -> object:
    """Fit on the fold ``train`` of ``(x, y, fold, group)`` and report the others."""
    df, width = _vectors(spark.read.parquet(a.table))
    model = models.fit_on_fold(df, a.kind, width, **json.loads(a.options))
    models.save(model, a.out)
    return [r.asDict() for r in models.evaluate_folds(df, model, a.group).collect()]


def grid(spark: SparkSession, a: argparse.Namespace) -> object:
    """The best of a grid of models by the fold ``val``."""
    df, width = _vectors(spark.read.parquet(a.table))
    kind, options, score = models.grid_search(df, json.loads(a.grid), width, a.group)
    return {"kind": kind, "options": options, "macro_auroc": score}


def predict(spark: SparkSession, a: argparse.Namespace) -> object:
    """Scores of a table of vectors, as CSV beside it unless a place is named."""
    df = spark.read.parquet(a.table)
    scored = models.score(models.load(a.model), df.where("x is not null")).unionByName(df.where("x is null").withColumn("p_active", F.lit(float("nan"))))
    out = a.out or writers.predictions_path(a.table.rstrip("/").removesuffix(".parquet") + ".csv")
    writers.write_predictions(scored.drop("x"), out)
    return {"out": out}


COMMANDS = {
    "build-pairs": (build_pairs, ["raw", "proteins", "out"], {"limit": None}),
    "build-flagged": (build_flagged, ["raw", "out"], {"key": "pair_id", "limit": None}),
    "label-sets": (label_sets, ["rows", "proteins", "out"], {"least": 5, "top": 512}),
    "index": (index, ["pairs", "out"], {"rebuild": False}),
    "split": (split, ["snapshot", "out"], {"test_by": "double-cold", "val_by": "double-cold", "val": 0.1, "test": 0.1, "seed": 42}),
    "train": (train, ["table", "out"], {"kind": "forest", "options": "{}", "group": "group"}),
    "grid": (grid, ["table", "grid"], {"group": "group"}),
    "predict": (predict, ["model", "table"], {"out": None}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (f, places, options) in COMMANDS.items():
        one = sub.add_parser(name, help=f.__doc__)
        for p in places:
            one.add_argument(p)
        for o, default in options.items():
            flag = f"--{o.replace('_', '-')}"
            if isinstance(default, bool):
                one.add_argument(flag, action="store_true")
            else:
                one.add_argument(flag, default=default, type=int if o in ("limit", "least", "top", "seed") else type(default) if default is not None else str)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> object:
    """Run one command; what it reports is printed as JSON and returned."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    try:
        got = COMMANDS[a.command][0](spark, a)
    finally:
        drop_all(spark)
    print(json.dumps(got, default=str))
    return got


if __name__ == "__main__":
    main()
