"""Ligand functions over columns; each distinct text is read once and joined back.

The full chemistry of an outside toolkit (its canonical text, fingerprint bits, descriptors) can be had by passing
a function of one's own to :func:`over_distinct`; without one, these native versions are used and named as such.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType

from tessera.functions import smiles
from tessera.functions.scalars import tokens_of


def _hex(keys: list[tuple[int, int] | None]) -> pa.Array:
    mask = (1 << 64) - 1
    return pa.array([None if k is None else f"{k[0] & mask:016x}{k[1] & mask:016x}" for k in keys], pa.string())


@F.arrow_udf(StringType())
def ligand_key(s: pa.Array) -> pa.Array:
    """One text per ligand however written, null where it can't be read."""
    return _hex(smiles.ligand_keys(s.to_pylist()))


@F.arrow_udf(StringType())
def scaffold_key(s: pa.Array) -> pa.Array:
    """One text per ring system with its linkers, null where there is none."""
    return _hex(smiles.scaffold_keys(s.to_pylist()))


@F.arrow_udf(ArrayType(IntegerType()))
def circular_bits(s: pa.Array) -> pa.Array:
    """Set positions of a 2048-bit circular fingerprint of radius 2."""
    return pa.array(smiles.circular_bits(s.to_pylist()), pa.list_(pa.int32()))


def over_distinct(df: DataFrame, column: str, out: str, function: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``out = function(column)``, the function called once per distinct value."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_in")).distinct()
    done = values.select("_in", function(F.col("_in")).alias(out))
    return df.join(done, df[column] == done["_in"], "left").drop("_in")


def scaffold_group(df: DataFrame, column: str, row: str, out: str = "scaffold") -> DataFrame:
    """``df`` with a scaffold per row; a ligand without one is a group of its own row, so such rows never merge."""
    got = over_distinct(df, column, "_scaffold", scaffold_key)
    return got.withColumn(out, F.coalesce("_scaffold", F.concat(F.lit("__orphan_"), F.col(row).cast("string")))).drop("_scaffold")


def canonical_stream(df: DataFrame, column: str, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(ligand)`` of each row that can be read, in a canonical form: the ligand key, or what ``canonical`` gives."""
    out = over_distinct(df, column, "ligand", canonical or ligand_key)
    return out.where("ligand is not null").select("ligand")


#: Ligand representations by name: columns of SMILES to arrays of floats.
REPRESENTATIONS: dict[str, Callable[[Column], Column]] = {}


def register(name: str, function: Callable[[Column], Column]) -> None:
    """Make a representation known under a name, such as an outside toolkit's fingerprint or descriptors."""
    REPRESENTATIONS[name.lower()] = function


@F.arrow_udf(ArrayType(FloatType()))
def circular_vector(s: pa.Array) -> pa.Array:
    """The 2048 bits of the circular fingerprint as zeros and ones."""
    rows = []
    for bits in smiles.circular_bits(s.to_pylist()):
        if bits is None:
            rows.append(None)
        else:
            v = np.zeros(2048, np.float32)
            v[bits] = 1.0
            rows.append(v)
    return pa.array(rows, pa.list_(pa.float32()))


register("circular", circular_vector)


def embedder(embed: Callable[[list[str]], np.ndarray], longest: int | None = None, batch: int = 64) -> Callable[[Column], Column]:
    """A representation from a model that maps texts to ``(texts, tokens, width)`` with NaN for padding: mean over tokens.

    Texts are cut to ``longest`` characters where one is given, embedded in batches sorted by length, and put back in
    order. ``embed`` is called in the workers and loads its model there.
    """

    @F.arrow_udf(ArrayType(FloatType()))
    def run(s: pa.Array) -> pa.Array:
        texts = s.to_pylist()
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        rows: list[np.ndarray | None] = [None] * len(texts)
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            got = np.nanmean(embed([texts[i][:longest] for i in part]), axis=1)
            for i, v in zip(part, got):
                rows[i] = v.astype(np.float32)
        return pa.array(rows, pa.list_(pa.float32()))

    return run


def represent(df: DataFrame, column: str, spec: str, out: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``out``: the named representations one behind the other, each distinct text computed once; null where one of
    them is. Numbers that aren't finite become 0. A name nobody registered is an error that says so."""
    names = tokens_of(spec, aliases)
    unknown = [n for n in names if n not in REPRESENTATIONS]
    if unknown:
        raise ValueError(f"no representation {unknown}: register a function from SMILES to floats under that name (known: {sorted(REPRESENTATIONS)})")
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_in")).distinct()
    parts = values.select("_in", *[REPRESENTATIONS[n](F.col("_in")).alias(f"_r{i}") for i, n in enumerate(names)])
    finite = F.transform(F.concat(*[F.col(f"_r{i}") for i in range(len(names))]), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0).cast("float")).otherwise(v))
    return df.join(parts.select("_in", finite.alias(out)), df[column] == F.col("_in"), "left").drop("_in")
