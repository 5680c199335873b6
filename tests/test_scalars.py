import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import prepare


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "cells"),
    [
        (S.temperature, {"25.00 C": 25.0, "37c": 37.0, " -80 ": -80.0, "101": None, "": None, None: None, "abc": None, "1d": None, "1e400": None}),
        (S.ph, {"7.4": 7.4, "14": 14.0, "14.01": None, "-1": None, "nan": None}),
        (S.activity_nm, {"5": 5.0, ">5": None, "0": None, "1e3": 1000.0, "1_000": None, "-3": None, "inf": None, "+2.": 2.0}),
        (S.activity_label, {"Y": 1, "0.0": 0, "inactive": 0, "1.00": 1, "0e0": 0, "2": None, "": None, None: None}),
        (S.activity_class, {"Yes": 1, "N": 0, "1.0": None}),
        (S.year, {"2019.7": 2019, "1899": None, "2100": 2100, "x": None}),
    ],
)
def test_cells(spark, function, cells):
    df = spark.createDataFrame([(k,) for k in cells], "c string")
    assert {r.c: r.x for r in df.select("c", function(F.col("c")).alias("x")).collect()} == cells


@pytest.mark.parametrize(("nm", "want"), [(1, 0), (9.99, 0), (10, 1), (99.9, 1), (100, 2), (999, 2), (1000, 3), (9999, 3), (10000, 4), (1e6, 4)])
def test_bins(spark, nm, want):
    assert value(spark, S.potency_bin(F.lit(float(nm)))) == want


def test_numbers(spark):
    assert value(spark, S.significant(F.lit(123456.5))) == 123456.0
    assert value(spark, S.significant(F.lit(0.00012345678))) == pytest.approx(0.000123457)
    assert value(spark, S.pchembl_to_nm(S.pactivity(F.lit(50.0)))) == pytest.approx(50.0)
    assert value(spark, S.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    assert value(spark, S.sigmoid(F.lit(-900.0), 50.0)) == pytest.approx(1 / (1 + math.exp(50)))


@pytest.mark.parametrize(("text", "want"), [("A->B->C;D->E", ["B", "E"]), ("A-> ->C", ["C"]), ("nan", []), (None, []), ("A", []), ("", [])])
def test_paths(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(S.path_tokens(F.col("c"), 2).alias("x")).first().x == want


def wide(spark, **cells):
    base = {c: "" for c in ("ic50_nm", "ec50_nm", "ki_nm", "kd_nm", "other_nm")} | cells
    return spark.createDataFrame([(1, *base.values())], "pair_id bigint, " + ", ".join(f"{c} string" for c in base))


def test_range_rows(spark):
    long = prepare.unpivot_assays(wide(spark, ic50_nm="25", ec50_nm="2500"), ["pair_id"])
    assert sorted((r.head_idx, r.y_bin) for r in prepare.range_rows(long.withColumn("activity_label", F.lit(None).cast("int")), "pair_id").collect()) == [(0, 1), (1, 3)]
    weak = prepare.unpivot_assays(wide(spark, other_nm="1000000"), ["pair_id"]).withColumn("activity_label", F.lit(0))
    assert prepare.range_rows(weak, "pair_id").count() == 0
    assert sorted((r.head_idx, r.y_bin, r.from_binary) for r in prepare.range_rows(weak, "pair_id", weak=True).collect()) == [(0, 4, True), (1, 4, True)]
    ki = prepare.unpivot_assays(wide(spark, ki_nm="10"), ["pair_id"]).withColumn("activity_label", F.lit(None).cast("int"))
    assert prepare.range_rows(ki, "pair_id").count() == 0
