import random

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main


def test_index_split_and_labels(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"{'C' * rng.randint(1, 9)}c1ccccc1{'N' * (i % 3)}", f"T{i % 30}", "M" + "KLV"[i % 3] * (1 + i % 30), str(rng.choice([5, 50000])), 2000 + i % 20) for i in range(200)]
    spark.createDataFrame(rows, "a string, b string, c string, d string, e int").toDF("Ligand SMILES", "Target Name", "BindingDB Target Chain Sequence 1", "Ki (nM)", "Year").withColumns({c: F.lit(None).cast("string") for c in ("IC50 (nM)", "Kd (nM)", "EC50 (nM)", "Other (nM)", "Activity Label", "pH", "Temp (C)")}).write.parquet(f"{tmp_path}/pairs.parquet")
    made = main(["index", f"{tmp_path}/pairs.parquet", f"{tmp_path}/snap"], spark)
    assert made["rows"] == 200 and made["proteins"] <= 90
    assert main(["index", f"{tmp_path}/pairs.parquet", f"{tmp_path}/snap"], spark) == made
    got = main(["split", f"{tmp_path}/snap", f"{tmp_path}/folds", "--test-by", "protein", "--val-by", "protein", "--val", "0.2", "--test", "0.2"], spark)
    assert sum(got.values()) == 200 and set(got) == {"train", "val", "test"}
    spark.createDataFrame([(i, f"T{i}", ["F"]) for i in range(100)], "protein_ids bigint, target string, families array<string>").write.parquet(f"{tmp_path}/prot.parquet")
    assert main(["label-sets", f"{tmp_path}/snap/rows", f"{tmp_path}/prot.parquet", f"{tmp_path}/labels", "--least", "1"], spark)["ligands"] > 0
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_train_grid_predict(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.random(), rng.random()], ("train", "train", "val", "test")[i % 4], i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<double>, fold string, group int").withColumn("y", (F.get("x", F.lit(0)) > 0.5).cast("int"))
    df.write.parquet(f"{tmp_path}/t.parquet")
    got = main(["train", f"{tmp_path}/t.parquet", f"{tmp_path}/model", "--options", '{"numTrees": 5}'], spark)
    assert {r["fold"] for r in got} == {"val", "test"} and all(r["auroc"] > 0.9 and r["macro_auroc"] > 0.8 for r in got)
    best = main(["grid", f"{tmp_path}/t.parquet", '{"forest": {"numTrees": [3, 5]}, "linear": {"regParam": [0.01]}}'], spark)
    assert best["macro_auroc"] > 0.8
    df.select("id", F.when(F.col("id") > 3, F.col("x")).alias("x")).write.parquet(f"{tmp_path}/new.parquet")
    out = main(["predict", f"{tmp_path}/model", f"{tmp_path}/new.parquet"], spark)["out"]
    assert out.endswith("new_predictions.csv")
    back = spark.read.csv(out, header=True)
    assert back.count() == 200 and back.where("p_active is null").count() == 4
