import pytest
from pyspark.sql import functions as F

from tessera.functions import ligands, smiles
from tessera.operators import features, models
from tessera.sources import readers, writers
from tessera.streaming.score import score_new_files


def test_prepared_csv_and_parquet(spark, tmp_path):
    head = ",".join(f'"{c}"' for c in [*readers.PREPARED_COLUMNS, "Year"])
    line = '"CCO","A ""b"" target","Human","","25","","","","","7.4","25.00 C","MK\nT",2019'
    (tmp_path / "p.csv").write_text(f"{head}\n{line}\n")
    df = readers.read_prepared(spark, str(tmp_path / "p.csv"))
    r = df.first()
    assert (r.ligand_smiles, r.target_name, r.ic50_nm, r.target_chain_sequence, r.year) == ("CCO", 'A "b" target', "25", "MK\nT", 2019)
    spark.read.schema(readers.PREPARED).csv(str(tmp_path / "p.csv"), header=True, multiLine=True, escape='"').write.parquet(str(tmp_path / "p.parquet"))
    assert readers.read_prepared(spark, str(tmp_path / "p.parquet")).collect() == df.collect()


def test_lists(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO name\n\n  c1ccccc1\tx\n")
    assert [r.smiles for r in readers.read_ligands(spark, str(tmp_path / "a.smi")).collect()] == ["CCO", "c1ccccc1"]
    assert [r.smiles for r in readers.read_ligands(spark, " CCN ").collect()] == ["CCN"]
    (tmp_path / "a.csv").write_text("id, SMILES \n1,CC\n2,\n")
    assert [r.smiles for r in readers.read_ligands(spark, str(tmp_path / "a.csv")).collect()] == ["CC"]
    (tmp_path / "b.csv").write_text("id\n1\n")
    with pytest.raises(ValueError):
        readers.read_ligands(spark, str(tmp_path / "b.csv"))


@pytest.mark.parametrize(
    ("text", "want"),
    [(">a\nMK\nTA\n\n>b\r\nGG\n", ["MKTA", "GG"]), ("MK\n TA \n", ["MKTA"]), (">only\n", []), ("AA\n>x\nBB", ["AA", "BB"]), ("", [])],
)
def test_fasta(spark, tmp_path, text, want):
    (tmp_path / "x.fasta").write_text(text)
    assert [r.sequence for r in readers.read_proteins(spark, str(tmp_path / "x.fasta")).orderBy("sequence").collect()] == sorted(want)


def test_library(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("ligand_id\tLigand SMILES\tdataset\n1\tCC\td\n2\t \td\n")
    assert [tuple(r) for r in readers.read_library(spark, str(tmp_path / "l.tsv")).collect()] == [("CC", "d", "1")]


def test_publish_and_resume(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    assert writers.publish(one, path) == 2

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        writers.publish(one.limit(1), path, refuse)
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1
    new = spark.createDataFrame([(2, "x", 5), (3, "y", 6)], "id int, v string, w int")
    assert sorted((r.id, r.v, r.w) for r in writers.resume(spark.read.parquet(path), new, "id").collect()) == [(1, "a", None), (2, "b", None), (3, "y", 6)]


def test_vocabulary_and_folds(spark, tmp_path):
    v = spark.createDataFrame([(1, "b", 2), (0, "a", 3)], "idx int, label string, n_active bigint")
    writers.write_vocabulary(v, str(tmp_path / "v.json"))
    assert sorted(map(tuple, readers.read_vocabulary(spark, str(tmp_path / "v.json")).collect())) == [(0, "a", 3), (1, "b", 2)]
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([(1, "train")], "row_id bigint, fold string")

    for seed in (1, 1, 2):
        writers.folds_once(spark, str(tmp_path / "folds"), {"seed": seed}, make)
    assert len(calls) == 2


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456), (2, float("nan")), (3, None)], "id int, p_active double")
    writers.write_predictions(df, str(tmp_path / "o"))
    assert sorted(r.p_active or "" for r in spark.read.csv(str(tmp_path / "o"), header=True).collect()) == ["", "", "0.1235"]
    assert writers.predictions_path("/x/a.csv") == "/x/a_predictions.csv"


def test_ligand_functions(spark):
    df = spark.createDataFrame([(1, "c1ccccc1CC"), (2, "CCc1ccccc1"), (3, "CCCC"), (4, "C("), (5, None), (6, "c1ccccc1C(=O)c1ccncc1"), (7, "O=C(C1=CC=CC=C1)c1ccncc1.Cl")], "id bigint, s string")
    got = {r.id: r for r in ligands.scaffold_group(ligands.over_distinct(df, "s", "k", ligands.ligand_key), "s", "id").collect()}
    assert got[1].k == got[2].k != got[3].k and got[4].k is None and got[6].k == got[7].k
    assert got[1].scaffold == got[2].scaffold != got[6].scaffold == got[7].scaffold
    assert {got[i].scaffold for i in (3, 4, 5)} == {"__orphan_3", "__orphan_4", "__orphan_5"}
    a, b = smiles.circular_bits(["CCO", "OCC"])
    assert a == b and all(0 <= x < 2048 for x in a) and smiles.circular_bits([None, "C("]) == [None, None]
    assert smiles.scaffold_keys(["Cc1ccccc1", "c1ccccc1"])[0] == smiles.scaffold_keys(["c1ccccc1"])[0]


def test_stream_scores_each_file_once(spark, tmp_path):
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame([(1, 2.0)], "id bigint, x double").write.parquet(src)
    args = (spark, src, "id bigint, x double", lambda d: d.withColumn("p", F.col("x") * 2), out, progress)
    assert score_new_files(*args).count() == 1
    spark.createDataFrame([(2, 3.0)], "id bigint, x double").write.mode("append").parquet(src)
    assert sorted((r.id, r.p) for r in score_new_files(*args).collect()) == [(1, 4.0), (2, 6.0)]
    assert score_new_files(*args).count() == 2


def test_models(spark):
    rows = [(i, [float(i % 2), float(i % 3)], i % 2, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, y int, g int")
    fitted = {k: models.fit(df, k, 2, **o) for k, o in (("linear", {}), ("forest", {"numTrees": 5}), ("layers", {"hidden": (4,)}))}
    for m in fitted.values():
        assert all((r.p_active > 0.5) == (r.y == 1) for r in models.score(m, df).collect())
    assert models.select_by_macro(df, fitted, "g")[1] == 1.0
    weighted = models.fit(df.withColumn("weight", F.lit(2.0)), "linear", 2)
    assert models.score(weighted, df).count() == 60
    with pytest.raises(ValueError):
        models.build("other", 2)


def test_cache_and_scaling(spark):
    want = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "e string")
    cached = spark.createDataFrame([("a",)], "e string").select(F.sha1(F.col("e").cast("binary")).alias("key"), F.lit(1).alias("v"))
    full = features.fill_cache(want, cached, "e", "key", lambda m: m.select("key", F.lit(2).alias("v")))
    assert sorted(r.v for r in full.collect()) == [1, 2]
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    assert sorted(r.x for r in features.standardize(df, "x", features.column_stats(df, "x")).collect()) == [[-1.0, 0.0], [1.0, 0.0]]
