import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import ligands
from tessera.functions import scalars as S
from tessera.functions.smiles import ligand_keys, parse, write_smiles
from tessera.operators import balance, features, prepare
from tessera.sources import readers, snapshots, writers


def test_column_order_decides(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sequence,BindingDB Target Chain Sequence 1,smiles,Ligand SMILES\nAA,CC,C,N\n")
    assert [r.smiles for r in readers.read_ligands(spark, str(tmp_path / "a.csv")).collect()] == ["N"]
    assert [r.sequence for r in readers.read_proteins(spark, str(tmp_path / "a.csv")).collect()] == ["CC"]


def test_folder_and_literals(spark, tmp_path):
    (tmp_path / "b.smi").write_text("CC x\n\nCCO\n")
    (tmp_path / "a.csv").write_text("smiles\nN\n")
    (tmp_path / "a_predictions.csv").write_text("smiles\nO\n")
    (tmp_path / "c.md").write_text("no")
    assert [r.smiles for r in readers.read_ligands(spark, str(tmp_path)).collect()] == ["N", "CC", "CCO"]
    assert readers.read_ligands(spark, " CCN ").first().smiles == "CCN"
    assert readers.read_proteins(spark, ">x\nMK\nLV\n").first().sequence == "MKLV"
    with pytest.raises(ValueError):
        readers.read_proteins(spark, _empty(tmp_path))
    with pytest.raises(ValueError):
        readers.limited(spark.range(3), 0)
    assert readers.limited(spark.range(9), 4, "id").count() == 4


def _empty(tmp_path):
    (tmp_path / "none").mkdir()
    return str(tmp_path / "none")


MOL = """benzyl
  x

  4  3  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 C   0  0
    0.0000    0.0000    0.0000 C   0  0
    0.0000    0.0000    0.0000 O   0  0
    0.0000    0.0000    0.0000 N   0  0
  1  2  1  0
  2  3  2  0
  2  4  1  0
M  END
"""


def test_sdf(spark, tmp_path):
    (tmp_path / "x.sdf").write_text(MOL + "$$$$\n" + MOL + ">  <SMILES>\nCCO\n\n$$$$\nbad\n\n\nnothing\n$$$$\n")
    got = [r.smiles for r in readers.read_sdf(spark, str(tmp_path / "x.sdf")).collect()]
    assert got[1:] == ["CCO"] and ligand_keys([got[0]]) == ligand_keys(["CC(=O)N"])


@pytest.mark.parametrize("text", ["CC(=O)Oc1ccccc1C(=O)O", "C1CCC2CCCCC2C1", "[Na].CC#N", "C1CC1C1CC1(C)C", "CC(C)(C)C1=CC=C(Br)C=C1"])
def test_written_smiles_read_back(text):
    from tessera.functions.smiles import ELEMENTS

    atoms, bonds, _ = parse(text)
    symbols = [ELEMENTS[a % 1000 - 1] for a in atoms]
    back = write_smiles(symbols, [(u, v, {0: 1, 1: 2, 2: 3}[o]) for u, v, o in bonds])
    a, b, _ = parse(back)
    assert sorted(x % 1000 for x in a) == sorted(x % 1000 for x in atoms) and len(b) == len(bonds)
    assert parse(write_smiles([], [])) is None


def test_publish_keeps_one_whole_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    assert writers.publish(spark.range(3), path) == 3
    with pytest.raises(RuntimeError):
        writers.publish(spark.range(9), path, lambda df: (_ for _ in ()).throw(RuntimeError("no")))
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.old-1")
    assert writers.recover(spark, path) and spark.read.parquet(path).count() == 3
    assert writers.publish(spark.range(5), path) == 5 and sorted(x.name for x in tmp_path.iterdir()) == ["t.parquet"]
    writers.folds_once(spark, str(tmp_path), {"a": 1}, lambda: spark.range(4), 4)
    with pytest.raises(ValueError):
        writers.folds_once(spark, str(tmp_path), {"a": 1}, lambda: spark.range(4), 5)


def test_tables_of_results(spark, tmp_path):
    wide = spark.createDataFrame([("CC", "T", "5", 2001)], "ligand_smiles string, target_name string, ki_nm string, year int")
    assert writers.write_prepared(wide, str(tmp_path / "p.parquet")) == 1
    assert spark.read.parquet(str(tmp_path / "p.parquet")).schema == readers.PREPARED
    two = spark.createDataFrame([("A", "t", "n", "o", "f")] * 2, "sequence string, target_id string, name string, organism string, families string")
    with pytest.raises(ValueError):
        writers.write_proteins(two, str(tmp_path / "s.parquet"))
    assert writers.write_proteins(two.limit(1), str(tmp_path / "s.parquet")) == 1
    assert readers.read_protein_dimension(spark, str(tmp_path / "s.parquet")).count() == 1 and readers.read_protein_dimension(spark, str(tmp_path / "none")).count() == 0
    sets = spark.createDataFrame([("C", ["F"], None, 2000)], "ligand string, families array<string>, targets array<string>, year bigint")
    assert writers.write_label_sets(sets, str(tmp_path / "l.parquet")) == 1
    assert readers.read_labels(spark, str(tmp_path / "l.parquet"), "ligand").first().targets == []
    with pytest.raises(ValueError):
        readers.read_labels(spark, str(tmp_path / "l.parquet"), "smiles")
    scored = spark.createDataFrame([("C", [0.25, float("nan")])], "k string, p array<double>")
    writers.write_label_scores(scored, str(tmp_path / "full"), "k", "p", ["a", "b"])
    assert spark.read.csv(str(tmp_path / "full"), header=True).first().asDict() == {"k": "C", "a": "0.250000", "b": None}
    top = spark.createDataFrame([("C", 1, "a", 0.5)], "k string, rank int, label string, p double")
    writers.write_top_labels(top, str(tmp_path / "top"), "k", 2)
    assert spark.read.csv(str(tmp_path / "top"), header=True).first().asDict() == {"k": "C", "label_1": "a", "score_1": "0.500000", "label_2": None, "score_2": None}
    writers.write_label_metrics(spark.createDataFrame([("a", 1, 0.5), ("b", 9, None)], "label string, n_pos int, auroc double"), str(tmp_path / "m"))
    assert [r.label for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()] == ["b", "a"]
    assert writers.hits_markdown(top, ["k", "p"]) == "| k | p |\n| --- | --- |\n| C | 0.5000 |"
    writers.write_json_cache(spark, {"b": 1, "a": 2}, str(tmp_path / "c.json"))
    assert readers.read_json_cache(spark, str(tmp_path / "c.json")) == {"a": 2, "b": 1} and readers.read_json_cache(spark, str(tmp_path / "d.json")) == {}


def test_snapshot(spark, tmp_path):
    rows = [(1, "CCO", "MK", "Ki", 2, 7.0), (2, "c1ccccc1C", "MV", "IC50", 0, 4.0), (2, "c1ccccc1C", "MV", "Kd", 3, 6.0), (3, "CCO", "MV", "Ki", 2, 5.0)]
    long = spark.createDataFrame(rows, "pair_id bigint, smiles string, sequence string, assay_type string, assay_order int, pactivity double").withColumns({"activity_label": F.lit(None).cast("int"), "year": F.lit(None).cast("int"), "ph": F.lit(7.4), "temp": F.lit(25.0)})
    made = snapshots.index_rows(long)
    got = {r.row_id: (r.protein_ids, r.ligand_ids, r.scaffold_groups, r.activity_labels, r.assay_idx, r.years) for r in made["rows"].collect()}
    assert got == {7: (0, 0, -1, 1, 2, -1), 10: (1, 1, 0, 0, 0, -1), 13: (1, 1, 0, 1, 3, -1), 17: (1, 0, -1, 1, 2, -1)}
    path = str(tmp_path / "snap")
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, path)
    snapshots.save(spark, made, path, {"source": "x"})
    assert snapshots.load(spark, path, {"source": "x"})["rows"].count() == 4
    with pytest.raises(ValueError):
        snapshots.ensure(spark, path, {"source": "y"}, lambda: made)
    assert set(snapshots.ensure(spark, path, {"source": "y"}, lambda: made, rebuild=True)) == set(made)
    folds = spark.createDataFrame([(7, "train"), (10, "test")], "row_id bigint, fold string")
    assert [r.years for r in snapshots.view(made, folds, "test", ["years"]).collect()] == [-1]
    m = json.loads((tmp_path / "snap" / "manifest.json").read_text())
    assert m["tables"]["rows"]["rows"] == 4
    broken = made | {"proteins": made["proteins"].where("protein_ids > 0")}
    with pytest.raises(ValueError):
        snapshots.save(spark, broken, path, {"source": "z"})
    assert snapshots.load(spark, path, {"source": "y"})["rows"].count() == 4


def test_representations(spark):
    df = spark.createDataFrame([("CCO",), ("c1ccccc1",), ("C(",), (None,)], "s string")
    with pytest.raises(ValueError, match="register"):
        ligands.represent(df, "s", "descriptors", "v")
    ligands.register("lengths", ligands.embedder(lambda texts: np.array([[[len(t), np.inf]] for t in texts], float)))
    got = {r.s: r.v for r in ligands.represent(df, "s", "Morgan, lengths", "v", {"morgan": "circular"}).collect()}
    assert len(got["CCO"]) == 2050 and got["CCO"][-2:] == [3.0, 0.0] and sum(got["CCO"][:2048]) > 2
    assert got["C("] is None and got[None] is None
    assert S.tokens_of(" A, b,a", {"b": "x,y"}) == ["a", "x", "y"]
    del ligands.REPRESENTATIONS["lengths"]


def test_small_functions(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": " "}, "c": "x"}', 100.0)], "k int, j string, nm double")
    r = df.select(S.json_text(F.col("j"), "$.a.b", "$.c").alias("t"), S.nm_to_pchembl(F.col("nm")).alias("p"), prepare.column_or(df, "nope", 3).alias("d")).first()
    assert (r.t, r.p, r.d) == ("x", 7.0, 3)
    raw = spark.createDataFrame([(bytearray(np.array([1, 2], "<f4").tobytes()),), (None,)], "b binary")
    assert [x.v for x in features.decode_vectors(raw, "b", "v", 2).collect()] == [[1.0, 2.0], None]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert {(x.k, x.v) for x in features.put_cache(old, new, "k").collect()} == {(1, "a"), (2, "c")}
    many = features.every_pair(spark.range(3).withColumnRenamed("id", "l"), spark.range(7).withColumnRenamed("id", "p"), block=3)
    assert many.distinct().count() == 21 and features.every_pair(spark.range(3).withColumnRenamed("id", "l"), spark.range(0)).count() == 0
    ids = spark.createDataFrame([(i * 10,) for i in range(7)], "r bigint")
    got = balance.row_shards(ids, "r", 3, 3).collect()
    assert sorted((x.shard, x.r) for x in got) == [(0, 0), (0, 10), (0, 20), (1, 30), (1, 40), (1, 50), (2, 0), (2, 10), (2, 60)]
    with pytest.raises(ValueError):
        balance.goal_share(ids, "r", "some")
