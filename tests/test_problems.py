import math
from statistics import pstdev

from tessera.plans import problems

PAIR = "pair_id bigint, ligand_smiles string, target_name string, target_organism string, ki_nm string, ic50_nm string, kd_nm string, ec50_nm string, other_nm string, activity_label string, ph string, temp_c string, target_chain_sequence string, year int, loaded_at timestamp"


def pairs(spark, folder, rows):
    names = [c.split()[0] for c in PAIR.split(", ")]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PAIR).write.parquet(f"{folder}/prepared_pairs.parquet")
    return str(folder)


def test_every_measurement_counts(spark, tmp_path):
    rows = [
        {"pair_id": 1, "target_name": "A  b", "ki_nm": "10", "ic50_nm": " 1E3", "other_nm": "5.5"},
        {"pair_id": 2, "target_name": " a B", "kd_nm": "2", "ec50_nm": ">7"},
        {"pair_id": 3, "target_name": "a b", "ki_nm": "nd"},
        {"pair_id": 4, "target_name": "c"},
        {"pair_id": 5, "target_name": " ", "ki_nm": "1"},
        {"pair_id": 6, "ki_nm": "1"},
    ]
    got = {r.target_name: r for r in problems.p4_target_measurements(spark, pairs(spark, tmp_path, rows)).collect()}
    v = [9 - math.log10(x) for x in (10, 1e3, 5.5, 2)]
    assert set(got) == {"a b", "c"}
    r = got["a b"]
    assert (r.rows, r.activity_count, r.activity_min, r.activity_max) == (3, 4, min(v), max(v))
    assert (r.activity_sum, r.activity_mean, r.activity_dev) == (round(sum(v), 6), round(sum(v) / 4, 6), round(pstdev(v), 6))
    assert (got["c"].rows, got["c"].activity_count, got["c"].activity_sum, got["c"].activity_dev) == (1, 0, None, None)


def test_loaded_pairs(spark, tmp_path):
    rows = [
        {"pair_id": 1, "ligand_smiles": " CCO ", "target_name": " A b ", "ki_nm": " 1E3", "ic50_nm": "> 7.5", "kd_nm": "nd", "ec50_nm": ">=-1", "activity_label": "inactive", "ph": "pH 7.4", "temp_c": "25 C", "target_chain_sequence": "MK", "year": 1999},
        {"pair_id": 2, "ligand_smiles": "C("},
        {"pair_id": 3, "ligand_smiles": " ", "ph": "15", "temp_c": "rt", "activity_label": "Y"},
    ]
    got = {r.pair_id: r for r in problems.p2_loaded_pairs(spark, pairs(spark, tmp_path, rows)).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r.ligand_smiles, r.target_name, r.target_organism, r.target_chain_sequence, r.year) == ("CCO", "A b", None, "MK", 1999)
    assert (r.ki_nm, r.ki_relation, r.ki_bound, r.ic50_nm, r.ic50_relation, r.ic50_bound) == (1000.0, None, None, None, ">", 7.5)
    assert (r.kd_nm, r.kd_bound, r.ec50_nm, r.ec50_relation, r.ec50_bound) == (None, None, None, None, None)
    assert (r.activity_label, r.ph, r.temp_c) == (0, 7.4, 25.0)
    r = got[3]
    assert (r.ligand_smiles, r.ph, r.temp_c, r.activity_label) == (None, None, None, 1)


def test_loaded_data(spark, tmp_path):
    rows = [(1, " e ", "P1", "", " = ", "Ki", "nM", " 2e1 "), (2, "e", "P1", "c", "gt", "Ki", "nM", "1"), (3, "e", "P1", "c", None, "Ki", "nM", None), (4, "e", "P1", "c", "=", "Ki", "nM", "0")]
    schema = "row_id bigint, entry_name string, accession string, parent_molecule_chembl_id string, standard_relation string, standard_type string, standard_units string, standard_value string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/gpcrdb_data.parquet")
    got = {r.row_id: tuple(r)[1:] for r in problems.p2_loaded_data(spark, str(tmp_path)).collect()}
    assert got == {1: ("e", "P1", None, "=", "Ki", "nM", 20.0), 3: ("e", "P1", "c", None, "Ki", "nM", None)}
