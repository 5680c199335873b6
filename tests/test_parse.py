import csv
import io
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import parse


def brute_reason(text):
    """First reason by the definition, character by character, for quoting and columns."""
    body = re.sub(r"(\r\n|\n|\r)\Z", "", text)
    fields, i = 0, 0
    while True:
        if i < len(body) and body[i] == '"':
            i += 1
            while True:
                j = body.find('"', i)
                if j < 0:
                    return "quoting"
                if body[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < len(body) and body[i] != ",":
                return "quoting"
        else:
            j = body.find(",", i)
            j = len(body) if j < 0 else j
            if '"' in body[i:j]:
                return "quoting"
            i = j
        fields += 1
        if i >= len(body):
            break
        i += 1
    return None if fields == 7 else "columns"


def apply(text, edits):
    """The text with the edits made; places are those of the text as it was."""
    body = re.sub(r"(\r\n|\n|\r)\Z", "", text)
    inserts, deletes = {}, set()
    for e in edits:
        verb, what, _, at = e.split()
        if verb == "insert":
            inserts.setdefault(int(at), []).append('"' if what == "quote" else ",")
        else:
            deletes.add(int(at))
    out = []
    for i in range(len(body) + 1):
        out += inserts.get(i, [])
        if i < len(body) and i not in deletes:
            out.append(body[i])
    return "".join(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a,"\n', max_size=24))
def test_reason_and_edits_by_brute_force(text):
    reason, fields, edits = parse.read_record(text)
    assert (reason if reason in ("quoting", "columns") else None) == brute_reason(text)
    if reason in (None, "relation", "value"):
        assert all(e.startswith("replace") for e in edits) and len(fields) == 7
        # The csv module ends a record at a line end outside quotes.
        assert "\n" in text or fields == next(csv.reader(io.StringIO(re.sub(r"(\r\n|\n|\r)\Z", "", text), newline="")))
    else:
        assert edits and brute_reason(apply(text, edits)) is None


def test_fewest_edits():
    assert parse.min_cost_parse("a,b,c,=,Ki,nM") == ["insert delimiter at 0"] or len(parse.min_cost_parse("a,b,c,=,Ki,nM")) == 1
    assert parse.min_cost_parse('"x "b" y",b,c,=,Ki,nM,1')[0].split()[1] == "quote"
    assert len(parse.min_cost_parse('"x,b,c,=,Ki,nM,1')) == 1


def test_long_records():
    assert parse.read_record('"' + "x" * 200_000 + '",b,c,=,Ki,nM,1')[0] is None
    assert parse.read_record('"' + '""' * 50_000 + '",b,c,=,Ki,nM,1')[0] is None
    assert parse.read_record("x," * 2_000)[0] == "columns"


def lines(spark, raws):
    return spark.createDataFrame([(i, "f", r) for i, r in enumerate(raws)], "line_id bigint, file_name string, raw string")


def test_lines(spark):
    raws = ["n,A,C,=,Ki,nM,1.5", "n,A,C, >= ,Ki,nM, 2e3\r\n", '"n, x",A,C,,Ki,nM,', "n,A,C,gt,Ki,nM,1", "n,A,C,=,Ki,nM,0", "n,A,C,=,Ki,nM,1e400", "n,A,C,=,Ki,nM,1_000", "n,A,C,=,Ki,nM,1d", "n,A,C,=,Ki,nM", '"n,A,C,=,Ki,nM,1', "", None, 'n,A,C,=,Ki,nM,"5"']
    got = {r.row_id: (r.reason, r.value) for r in parse.parse_lines(lines(spark, raws)).collect()}
    want = [(None, 1.5), (None, 2000.0), (None, None), ("relation", None), ("value", None), ("value", None), ("value", None), ("value", None), ("columns", None), ("quoting", None), ("columns", None), ("columns", None), (None, 5.0)]
    assert [got[i] for i in range(len(raws))] == want
    assert parse.parse_lines(lines(spark, [])).count() == 0


def test_fields_and_smiles(spark):
    rows = spark.createDataFrame([(1, "=", "1"), (2, None, None), (3, " ~ ", " +5. "), (4, "=<", "x"), (5, "=", " -1　"), (6, "\t", " ")], "row_id bigint, standard_relation string, standard_value string").withColumn("reason", F.lit("mine"))
    got = {r.row_id: (r.reason, r.value) for r in parse.parse_fields(rows).collect()}
    assert got == {1: (None, 1.0), 2: (None, None), 3: (None, 5.0), 4: ("relation", None), 5: ("value", None), 6: (None, None)}
    s = spark.createDataFrame([(1, "CCO "), (2, None), (3, " \n"), (4, "C("), (5, "C" * 10_000)], "pair_id bigint, ligand_smiles string")
    assert {r.row_id: (r.smiles is None, r.reason) for r in parse.parse_smiles(s).collect()} == {1: (False, None), 2: (True, None), 3: (True, None), 4: (False, "smiles"), 5: (False, None)}


def test_edits_state_the_reason():
    assert parse.read_record("n,A,C,=,Ki,nM,175.3, ") == ("columns", [], ["delete delimiter at 19"])
    twice = parse.read_record("n,A,C,=,Ki,nM,1\nn,A,C,=,Ki,nM,1")
    assert twice[0] == "columns" and len(twice[2]) == 6 and all(e.startswith("delete delimiter") for e in twice[2])
    bars = parse.read_record("n|A|C|=|Ki|nM|1")
    assert bars[0] == "columns" and [e.split()[:2] for e in bars[2]] == [["insert", "delimiter"]] * 6 and len(set(bars[2])) == 6
    assert parse.read_record("n,,A,C,=,Ki,nM,1")[2] == ["delete delimiter at 1"]
    assert parse.read_record("n,A,C,=<,Ki,nM,-1") == ("relation", ["n", "A", "C", "=<", "Ki", "nM", "-1"], ["replace standard_relation", "replace standard_value"])
    assert parse.read_record('"n,A,C,=,Ki,nM,1')[0] == "quoting"


def test_clashing_columns_and_rejects(spark):
    extra = {"reason": F.lit("mine"), "cost": F.lit("x"), "edits": F.lit(0), "row_id": F.lit(-1)}
    s = spark.createDataFrame([(1, "C$C"), (2, "CC")], "pair_id bigint, ligand_smiles string").withColumns(extra)
    got = {r.row_id: (r.reason, r.cost, r.edits) for r in parse.parse_smiles(s).collect()}
    assert got == {1: ("smiles", 1, ["replace ligand_smiles"]), 2: (None, 0, [])}
    rows = spark.createDataFrame([(7, "x", "x")], "row_id bigint, standard_relation string, standard_value string")
    out = parse.rejects(lines(spark, ["a,b", "n,A,C,=,Ki,nM,1"]), rows, s).orderBy("source_table").collect()
    assert [(r.source_table, r.row_id, r.reason, r.edits) for r in out if r.source_table != "gpcrdb_lines"] == [("gpcrdb_data", 7, "relation", "replace standard_relation; replace standard_value"), ("prepared_pairs", 1, "smiles", "replace ligand_smiles")]
    assert [r.reason for r in out if r.source_table == "gpcrdb_lines"] == ["columns"]
