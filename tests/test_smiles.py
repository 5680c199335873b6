import random

import pytest

from tessera.functions.smiles import is_molecule, ligand_keys, parse

GOOD = ["C", "c1ccccc1", "[Na+].[Cl-]", "C[NH+](C)C", "[2H]C", "C/C=C\\C", "[C@@H](C)F", "*C", "C%12CC%12", "C1CC%01", "c1:c:c:c:c:c1", "CC(=O)O", "[13CH4]", "C#N", "[nH]1cccc1", " CCO\t"]
BAD = ["", " ", "C(", "C()C", "[]", "[Xx]", "C=", "=C", "C==C", "C1CC", "C11", "CC..C", ".C", "C.", "C%", "C%1", "(C)C", "C((C))C", "C>>C", "C C", "C-", "e", "None", "nan", "InChI=1S/CH4/h1H4", "c1cc（F)ccc1", "СC", "C)C", "1CC1", "C&1", "C[", "C]"]
SAME = [
    ("c1ccccc1O", "OC1=CC=CC=C1"),
    ("CC(=O)[O-].[Na+]", "OC(=O)C"),
    ("c1ccc2[nH]ccc2c1", "C1=CC=C2NC=CC2=C1"),
    ("C[C@@H](N)O", "OC(N)C"),
    ("c1:c:c:c:c:c1", "c%12ccccc%12"),
    ("[H]OCC", "CCO"),
    ("Br.CCN", "NCC"),
    ("C1.C1CC", "CCCC"),
]
DIFFERENT = [("c1ccccc1", "C1CCCCC1"), ("c1ccc(F)cc1C", "c1cc(F)ccc1C"), ("CC=CC", "CCCC"), ("CCF", "CCCl"), ("CC#N", "CCN"), ("c1ccncc1", "c1ccccc1")]


@pytest.mark.parametrize("text", GOOD)
def test_molecules(text):
    assert is_molecule(text)


@pytest.mark.parametrize("text", BAD)
def test_other_texts(text):
    assert not is_molecule(text)
    assert ligand_keys([text]) == [None]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_ligand(a, b):
    x, y = ligand_keys([a, b])
    assert x == y is not None


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_other_ligand(a, b):
    x, y = ligand_keys([a, b])
    assert x != y


def _write(adjacent, atoms, start, rng):
    """Any SMILES of a tree, from any start."""

    def walk(i, parent):
        near = [j for j in adjacent[i] if j != parent]
        rng.shuffle(near)
        return atoms[i] + "".join(f"({walk(j, i)})" for j in near[:-1]) + (walk(near[-1], i) if near else "")

    return walk(start, -1)


def test_any_order_of_atoms_gives_one_key():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(2, 30)
        atoms = [rng.choice("CNOS") for _ in range(n)]
        adjacent = {i: [] for i in range(n)}
        for i in range(1, n):
            j = rng.randrange(i)
            adjacent[i].append(j)
            adjacent[j].append(i)
        texts = [_write(adjacent, atoms, rng.randrange(n), rng) for _ in range(4)]
        assert len(set(ligand_keys(texts))) == 1


def test_keys_do_not_depend_on_the_batch():
    texts = ["CCO", None, "C(", "c1ccccc1", "CCO"]
    assert ligand_keys(texts) == [ligand_keys([t])[0] for t in texts]


def test_a_very_long_text():
    text = "C" * 50_000
    atoms, bonds, part = parse(text)
    assert len(atoms) == 50_000 and len(bonds) == 49_999 and set(part) == {0}
    assert is_molecule("C(" * 5_000 + "C" + ")" * 5_000)


def test_rings_that_neighbours_cannot_tell_apart():
    from tessera.functions.smiles import same_ligands, scaffold_keys

    decalin, bicyclopentyl = "C1CCC2CCCCC2C1", "C1CCCC1C1CCCC1"
    a, b, c = ligand_keys([decalin, bicyclopentyl, "C1CC2CCCCC2CC1"])
    assert a != b and a == c
    a, b, c = scaffold_keys([decalin + "O", bicyclopentyl + "O", "OC1CC2CCCCC2CC1"])
    assert a != b and a == c
    assert same_ligands([decalin, decalin, "C(", None, "CCO", "c1ccccc1C"], [bicyclopentyl, "C1CC2CCCCC2CC1", "C(", "C", "OCC.Cl", "CC1=CC=CC=C1"]) == [False, True, False, False, True, True]


def test_plain_bonds_only():
    assert not is_molecule("C$C") and not is_molecule("c1cccc$1")
