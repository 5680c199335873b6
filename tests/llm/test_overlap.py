import random

import numpy as np

from tessera.llm import overlap

ROWS = "row_id bigint, split_name string, source string, smiles string, sequence string, year int"


def rows(spark, chains):
    """Rows of one ligand; ``chains`` has ``(split, chain)``."""
    return spark.createDataFrame([(i, s, "a", "CCO", c, 2000) for i, (s, c) in enumerate(chains)], ROWS)


def chain(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))


def test_spans_of_several_train_chains_are_united(spark):
    x = chain(300)
    other = x[:100] + ("A" if x[100] != "A" else "C") + x[101:]
    got = {r.row_id: (r.train_rows, r.covered) for r in overlap.coverage(rows(spark, [("train", other), ("train", x[:290]), ("val", x)])).collect()}
    assert got == {2: (2, 1.0)}
    got = {r.row_id: r.covered for r in overlap.coverage(rows(spark, [("train", other), ("train", x[5:-3]), ("test", x), ("test", x[:280])])).collect()}
    assert got == {2: 1.0, 3: 1.0}
    got = {r.row_id: r.covered for r in overlap.coverage(rows(spark, [("train", other), ("train", other[20:]), ("val", x)])).collect()}
    assert got == {2: 299 / 300}
    rep = overlap.report(rows(spark, [("train", other), ("train", x[:290]), ("val", x)])).collect()
    assert [(r.n_rows, r.n_overlapping, r.n_fully_covered) for r in rep] == [(1, 1, 1)]


def found(df):
    return sorted(tuple(r) for r in overlap.overlaps(df).collect()), sorted(tuple(r) for r in overlap.coverage(df).collect())


def variants(n, seed=5):
    rng = random.Random(seed)
    bases = [chain(n, n) for n in (300, 301, 150)]
    many = []
    for _ in range(n):
        x = list(rng.choice(bases))
        for _ in range(rng.choice([0, 2, 6, 12])):
            x[rng.randrange(len(x))] = "A"
        many.append((rng.choice(["train", "val", "test"]), "".join(x)[rng.choice([0, 7, 25, 26]) :]))
    return many


def test_hot_prefixes_are_parted(spark, monkeypatch):
    df = rows(spark, variants(90))
    whole = found(df)
    assert len(whole[0]) > 50
    monkeypatch.setattr(overlap, "TOGETHER", 2)
    assert found(df) == whole


def test_suffixes_are_those_of_each_text():
    texts = [chain(n, n) for n in (40, 300, 3, 199, 12, 800, 1, 91, 92, 41)] + ["ÄÖ1" * 50]
    which, place, code = overlap.suffixes(texts)
    together = set(zip(which.tolist(), place.tolist(), code.tolist()))
    assert together == {(i, p, c) for i, t in enumerate(texts) for _, p, c in zip(*[x.tolist() for x in overlap.suffixes([t])])}
    assert which.dtype == np.int64
    # Prefixes are in the order of the letters.
    by = sorted((c, texts[w][p : p + 12]) for w, p, c in together if c < 1 << 60 and w < 10)
    assert [t for _, t in by] == sorted(t for _, t in by)


def test_scales_cover_all_lengths():
    for n in range(1, 3000):
        # A pair whose shorter text has n residues is compared over n - END of them at least.
        least = min(overlap.least_run(m) for m in range(max(1, n - overlap.END), n + 1))
        assert any(low <= n and n + 2 * overlap.END < high and least >= k + w - 1 for k, w, low, high in overlap.SCALES)


def test_short_chains(spark):
    rng = random.Random(8)
    texts = [chain(rng.choice([1, 2, 5, 16, 20, 26, 30, 41, 42, 60, 80, 100, 124, 125]), rng.randrange(6)) for _ in range(60)]
    texts += [t[rng.randrange(25) :] + chain(rng.randrange(1, 20), 77) for t in texts if len(t) > 25]
    made = [(rng.choice(["train", "val"]), t) for t in texts]

    def same(a, b):
        for s in range(-overlap.END, overlap.END + 1):
            a0, b0 = max(s, 0), max(-s, 0)
            ra, rb = len(a) - a0, len(b) - b0
            n = min(ra, rb)
            if n > 0 and abs(ra - rb) <= overlap.END and 100 * sum(x != y for x, y in zip(a[a0 : a0 + n], b[b0 : b0 + n])) <= overlap.PERCENT * n:
                return True
        return False

    want = sorted((min(i, j), max(i, j)) for i, (s, a) in enumerate(made) for j, (t, b) in enumerate(made) if s == "train" and t == "val" and same(a, b))
    assert sorted(tuple(r) for r in overlap.overlaps(rows(spark, made)).collect()) == want


def test_ligands_under_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ligand_keys", lambda texts: [(1, 2) for _ in texts])
    x = chain(200)
    made = [("train", "CCO"), ("val", "OCC"), ("test", "CCN"), ("train", "NCC.Cl"), ("val", "CCC")]
    df = spark.createDataFrame([(i, s, "a", t, x, 2000) for i, (s, t) in enumerate(made)], ROWS)
    assert sorted(tuple(r) for r in overlap.overlaps(df).collect()) == [(0, 1), (2, 3)]


def test_links_name_classes(spark):
    x, y = chain(300), chain(300)[5:]
    df = rows(spark, [("train", x), ("train", x), ("val", x), ("val", y), ("test", chain(300, 9)), ("train", y)])
    got = {r.row_id: (r.class_id, r.n_links) for r in overlap.links(df).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 3), 3: (3, 3), 5: (3, 2)}
    assert overlap.links(df.limit(0)).count() == 0
