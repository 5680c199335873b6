import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.smiles import ligand_keys
from tessera.llm import mixing, overlap, pages, spam, splits, tokens

FOLDER = tokens.VOCABULARIES


# Splits


def fact(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, protein_ids bigint, scaffold_groups bigint, years int")


def brute_blocks(rows):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, p, s, _ in rows:
        if p is not None:
            a = top(("p", p))
            if s is not None and s >= 0:
                root[top(("s", s))] = a
    blocks = collections.defaultdict(list)
    for x in list(root):
        if x[0] == "p":
            blocks[top(x)].append(x[1])
    return {p: min(b) for b in blocks.values() for p in b}


def made(seed, n=600):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 0, 0, 0, *range(150)]), rng.choice([None, -1, -1, *range(250)]), rng.choice([None, -1, *range(2000, 2020)])) for i in range(n)]


def test_blocks_and_growth(spark):
    rows = made(1)
    want = brute_blocks(rows)
    one = splits.grow(fact(spark, rows))
    assert {r.id: r.component for r in one.where("kind = 'protein'").collect()} == want
    first = splits.grow(fact(spark, rows[:300]))
    two = splits.grow(fact(spark, rows[300:]), before=first)
    assert {r.id: r.component for r in two.where("kind = 'protein'").collect()} == want
    assert {r.id: r.component for r in two.where("kind = 'scaffold'").collect()} == {r.id: r.component for r in one.where("kind = 'scaffold'").collect()}


def test_component_table_goes_on_from_its_last_version(spark, tmp_path):
    rows = made(2)
    for part in (rows[:200], rows[200:350], [], rows[350:], rows[:50]):
        store = splits.ComponentTable(spark, f"{tmp_path}/components")
        last = store.extend(fact(spark, part))
    assert {r.id: r.component for r in last.where("kind = 'protein'").collect()} == brute_blocks(rows)
    assert store.versions.numbers() == [1, 2, 3, 4, 5]
    again = splits.ComponentTable(spark, f"{tmp_path}/components")
    assert again.load().count() == last.count() and {r.id: r.component for r in again.load(1).where("kind = 'protein'").collect()} == brute_blocks(rows[:200])


def place(spark, rows, comps, placed=None):
    u = splits.units(fact(spark, rows), comps)
    a = splits.assign(u.groupBy("unit_kind", "unit").agg(F.count("*").alias("rows")), placed=placed)
    return u, a


def test_no_group_in_two_splits(spark):
    rows = [(i, i % 400 if i % 50 else None, i % 400 if i % 3 else -1, 2000 + i % 20 if i % 7 else None) for i in range(4000)]
    comps = splits.grow(fact(spark, rows))
    u, a = place(spark, rows, comps)
    got = {r["_row"]: r.split for r in u.join(a, ["unit_kind", "unit"]).collect()}
    assert len(got) == len(rows)
    for col in (1, 2):
        seen = collections.defaultdict(set)
        for r in rows:
            if r[col] is not None and r[col] >= 0:
                seen[r[col]].add(got[r[0]])
        assert all(len(x) == 1 for x in seen.values())
    share = collections.Counter(got.values())
    assert abs(share["train"] / 4000 - 0.8) < 0.02 and abs(share["validation"] / 4000 - 0.1) < 0.02
    rep = {r.split: r for r in splits.report(u, a).collect()}
    assert sum(r.n_rows for r in rep.values()) == 4000 and rep["train"].min_year == -1


def test_kept_and_quarantined(spark):
    rows = [(i, i, i, 2000) for i in range(200)]
    comps = splits.grow(fact(spark, rows))
    _, a = place(spark, rows, comps)
    old = {r.unit: r.split for r in a.collect()}
    x = next(p for p, s in old.items() if s == "train")
    y = next(p for p, s in old.items() if s == "test")
    more = [(1000, x, 999, 2001), (1001, y, 999, 2001), (1002, 5000, 5000, 2001)]
    now = splits.grow(fact(spark, more), before=comps)
    _, b = place(spark, rows + more, now, placed=splits.relabel(a, now))
    new = {r.unit: (r.split, r.state) for r in b.collect()}
    assert new[min(x, y)] == ("quarantine", "quarantined") and max(x, y) not in new
    assert new[5000][1] == "new" and new[5000][0] in splits.SPLITS
    assert all(new[p] == (s, "kept") for p, s in old.items() if p not in (x, y))


def test_empty_splits(spark):
    none = fact(spark, [])
    comps = splits.grow(none)
    u, a = place(spark, [], comps)
    assert comps.count() == u.count() == a.count() == splits.report(u, a).count() == 0


# Overlap

LIGANDS = ["c1ccccc1O", "OC1=CC=CC=C1", "CCO", "OCC.Cl", "CCN", "c1ccc(F)cc1C"]


def variant(rng, base):
    c = list(base)
    for _ in range(rng.choice([0, 0, 3, 9, 12, 30])):
        c[rng.randrange(len(c))] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
    s = "".join(c)
    cut, add = rng.choice([0, 0, 10, 25, 26]), rng.choice([0, 0, 20, 25, 27])
    s = s[cut:] + "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(add))
    return rng.choice([s, s.lower(), s[:50] + "-\n" + s[50:] + "*"])


def same_chain(a, b):
    if a == b:
        return True
    for shift in range(-overlap.END, overlap.END + 1):
        a0, b0 = max(shift, 0), max(-shift, 0)
        ra, rb = len(a) - a0, len(b) - b0
        n = min(ra, rb)
        if n > 0 and abs(ra - rb) <= overlap.END and 100 * sum(x != y for x, y in zip(a[a0 : a0 + n], b[b0 : b0 + n])) <= overlap.PERCENT * n:
            return True
    return False


def prepared(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, split_name string, smiles string, sequence string, source string, year int").withColumn("k1", F.lit("clash"))


def test_overlaps_by_brute_force(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (300, 410, 120, 180)]
    rows = [(i * 3, rng.choice(["train", "train", "val", "test"]), rng.choice(LIGANDS), variant(rng, rng.choice(bases)), "s", 2000) for i in range(160)]
    rows += [(9001, "train", None, bases[0], "s", 1), (9002, "val", "CCO", None, "s", 1), (9003, "val", "C(", bases[0], "s", None), (9004, "other", "CCO", bases[0], "s", 1), (9005, "val", "CCO", " -", "s", 1), (9006, "train", "CCO", "*", "s", 1)]
    keys = ligand_keys([r[2] for r in rows])
    clean = [None if r[3] is None else "".join(c for c in r[3].upper() if c not in " -*\n") for r in rows]
    want = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[1] == "train" and b[1] in ("val", "test") and keys[i] and keys[i] == keys[j] and clean[i] and clean[j] and same_chain(clean[i], clean[j]):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    df = prepared(spark, rows)
    got = [(r.row_id_1, r.row_id_2) for r in overlap.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    cover = {r.row_id: r.train_rows for r in overlap.coverage(df).collect()}
    split = {r[0]: r[1] for r in rows}
    assert cover == dict(collections.Counter(y if split[x] == "train" else x for x, y in want))
    rep = overlap.report(df).collect()
    assert sum(r.n_rows for r in rep) == sum(s in ("val", "test") for s in split.values()) and sum(r.n_overlapping for r in rep) == len(cover)


def test_empty_overlap(spark):
    assert overlap.overlaps(prepared(spark, [])).count() == 0
    assert overlap.report(prepared(spark, [])).count() == 0


def test_shared_stretch_keeps_a_shared_suffix():
    rng = random.Random(4)
    for k, w, _, _ in overlap.SCALES:
        for _ in range(200):
            span = "".join(rng.choice("ACDEFG") for _ in range(k + w - 1))
            texts = ["".join(rng.choice("ACDEFG") for _ in range(rng.randrange(60))) + span + "".join(rng.choice("ACDEFG") for _ in range(rng.randrange(60))) for _ in range(2)]
            flat, lengths = overlap._codes(texts)
            which, place, _ = overlap.kept_suffixes(flat, lengths, k, w)
            at = {(i, p - texts[i].index(span)) for i, p in zip(which.tolist(), place.tolist())}
            assert any((0, x) in at and (1, x) in at for x in range(w))


# Tokens

TEXTS = ["Hello, world! It's 3.14 nM.", "", None, "   leading and trailing   \n\n\t x", "αβγ 中文 日本語 ​  x　y", "<|endoftext|> in a text", "'s't're 'VE don't", "a" * 5000, "\U0001f9ea 𠮷   \x85 \x1c z", "\U0001fae8 new sign \U00031350", "Hello, world! It's 3.14 nM.", "tab\tnew\r\nline  ", "é ٣٤ Ⅷ ² x²"]


def test_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i * 7, x, "clash") for i, x in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    for block in (1_000_000, 7):
        got = {r.doc_id: r.ids for r in tokens.encode(df, block=block).collect()}
        assert got == {i * 7: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
        sizes = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, block=block).collect()}
        assert sizes == {k: len(v) for k, v in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i * 7: x or "" for i, x in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0
    twice = df.where("doc_id in (0, 14)").union(df.where("doc_id = 0")).union(df.selectExpr("cast(null as bigint)", "text", "ids").limit(1))
    assert sorted((r.doc_id is None, len(r.ids)) for r in tokens.encode(twice).collect()) == sorted([(False, len(got[0]))] * 2 + [(False, 0), (True, len(got[0]))])


# Mixing


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(5, 60))) + f" {i}", rng.choice(["Big", " big ", "BIG", "small", "other", None])) for i in range(400)]
    docs += [(1000 + i, "the same text again and again", "small") for i in range(30)] + [(2000, None, "big"), (2001, "", "small")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.4, 2), ("small", 0.5, 2), ("empty", 0.1, 3)], "source string, target_share double, max_repeats int")
    texts = mixing.sized_texts(df, targets)
    planned = mixing.plan(texts, targets)
    drawn = mixing.draw(texts, planned).collect()
    enc = tokens.vocabulary(FOLDER)
    size = collections.Counter()
    for _, t, s in docs:
        if t and s and s.strip().lower() in ("big", "small"):
            size[s.strip().lower()] += len(enc.encode_ordinary(t))
    total = sum(size.values())
    rep = {r.source: r for r in mixing.report(planned, mixing.draw(texts, planned)).collect()}
    for s, share, most in (("big", 0.4, 2), ("small", 0.5, 2), ("empty", 0.1, 3)):
        assert rep[s].size_tokens == size[s] and rep[s].short == (most * size[s] < share * total)
        assert rep[s].most_repeats <= most
        if not rep[s].short:
            assert abs(rep[s].mixed_tokens - share * total) < 5 * 60
    assert sum(r.n_tokens * r.repeats for r in drawn) == sum(r.mixed_tokens for r in rep.values())
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-9
    uses = mixing.mix(mixing.draw(texts, planned)).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("use").alias("m")).collect()
    assert all(r.n == r.m <= 2 for r in uses)
    same = [r for r in uses if r.doc_id >= 1000]
    assert len(same) == 1 and same[0].doc_id == 1000
    none = mixing.sized_texts(df.limit(0), targets)
    assert [r.mixed_tokens for r in mixing.report(mixing.plan(none, targets), mixing.draw(none, mixing.plan(none, targets))).collect()] == [0, 0, 0]


# Spam

SENTENCES = "We measured the affinity of the compound at the receptor. The plates were read after an hour in buffer. No trend was seen between the two series, and the data were kept. "


def neither(text):
    return pages.shares(text)[2]


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        (SENTENCES * 5, 0, 0.1),
        ("buy cheap ligand | " * 30, 0.9, 1),
        ("\n".join(f"[cheap probe](http://shop.x.test/{i})" for i in range(30)), 0.9, 1),
        ("#best #ligand #buy " * 30, 0.9, 1),
        ("thermal shift, organ bath, brain slices, partial tracer, " * 20, 0.9, 1),
        ("b u y  c h e a p " * 30, 0.9, 1),
        (SENTENCES + "\n>P1 protein\n" + "\n".join(["MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVK"] * 5), 0, 0.1),
        (SENTENCES + "\ncompound;type;nM;pH\n" + "\n".join(f"HB-{i};Ki;{i}.5;7.4" for i in range(20)), 0, 0.15),
        (SENTENCES * 3 + "\nTags: potency, ligand, probe", 0, 0.2),
        (SENTENCES + "buy cheap ligand | " * 60, 0.6, 1),
        ("試料は25℃で28分間培養した。緩衝液のpHは7.2に保った。" * 5, 0, 0.1),
    ],
)
def test_share_of_neither(text, low, high):
    assert low <= neither(text) <= high


def test_long_and_odd_texts():
    for t in ("x" * 300_000, "a, " * 100_000, "\n" * 200_000, "​" * 200, ";" * 50_000, "a.b" * 50_000):
        f, hosts = pages.content(t)
        assert len(f) == len(pages.FEATURES) - 1 and all(np.isfinite(f)) and hosts == []
        assert 0 <= neither(t) <= 1


def test_spam_pages(spark):
    rng = random.Random(6)
    docs = []
    for i in range(120):
        bad = i % 3 == 0
        junk = " | ".join(f"buy {rng.choice(['cheap', 'best'])} ligand {rng.randrange(9)}" for _ in range(40))
        docs.append((i, junk if bad else SENTENCES * rng.randint(1, 4), f"http://h{i % 5}.test/{i}" if i % 4 else None))
    docs += [(900, None, "http://a.test"), (901, "", None), (902, "buy buy", None), (903, docs[0][1], "::bad url::")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, url string").withColumns({"host": F.lit("clash"), "f": F.lit(1), "p": F.lit(2)})
    got = {r.doc_id for r in spam.spam_pages(df).where("spam").collect()}
    assert got == {i for i in range(120) if i % 3 == 0} | {903}
    assert spam.spam_pages(df.limit(0)).count() == 0
    honest = spam.spam_pages(df.where("doc_id % 3 = 1")).collect()
    assert honest and not any(r.spam for r in honest)
    # Without the check too the trees tell most pages.
    assert all((r.smoothed > 0.5) == r.spam for r in spam.spam_pages(df).collect())


def test_links_and_host_graph(spark):
    text = SENTENCES + " http://B.test/x https://u@b.test:8/y www.c.test/z [a](http://d.test)"
    f, hosts = pages.content(text)
    assert hosts == ["b.test", "c.test", "d.test"] and pages.linked_hosts(text) == ["b.test", "b.test", "d.test", "c.test"]
    assert f[pages.FEATURES.index("link_hosts")] == 3 / 4
    docs = spark.createDataFrame([(1, text, "http://a.test/1"), (2, text, "http://b.test/2"), (3, SENTENCES, "http://b.test/3"), (4, text, None)], "doc_id bigint, text string, url string")
    got, n = spam.page_features(docs)
    last = {r.doc_id: r.f[-1] for r in got.collect()}
    assert n == 4 and last[1] == 0 and last[2] == last[3] == pytest.approx(np.log1p(2)) and last[4] == 0


def test_host_moves_doubtful_pages_only(spark):
    rows = [(i, "bad.test", 0.95) for i in range(50)] + [(100, "bad.test", 0.45), (101, "one.test", 0.45), (102, None, 0.45)] + [(200 + i, "good.test", 0.02) for i in range(50)] + [(300, "bad.test", 0.02)]
    got = {r.doc_id: r.smoothed for r in spam.smooth(spark.createDataFrame(rows, "doc_id bigint, host string, p double")).collect()}
    assert got[100] > 0.5 and abs(got[101] - 0.45) < 1e-9 and abs(got[102] - 0.45) < 1e-9 and got[300] < 0.5


def test_hosts(spark):
    urls = {"http://A.test/x": "a.test", "https://u@b.test:80/": "b.test", "c.test/x": None, None: None, "": None, "ftp://d.test": "d.test"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", spam.host(F.col("u")).alias("h")).collect()} == urls
