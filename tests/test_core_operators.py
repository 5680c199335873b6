import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import balance, eager, folds, graph, impute, metrics, placement, prefix, prepare, vocab


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(40)] + [(7, 7), (None, 3), (9000, 9000)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {x: top(x) for x in root}
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == want
    assert graph.connected_components(df.limit(0)).count() == 0


def test_running_sum_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2]), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g int, v bigint").withColumn("h", F.xxhash64("id"))
    got = prefix.running_sum(df, ["g"], {"before": F.col("v")}, prefix.hash_slot(F.col("h")), ["h", "id"]).collect()
    assert len(got) == 500
    at = collections.Counter()
    for r in sorted(got, key=lambda r: (r.h, r.id)):
        assert r.before == at[r.g]
        at[r.g] += r.v


def brute_fill(rows, field):
    out = {}
    for r in rows:
        if r[field] is None:
            if any(q["a"] == r["a"] and r["a"] is not None and q[field] is not None for q in rows):
                out[r["k"]] = "a"
            elif any(q["y"] == r["y"] and r["y"] is not None and q[field] is not None for q in rows):
                out[r["k"]] = "y"
            else:
                out[r["k"]] = "none"
    return out


def test_propagation(spark):
    rng = random.Random(6)
    rows = [{"k": i, "a": rng.choice([None, 1, 2, 3, 4, 5, 6]), "y": rng.choice([None, 2000, 2001, 2002]), "t": rng.choice([None, "Ki", "Kd"]), "x": rng.choice([None, 7.0, 8.0]) if i % 3 else None} for i in range(60)]
    rows += [{"k": 100 + i, "a": 9, "y": 1999, "t": "Ki", "x": None} for i in range(3)] + [{"k": 200, "a": 10, "y": None, "t": None, "x": None}]
    schema = "k bigint, a int, y int, t string, x double"
    df = spark.createDataFrame([tuple(r[c] for c in ("k", "a", "y", "t", "x")) for r in rows], schema).withColumn("x_from", F.lit("clash"))
    got = {r.k: r for r in impute.propagate_numeric(df, "k", {"x": F.col("x")}, "a", "y", "t").collect()}
    assert len(got) == len(rows)
    assert {k: r.x_from for k, r in got.items() if r.x_from} == brute_fill(rows, "x")
    for r in rows:
        if r["x"] is not None:
            assert got[r["k"]].x == r["x"] and got[r["k"]].x_from is None
        elif got[r["k"]].x_from == "none":
            assert got[r["k"]].x is None
        else:
            assert 7.0 <= got[r["k"]].x <= 8.0
    assert impute.propagate_numeric(df.limit(0), "k", {"x": F.col("x")}, "a", "y", "t").count() == 0


def test_fill_is_the_group_mean_where_all_are_alike(spark):
    df = spark.createDataFrame([(1, 1, 2000, "t", 6.0), (2, 1, 2000, "t", 8.0), (3, 1, 2000, "t", None), (4, 2, 2000, "t", None)], "k bigint, a int, y int, t string, x double")
    got = {r.k: (round(r.x, 6), r.x_from) for r in impute.propagate_numeric(df, "k", {"x": F.col("x")}, "a", "y", "t").collect()}
    assert got[3] == (7.0, "a") and got[4] == (7.0, "y")


def test_valid_and_category(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.0), (4, 14.0), (5, 14.1), (6, None), (7, -0.1)], "k bigint, x double")
    assert {r.k for r in df.where(impute.valid_between(F.col("x"), 0, 14).isNotNull()).collect()} == {3, 4}
    cat = spark.createDataFrame([(1, 1, 1, "b"), (2, 1, 1, "a"), (3, 1, 1, None), (4, 2, 1, None), (5, 3, 3, None), (6, None, None, None), (7, 4, 1, "c"), (8, 4, 1, "c"), (9, 4, 1, "b"), (10, 4, 5, None), (11, None, 3, "z"), (12, 1, 1, "b")], "k bigint, a int, y int, c string")
    got = impute.propagate_category(cat, "k", F.col("c"), "c", F.col("a"), F.col("y"), F.lit(None).cast("string"))
    want = {1: ("b", None), 2: ("a", None), 3: ("b", "near"), 4: ("b", "far"), 5: ("z", "far"), 6: (None, "none"), 7: ("c", None), 8: ("c", None), 9: ("b", None), 10: ("c", "near"), 11: ("z", None), 12: ("b", None)}
    assert {r.k: (r.c, r.c_from) for r in got.collect()} == want
    assert impute.propagate_category(cat.limit(0), "k", F.col("c"), "c", F.col("a"), F.col("y"), F.lit(None).cast("string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_labels_come_to_rest_where_the_equations_hold(seed):
    rng = np.random.default_rng(seed)
    n = 60
    group = np.sort(rng.integers(0, 6, n))
    _, group = np.unique(group, return_inverse=True)
    kind = np.cumsum(np.r_[False, (np.diff(group) > 0) | (rng.random(n - 1) < 0.3)])
    node = np.arange(n)
    observed = rng.integers(0, 3, n) * (group != 2)
    missing = rng.integers(0, 5, n) * rng.choice([1, 1, 1000], n)
    missing[observed == 0] = np.maximum(missing[observed == 0], 1)
    total = observed * rng.normal(7, 2, n)
    w = impute.WEIGHTS
    got = impute.spread_labels(total, observed.astype(float), missing.astype(float), [node, kind, group], w)
    a, b = np.eye(n), np.zeros(n)
    for level, weight in zip([node, kind, group], w):
        for i in range(n):
            same = level == level[i]
            size = (observed + missing)[same].sum()
            a[i] -= weight * np.where(same, missing, 0) / size
            b[i] += weight * total[same].sum() / size
    for g in range(int(group[-1]) + 1):
        at = group == g
        if observed[at].sum() == 0:
            assert np.isnan(got[at]).all()
        elif missing[at].sum():
            assert np.allclose(got[at], np.linalg.solve(a[np.ix_(at, at)], b[at]), atol=1e-8)


def test_eager_join_equals_joining_rows(spark):
    rng = random.Random(8)
    left = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, 1.0, 2.5, float("nan")])) for _ in range(80)]
    right = [(rng.choice([None, 1, 2, 2, 4]), rng.choice(["x", "y"])) for _ in range(20)]
    ldf, rdf = spark.createDataFrame(left, "k int, v double"), spark.createDataFrame(right, "k int, g string")
    dim = rdf.where("k is not null").groupBy("k", "g").agg(F.count("*").alias("rows"))
    got = eager.roll_up(eager.join_states(eager.key_states(ldf, {"k": F.col("k")}, {"v": F.col("v")}), dim, "k", ["v"]), ["g"], ["v"])
    joined = collections.defaultdict(list)
    for k, v in left:
        for q, g in right:
            if k is not None and k == q:
                joined[g].append(v)
    assert {r.g for r in got.collect()} == set(joined)
    for r in got.collect():
        real = [v for v in joined[r.g] if v is not None and not math.isnan(v)]
        mean = sum(real) / len(real)
        assert (r.rows, r.v_count) == (len(joined[r.g]), len(real))
        assert r.v_sum == pytest.approx(sum(real)) and r.v_mean == pytest.approx(mean)
        assert r.v_dev == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in real) / len(real)), abs=1e-9)
        assert (r.v_min, r.v_max) == (min(real), max(real))
    empty = eager.key_states(ldf.limit(0), {"k": F.col("k")}, {"v": F.col("v")})
    assert empty.count() == 0
    nulls = eager.key_states(ldf, {"k": F.col("k")}, {"v": F.col("v")}, keyless=True).where("k is null").collect()
    assert [r.rows for r in nulls] == [sum(k is None for k, _ in left)]


def test_names(spark):
    df = spark.createDataFrame([(" A  b\t",), ("a b",), (" A\nB",), ("",), (" ",), (None,)], "n string")
    states = eager.key_states(df, {"n": eager.norm_name(F.col("n"))}, {})
    assert [(r.n, r.rows) for r in states.collect()] == [("a b", 3)]


def brute_auroc(y, s):
    p, n = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def test_metrics(spark):
    rng = random.Random(9)
    rows = [(g, rng.randrange(2), rng.randrange(11) / 10) for g in ("a", "b") for _ in range(60)] + [("c", 1, 0.3)] * 3 + [("d", None, 0.3), ("d", 0, 0.9)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r for r in metrics.binary_metrics(df, ["g"], "y", "s").collect()}
    for g in "ab":
        y, s = [r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g]
        assert got[g].auroc == pytest.approx(brute_auroc(y, s))
        ap = sum(sum(a for a, b in zip(y, s) if b == t) / sum(y) * sum(a for a, b in zip(y, s) if b >= t) / sum(b >= t for b in s) for t in set(s))
        assert got[g].auprc == pytest.approx(ap)
    assert (got["c"].auroc, got["c"].auprc) == (0.5, 1.0) and (got["d"].n, got["d"].auroc, got["d"].auprc) == (1, 0.5, 0.0)
    m = metrics.macro(metrics.binary_metrics(df, ["g"], "y", "s")).first()
    assert (m.n_targets, m.n_evaluable, m.n_skipped) == (4, 2, 2) and m.macro_auroc == pytest.approx((got["a"].auroc + got["b"].auroc) / 2)


def test_macro_and_pooled_differ(spark):
    rows = [(0, 1 - i % 2, 1 - i / 99) for i in range(100)] + [(1, 1, 0.4), (1, 1, 0.6), (1, 0, 0.5), (1, 0, 0.55)]
    df = spark.createDataFrame(rows, "t int, y int, s double")
    macro = metrics.macro(metrics.binary_metrics(df, ["t"], "y", "s")).first()
    assert macro.n_evaluable == 2 and macro.macro_auroc < metrics.pooled(df, "y", "s").first().auroc


def counts(spark, **targets):
    rows, i = [], 0
    for t, (p, n) in targets.items():
        for y in [1] * p + [0] * n:
            rows.append((i, t, y))
            i += 1
    return spark.createDataFrame(rows, "id bigint, t string, y int")


def tally(df):
    return {(r.t, r.y): r.n for r in df.groupBy("t", "y").agg(F.count("*").alias("n")).collect()}


def test_balancing(spark):
    args = ("t", "y", "id")
    assert tally(balance.resample(counts(spark, a=(3, 9), b=(3, 0), c=(0, 3)), *args, 0.5)) == {("a", 1): 3, ("a", 0): 3}
    assert tally(balance.resample(counts(spark, a=(2, 4), b=(1, 1)), *args, 0.5, upsample=True)) == {("a", 1): 4, ("a", 0): 4, ("b", 1): 1, ("b", 0): 1}
    assert tally(balance.resample(counts(spark, a=(2, 10), b=(2, 2)), *args, 0.25)) == {("a", 1): 2, ("a", 0): 6, ("b", 1): 1, ("b", 0): 2}
    assert tally(balance.resample(counts(spark, a=(1, 9)), *args, 0.1, upsample=True)) == {("a", 1): 1, ("a", 0): 9}
    third = 4 / 12
    assert tally(balance.resample(counts(spark, a=(3, 1), b=(1, 7)), *args, third, upsample=True)) == {("a", 1): 3, ("a", 0): 6, ("b", 1): 3, ("b", 0): 7}
    w = {(r.t, r.y): r.weight for r in balance.class_weights(counts(spark, a=(2, 4), b=(1, 2)), *args, 0.5).collect()}
    assert w == {("a", 1): 2.0, ("a", 0): 1.0, ("b", 1): 2.0, ("b", 0): 1.0}
    s = {r.t: r.weight for r in balance.size_weights(counts(spark, a=(2, 4), b=(1, 1)), "t", "id", 1.0).collect()}
    assert s["a"] * 6 == pytest.approx(1) and s["b"] * 2 == pytest.approx(1)
    with pytest.raises(ValueError):
        balance.size_weights(counts(spark, a=(1, 1)), "t", "id", -1)


def test_batches(spark):
    plan = balance.batch_plan(counts(spark, a=(4, 4), b=(2, 2), c=(2, 0)), "t", "y", "id", 2, 2).collect()
    assert len(plan) == 8 and {r.t for r in plan} == {"a", "b"} and {r.batch for r in plan} == {0}
    assert [r.y for r in sorted(plan, key=lambda r: r.slot)] == [1, 1, 0, 0] * 2
    odd = balance.batch_plan(counts(spark, a=(1, 3), b=(5, 1), d=(2, 2)), "t", "y", "id", 2, 3).collect()
    assert collections.Counter(r.batch for r in odd) == {0: 12, 1: 12} and len({(r.batch, r.slot) for r in odd}) == 24


@pytest.mark.parametrize(
    ("years", "targets", "want"),
    [([2010] * 3 + [2020] * 3, [0, 0, 0, 0, 1, 1], {4, 5}), ([-1, -1, 2020, 2020], [0, 1, 0, 2], {3}), ([2010] * 2 + [2019] * 2 + [2020] * 2, [0, 0, 1, 1, 0, 0], {2, 3})],
)
def test_time_protein(spark, years, targets, want):
    df = spark.createDataFrame(list(zip(range(len(years)), targets, years)), "id bigint, t int, y int")
    got = folds.time_protein_split(df, "t", "y").where("fold = 'val'").collect()
    assert {r.id for r in got} == want


@pytest.mark.parametrize("seed", range(6))
def test_largest_first(seed):
    rng = random.Random(seed)
    sizes = collections.Counter(rng.choice([1, 1, 1, 2, 3, 7, 40, 1000]) for _ in range(rng.choice([5, 80, 3000])))
    total = sum(k * v for k, v in sizes.items())
    lack = {"train": 0.7 * total, "val": 0.1 * total, "test": 0.2 * total - rng.choice([0, 50])}
    left, want = dict(lack), {}
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            best = max(left, key=left.__getitem__)
            left[best] -= size
            want[size, best] = want.get((size, best), 0) + 1
    got = {(size, s): n for size, counts in placement.greedy_counts(sizes.items(), lack) for s, n in zip(lack, counts) if n}
    assert got == want


def test_place_blocks(spark):
    blocks = [("a", i, n) for i, n in enumerate([500] + [20] * 10 + [1] * 300)]
    df = spark.createDataFrame(blocks, "kind string, id bigint, n bigint").withColumn("fold", F.lit("clash"))
    got = placement.place(df, ["kind", "id"], "n", {"train": 700.0, "val": 100.0, "test": 200.0})
    rows = {(r.kind, r.id): (r.n, r.fold) for r in got.collect()}
    assert len(rows) == len(blocks) and rows["a", 0] == (500, "train")
    share = collections.Counter()
    for n, f in rows.values():
        share[f] += n
    assert share == {"train": 700, "val": 100, "test": 200}
    assert placement.place(df.limit(0), ["kind", "id"], "n", {"train": 0.0, "test": 0.0}).count() == 0


def test_rows_without_protein_stay_with_their_scaffold(spark):
    rows = [(i, i, i) for i in range(300)] + [(1000 + i, None, i) for i in range(300)] + [(2000 + i, None, 900 + i // 2) for i in range(100)] + [(3000 + i, None, -1) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, p bigint, s bigint")
    got = folds.double_cold_split(df, "id", "p", "s", {"train": 0.7, "val": 0.1, "test": 0.2})
    assert got.count() == len(rows)
    assert got.where("s >= 0").groupBy("s").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    share = {r.fold: r["count"] / len(rows) for r in got.groupBy("fold").count().collect()}
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["test"] - 0.2) < 0.01


def test_blocks_and_nested(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([0] * 10 + list(range(30))), rng.choice([-1, None, *range(100)]), rng.choice([-1, None, *range(2000, 2020)])) for i in range(800)]
    df = spark.createDataFrame(rows, "id bigint, p int, s int, y int")
    for how in ("protein", "double-cold", "time", "time-protein"):
        got = folds.nested_split(df, how if how != "time-protein" else "time", how, 0.1, 0.2, "id", "p", "s", "y")
        assert folds.check_partition(got, df, "id").first().asDict() == {"n_repeated": 0, "n_in_two_folds": 0, "n_missing": 0, "n_unknown": 0}
        if how in ("protein", "double-cold"):
            assert got.groupBy("p").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
        if how == "double-cold":
            assert got.where("s >= 0").groupBy("s").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    empty = folds.cold_split(df.limit(0), "p", {"train": 0.8, "test": 0.2})
    assert empty.count() == 0


def test_explode_and_labels(spark):
    df = spark.createDataFrame([(1, "a;b;c", "x;y"), (2, "", None)], "id bigint, p string, q string")
    assert [(r.id, r.item, r.p, r.q) for r in prepare.explode_lists(df, ["p", "q"], ["id"]).orderBy("id", "item").collect()] == [(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "c", "y"), (2, 0, "", "")]
    prot = spark.createDataFrame([(1, "T1", ["F1", "F2"]), (2, "T2", [])], "p int, target string, families array<string>")
    act = spark.createDataFrame([(7, 1, 2001), (7, 1, 2001), (7, 2, -1), (8, 2, None)], "l int, p int, y int")
    sets = {r.l: (r.families, r.targets, r.year) for r in vocab.label_sets(act, prot, "l", "p", "y").collect()}
    assert sets == {7: (["F1", "F2"], ["T1", "T2"], 2001), 8: ([], ["T2"], None)}


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1200)] + [(5000 - j, 5000) for j in range(1, 150)]
    loose = [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(300)] + [(7, 7), (9999, 9999), (None, 3), (3, None)]
    edges = chain + loose
    rng.shuffle(edges)
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: top(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_versions(spark, tmp_path):
    from tessera.persist import Versions

    v = Versions(spark, f"{tmp_path}/table")
    assert v.load() is None and v.numbers() == []
    assert v.commit(spark.range(3)) == 1 and v.commit(v.load().union(spark.range(2))) == 2
    again = Versions(spark, f"{tmp_path}/table")
    assert again.load().count() == 5 and again.load(1).count() == 3
    again.keep(1)
    assert v.numbers() == [2]
