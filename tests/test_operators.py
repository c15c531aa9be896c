"""Running sums, joins, components, curation and allocation against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codegrain import dims
from codegrain.operators import allocate as al
from codegrain.operators import curate as cu
from codegrain.operators.graph import connected_components
from codegrain.operators.ordered import running_sum, salted_join


def test_running_sum_over_hot_keys(spark):
    rng = random.Random(0)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice([None, 1, 5]), rng.getrandbits(64) - (1 << 63) if i % 7 else 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, v long, h long")
    got = {r["id"]: (r["s"], r["c"]) for r in running_sum(df.withColumn("one", F.lit(1)), ["k"], "h", ["id"], {"s": "v", "c": "one"}, per_cell=50).collect()}
    want, state = {}, defaultdict(lambda: [0, 0])
    for i, k, v, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        want[i] = tuple(state[k])
        state[k][0] += v or 0
        state[k][1] += 1
    assert got == want


def test_salted_join_keeps_every_row(spark):
    rng = random.Random(1)
    big = spark.createDataFrame([(i, rng.choice(["hot"] * 8 + ["x", "y", "none"])) for i in range(3000)], "id long, k string")
    dim = big.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'none'").withColumn("v", F.upper("k"))
    got = salted_join(big, dim, "k", "n", most=10)
    assert sorted(tuple(r) for r in got.select("id", "k", "v").collect()) == sorted((r["id"], r["k"], r["k"].upper()) for r in big.where("k <> 'none'").collect())
    assert salted_join(big.where("false"), dim.where("false"), "k", "n").count() == 0


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"random": [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)], "chain": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 60)], "empty": [(None, 1), (2, 2)]}[shape]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in list(root)}


def one_pass(chunks, budgets, most):
    kept, seen, total = [], defaultdict(int), defaultdict(int)
    files = defaultdict(list)
    for c in chunks:
        files[c[1], c[0]].append(c)
    for (_, lang), own in sorted(files.items()):
        if total[lang] >= budgets[lang]:
            continue
        for c in sorted(own, key=lambda c: c[2]):
            seen[c[3]] += 1
            if seen[c[3]] <= most:
                kept.append(c[:3])
                total[lang] += c[4]
    return set(kept)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_build_equals_one_ordered_pass(spark, seed):
    rng = random.Random(seed)
    chunks = [(f % 3, f, c, f"f{rng.randint(0, 9)}", rng.randint(1, 9)) for f in range(60) for c in range(rng.randint(1, 4))]
    budgets = {0: 40, 1: rng.choice([0, 25]), 2: 10_000}
    kept, rounds = cu.build(spark.createDataFrame(chunks, "lang int, ord long, chunk int, fp string, n long"), "lang", "ord", "chunk", "fp", "n", budgets)
    assert {(r["lang"], r["ord"], r["chunk"]) for r in kept.collect()} == one_pass(chunks, budgets, 3)
    assert rounds <= len(budgets) + 2


def test_split_repair_fills_val_before_test(spark):
    rows = [(1, "train", i) for i in range(50)] + [(2, "train", 0)] + [(3, "train", 0), (3, "val", 1), (3, "test", 2)]
    got = {tuple(r) for r in cu.repair_splits(spark.createDataFrame(rows, "lang int, split string, ord int"), "lang", "split", ["ord"]).groupBy("lang", "split").count().collect()}
    assert got == {(1, "train", 46), (1, "val", 2), (1, "test", 2), (2, "val", 1), (3, "train", 1), (3, "val", 1), (3, "test", 1)}


def test_text_filters(spark):
    rows = [(1, "x" * 199), (2, "x" * 200), (3, "x" * 250 + "\x00"), (4, " " * 300), (5, None), (6, "é" * 100 + "y" * 150)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, t string").select("i", cu.in_band(F.col("t"))).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: None, 6: True}
    texts = ["ab\ncd\nef", "abcdefghij", "a\nbcdefghij", "ab\ncd"]
    cut = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(cu.truncate(F.col("t"), 6, 2)).collect()]
    assert cut == ["ab\ncd", "abcdef", "a\nbcde", "ab\ncd"]


def test_budgets_and_weights():
    w = al.compact_weights()
    assert len(w) == 57 and abs(sum(w.values()) - 1) < 1e-12 and abs(w["javascript"] - 0.153360) < 1e-6
    assert sum(al.floored_budgets(w, 24_000_000).values()) == 30_069_311
    assert sum(b == 400_000 for b in al.floored_budgets(w, 24_000_000).values()) == 37
    assert sum(al.floored_budgets(w, 42_000_000).values()) == 43_241_372
    large = al.large_weights([*dims.POPULARITY, *(f"lang{i}" for i in range(150))])
    exact = al.exact_budgets(large, 160_000_000)
    assert len(exact) == 185 and sum(exact.values()) == 160_000_000 and min(exact.values()) >= 300_000
    assert exact["javascript"] == 3_654_569
    with pytest.raises(ValueError, match="cannot give"):
        al.exact_budgets(large, 1_000)
    assert al.calibration_epoch(48, 0.25) == 36 and al.calibration_epoch(1, 1) == 1


def test_folds_balance_like_the_greedy_rule(spark):
    rng = random.Random(3)
    groups = [(lang, 100 * lang + i, rng.choice([1, 2, 3, 7, 20])) for lang in range(4) for i in range(3 if lang == 0 else 37)]
    got = al.folds(spark.createDataFrame(groups, "lang int, g long, size long"), "lang", "g", "size").collect()
    assert len(got) == len(groups) and {r["fold"] for r in got if r["lang"] == 0} == {-1}
    for lang in (1, 2, 3):
        load = [0, 0]
        for s in sorted((s for la, _, s in groups if la == lang), reverse=True):
            load[load.index(min(load))] += s
        mine = [sum(r["size"] for r in got if r["lang"] == lang and r["fold"] == k) for k in (0, 1)]
        assert sorted(mine) == sorted(load)


def test_weighted_sample_has_the_wanted_size(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(5000)], "id long, w double")
    rows = al.weighted_sample(df, "id", "w", 2000, 7).collect()
    assert abs(sum(r["times"] for r in rows) - 2000) < 150 and all(r["id"] % 5 for r in rows)
    assert rows == al.weighted_sample(df, "id", "w", 2000, 7).collect()
